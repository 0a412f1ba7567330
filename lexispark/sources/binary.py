"""Binary dictionaries, read through Spark from any store.

A dictionary is a Thrift binary struct: field 1 maps target ids to names, field 2 names to target ids. Offset
arrays (csr) are a file x.mmap with the bytes of all names and x_begin.mmap with n + 1 unsigned 64-bit offsets.
"""

from __future__ import annotations

import io
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type codes of the Thrift binary protocol. Fixed values.
STOP, BOOL, BYTE, DOUBLE, I16, I32, I64, STRING, STRUCT, MAP, SET, LIST = 0, 2, 3, 4, 6, 8, 10, 11, 12, 13, 14, 15
WIDTH = {BOOL: 1, BYTE: 1, DOUBLE: 8, I16: 2, I32: 4, I64: 8}


class Decoder:
    """Values of the Thrift binary protocol from a file; strings as bytes, structs as {field id: value}."""

    def __init__(self, file):
        self.file = file

    def take(self, n: int) -> bytes:
        out = self.file.read(n)
        if len(out) != n or n < 0:
            raise ValueError("the file ends inside a value")
        return out

    def number(self, form: str) -> int:
        return struct.unpack(">" + form, self.take(struct.calcsize(form)))[0]

    def value(self, kind: int):
        if kind in WIDTH:
            return self.number({1: "b", 2: "h", 4: "i", 8: "d" if kind == DOUBLE else "q"}[WIDTH[kind]])
        if kind == STRING:
            return self.take(self.number("i"))
        if kind == STRUCT:
            out = {}
            while (k := self.number("b")) != STOP:
                field = self.number("h")
                out[field] = self.value(k)
            return out
        if kind == MAP:
            a, b, n = self.number("b"), self.number("b"), self.number("i")
            return [(self.value(a), self.value(b)) for _ in range(n)]
        if kind in (SET, LIST):
            k, n = self.number("b"), self.number("i")
            return [self.value(k) for _ in range(n)]
        raise ValueError(f"unknown type code {kind}")


def decode_names(content: bytes) -> list[tuple[str, str]]:
    """(name, target_id) of a dictionary; from field 2 if it is there, else from field 1. Unknown fields are skipped."""
    fields = Decoder(io.BytesIO(content)).value(STRUCT)
    text = lambda b: b.decode()
    if fields.get(2) is not None:
        return [(text(name), text(t)) for name, targets in sorted(fields[2]) for t in targets]
    return [(text(name), text(target)) for target, names in fields.get(1) or [] for name in names]


def encode_names(pairs: list[tuple[str, str]]) -> bytes:
    """A dictionary with both maps of (name, target_id)."""

    def table(rows) -> bytes:
        by: dict[str, list[str]] = {}
        for k, v in rows:
            by.setdefault(k, []).append(v)
        string = lambda s: struct.pack(">i", len(b := s.encode())) + b
        body = b"".join(string(k) + struct.pack(">bi", STRING, len(v)) + b"".join(map(string, v)) for k, v in by.items())
        return struct.pack(">bbi", STRING, LIST, len(by)) + body

    both = (table((t, n) for n, t in pairs), table(pairs))
    return b"".join(struct.pack(">bh", MAP, i + 1) + x for i, x in enumerate(both)) + bytes([STOP])


def csr_bytes(names: list[str]) -> tuple[bytes, bytes]:
    """The two files of the offset arrays."""
    parts = [n.encode() for n in names]
    at = [0]
    for p in parts:
        at.append(at[-1] + len(p))
    return b"".join(parts), struct.pack(f"<{len(at)}Q", *at)


def cut_names(content: bytes, begins: bytes) -> list[str]:
    """The names of the offset arrays."""
    at = struct.unpack(f"<{len(begins) // 8}Q", begins)
    return [content[a:b].decode() for a, b in zip(at, at[1:], strict=False)]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a file, a folder or a pattern, whole; a file is held by one task."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_thrift(spark: SparkSession, path: str) -> DataFrame:
    """name_targets of binary structs."""

    @F.arrow_udf("array<struct<name:string,target_id:string>>")
    def decoded(contents):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("name", pa.string()), ("target_id", pa.string())]))
        return pa.array([[{"name": n, "target_id": t} for n, t in decode_names(c)] for c in contents.to_pylist()], kind)

    return files(spark, path).select(F.explode(decoded("content")).alias("x")).select("x.*")


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """name_targets without targets of offset arrays: path names the file of names, x.mmap; x_begin.mmap lies beside it."""

    @F.arrow_udf("array<string>")
    def cut(contents, begins):
        import pyarrow as pa

        return pa.array([cut_names(c, b) for c, b in zip(contents.to_pylist(), begins.to_pylist(), strict=True)], pa.list_(pa.string()))

    names = files(spark, path).filter(~F.endswith("path", F.lit("_begin.mmap")))
    begins = files(spark, path.removesuffix(".mmap") + "_begin.mmap").select(F.regexp_replace("path", r"_begin\.mmap$", ".mmap").alias("path"), F.col("content").alias("begins"))
    return names.join(begins, "path").select(F.explode(cut("content", "begins")).alias("name"), F.lit(None).cast("string").alias("target_id"))


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of any store that Spark knows, replaced if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(content)
    finally:
        out.close()


def write_binary(name_targets: DataFrame, path: str, fmt: str, most: int = 256 << 20) -> None:
    """A dictionary as one file, thrift, or two, csr (names only, x.mmap and beside it x_begin.mmap). These formats are made in one
    piece, so a dictionary of more than `most` bytes is refused before it is collected; Parquet takes any."""
    spark, rows = name_targets.sparkSession, name_targets.select("name", "target_id").distinct() if fmt == "thrift" else name_targets.select("name").distinct()
    size = rows.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in rows.columns))).first()[0] or 0
    if size > most:
        raise ValueError(f"the dictionary takes {size} bytes, more than {most}")
    found = [tuple(r) for r in rows.orderBy(*rows.columns).collect()]
    if fmt == "thrift":
        if any(t is None for _, t in found):
            raise ValueError("a binary struct has no names without targets")
        write_file(spark, path, encode_names(found))
    else:
        names, begins = csr_bytes([n for (n,) in found])
        write_file(spark, path, names)
        write_file(spark, path.removesuffix(".mmap") + "_begin.mmap", begins)
