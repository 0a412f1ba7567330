import json

import pytest

from lexispark.operators import names
from lexispark.plans.config import MatchConfig
from lexispark.sources import binary, documents
from lexispark.sources.names import read_names, write_names
from lexispark.streaming.match import rated_stream, read_stream, write_stream

PAIRS = [("Ann Ek", "t1"), ("Bo Øre", "t1"), ("Bo Øre", "t2")]


def rows(df):
    return sorted((r.name, r.target_id) for r in df.collect())


def test_names_formats(spark, tmp_path):
    (tmp_path / "n.txt").write_text("Ann Ek\nBo Øre\r\n\nlast", newline="")
    assert rows(read_names(spark, f"{tmp_path}/n.txt", "lines").fillna("-")) == [("Ann Ek", "-"), ("Bo Øre\r", "-"), ("last", "-")]
    assert ("Bo Øre", "-") in rows(read_names(spark, f"{tmp_path}/n.txt", "lines", strip_cr=True).fillna("-"))
    (tmp_path / "a.json").write_text(json.dumps({"t1": ["Ann Ek", "Bo Øre"], "t2": ["Bo Øre"]}))
    (tmp_path / "b.json").write_text(json.dumps({"Ann Ek": ["t1"], "Bo Øre": ["t1", "t2"]}))
    (tmp_path / "n.bin").write_bytes(binary.encode_names(PAIRS))
    for path, fmt in (("a.json", "json"), ("b.json", "json_inverse"), ("n.bin", "thrift")):
        assert rows(read_names(spark, f"{tmp_path}/{path}", fmt)) == PAIRS
    write_names(read_names(spark, f"{tmp_path}/n.bin", "thrift"), f"{tmp_path}/p")
    assert rows(read_names(spark, f"{tmp_path}/p", "parquet")) == PAIRS
    data, begin = binary.csr_bytes(["Ann Ek", "Bo Øre"])
    (tmp_path / "c.mmap").write_bytes(data)
    (tmp_path / "c_begin.mmap").write_bytes(begin)
    assert [r.name for r in read_names(spark, f"{tmp_path}/c.mmap", "csr").collect()] == ["Ann Ek", "Bo Øre"]
    pairs = read_names(spark, f"{tmp_path}/p", "parquet")
    write_names(pairs, f"{tmp_path}/q.bin", "thrift")
    assert rows(read_names(spark, f"{tmp_path}/q.bin", "thrift")) == PAIRS
    write_names(pairs, f"{tmp_path}/q.mmap", "csr")
    assert rows(read_names(spark, f"{tmp_path}/q.mmap", "csr").fillna("-")) == [("Ann Ek", "-"), ("Bo Øre", "-")]
    for bad in (lambda: read_names(spark, "x", "xml"), lambda: write_names(pairs, "x", "xml"), lambda: binary.write_binary(pairs, "x", "csr", most=3)):
        with pytest.raises(ValueError):
            bad()


def test_names_are_downloaded(spark, tmp_path):
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    from lexispark.sources.names import downloaded

    (tmp_path / "n.txt").write_text("Ann Ek\nBo Øre")
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(SimpleHTTPRequestHandler, directory=tmp_path))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/n.txt"
    try:
        assert rows(read_names(spark, url, "lines").fillna("-")) == [("Ann Ek", "-"), ("Bo Øre", "-")]
        with pytest.raises(ValueError):
            downloaded(spark, url, most=3)
    finally:
        server.shutdown()


def test_decoder_skips_unknown_fields_and_refuses_short_files():
    extra = bytes([binary.I32, 0, 9, 0, 0, 0, 5]) + bytes([binary.LIST, 0, 8, binary.BYTE, 0, 0, 0, 1, 7])
    content = binary.encode_names(PAIRS)
    assert sorted(binary.decode_names(extra + content)) == PAIRS
    with pytest.raises(ValueError):
        binary.decode_names(content[:-4])


def test_lookup_prunes_to_one_folder(spark, tmp_path):
    docs = spark.createDataFrame([("abc1", "x"), ("abc2", "y"), ("zzz", "w")], "doc_id string, text string")
    documents.write_documents(docs, f"{tmp_path}/d", by_prefix=True)
    one = documents.lookup(spark.read.parquet(f"{tmp_path}/d"), "abc2")
    assert [r.text for r in one.collect()] == ["y"]
    assert "id_prefix" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_stream_equals_batch_and_keeps_repeated_documents(spark, tmp_path):
    c = MatchConfig(min_bytes=3)
    p = names.prepare(spark.createDataFrame(PAIRS, "name string, target_id string"), c).cache()
    docs = spark.createDataFrame([(1, "see ann ek"), (1, "bo øre, ann ek"), (2, "none"), (3, None)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = read_stream(spark, f"{tmp_path}/in", "doc_id long, text string", 1)
    rated = rated_stream(stream, p, c, {"clean_visible": "text"}).select("doc_id", "targets")
    write_stream(rated, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted((r.doc_id, r.targets) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, ["t1"]), (1, ["t1", "t2"])]


def test_plan_reads_what_it_needs(spark, data):
    from lexispark.plans.queries import QUERIES

    plan = QUERIES["scan_docs"](spark, data)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert sorted(read.split(",")) == ["doc_id:bigint", "lang:string", "text:string"]
    assert "EqualTo(lang,en)" in plan


def test_plans_find_mentions_once(spark, data):
    from lexispark.plans.job import run
    from lexispark.plans.queries import QUERIES, docs, patterns

    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    p, c = patterns(spark, data)
    for name in ("mentions_all", "token_mentions", "filter_docs"):
        assert count(QUERIES[name](spark, data)) == 1, name
    assert count(run(docs(spark, data), p, c, {"clean_visible": "text"})) == 2  # mentions, then targets
    assert count(QUERIES["ratings_nested"](spark, data)) == 2


def test_stream_counts_and_rates(spark, tmp_path):
    from lexispark.streaming.match import rates

    c = MatchConfig(min_bytes=3)
    p = names.prepare(spark.createDataFrame(PAIRS, "name string, target_id string"), c)
    spark.createDataFrame([(i, "see ann ek") for i in range(6)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/in")
    rated = rated_stream(read_stream(spark, f"{tmp_path}/in", "doc_id long, text string", 1), p, c, {"clean_visible": "text"}).select("doc_id", "targets")
    query = write_stream(rated, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    known = rates(query)
    assert sum(n for _, n, _ in known) == 6 and all(r > 0 for _, n, r in known if n)


def test_functions_travel_with_their_code(tmp_path):
    """Executors that can't import the package run the matcher, the token matcher and a whole job."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})  # of the driver only
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.executor.memory", "512m").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from lexispark.operators import match, names, token_match
from lexispark.plans.config import MatchConfig
from lexispark.plans.job import run
c = MatchConfig(min_bytes=3)
p = names.prepare(spark.createDataFrame([("Ann Ek", "t1")], "name string, target_id string"), c)
docs = spark.createDataFrame([(1, "see ann  ek"), (2, "é Ann Ek")], "doc_id long, text string")
assert match.mentions(docs, p, c).count() == 2
assert match.joined_mentions(docs, p, c).count() == 2
assert match.keep_documents(docs, p, c).count() == 2
assert run(docs, p, c, {{"clean_visible": "text"}}).count() == 2
assert token_match.mentions(docs, spark.createDataFrame([("Ann", "t")], "name string, target_id string")).count() == 1
try:
    spark.sparkContext.parallelize([1]).map(lambda _: __import__("lexispark")).count()
    print("IMPORTED")
except Exception:
    print("DONE")
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("DONE"), out.stderr[-2000:]
