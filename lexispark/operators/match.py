"""Finding every mention of every name: overlapping, nested, without word boundaries.

Small dictionaries go to the workers as an automaton; their size is checked first. Larger ones are joined: the workers
get a filter of bits of the names and pick the places of a text where one may stand, and what stands there is joined with
the names. Both give the same rows. Streams take small dictionaries only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.normalize import byte_offsets, fold, origins, points
from lexispark.functions.text import best_content
from lexispark.functions.worker import once
from lexispark.plans.config import MatchConfig

#: Characters of a name by which the filter of the join knows it: the first and the last of it, as many of these as it has.
STEMS = (1, 2, 4, 8, 16, 32)
#: Names of one filter, and bits for each of them: 32 MB at most go to a worker. More names take several filters, one after another.
FILTER_NAMES = 1 << 23
FILTER_BITS = 32
#: Places of a text that are hashed at a time, and characters of texts that are looked at together.
WINDOW = 1 << 17
TOGETHER = 1 << 20
#: Filters of up to so many bits take a byte for each, which is faster to read.
UNPACKED = 1 << 20
#: Odd factors of the hashes, which have 32 bits, and those that make the bits of one.
FACTOR, STEP = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
PROBES = tuple(map(np.uint32, (0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)))

MENTION = "pattern_id int, norm_start int, norm_end int, start_byte int, end_byte int, start_char int, end_char int, value string"
MENTIONS = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in MENTION.split(', '))}>>"


def automaton(key: str, names: tuple[str, ...]):
    """Built once per worker and dictionary."""

    def build():
        import ahocorasick

        out = ahocorasick.Automaton()
        for i, name in enumerate(names):
            out.add_word(name, i)
        out.make_automaton()
        return out

    return once(("automaton", key), build)


def named(names: list[str]) -> tuple[str, tuple[str, ...]]:
    """The names with a key of theirs."""
    import hashlib

    return hashlib.md5("\0".join(names).encode("utf-8", "surrogatepass")).hexdigest(), tuple(names)


def hits(machine, text: str, lengths: np.ndarray) -> np.ndarray:
    """(end, -length, id) of each hit, in order of end and then longest first."""
    found = np.array(list(machine.iter(text)) if len(machine) else [], np.int64).reshape(-1, 2)
    ends, ids = found[:, 0] + 1, found[:, 1]
    order = np.lexsort((ids, -lengths[ids], ends))
    return np.stack((ends, -lengths[ids], ids), 1)[order]


def listed(found, how: str):
    """An Arrow list of mentions for each (text, pattern ids, normalized starts, normalized ends); source places are worked out
    for texts with a mention only."""
    import pyarrow as pa

    columns, values, lengths = [[np.empty(0, np.int64)] for _ in range(7)], [], [0]
    for text, ids, starts, ends in found:
        lengths.append(len(ids))
        if len(ids):
            back, at = origins(text, how), byte_offsets(text)
            a, b = back[starts], back[ends]
            for column, x in zip(columns, (ids, starts, ends, at[a], at[b], a, b), strict=True):
                column.append(x)
            values += [text[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    flat = [pa.array(np.concatenate(c).astype(np.int32)) for c in columns]
    names = [f.split()[0] for f in MENTION.split(", ")]
    return pa.ListArray.from_arrays(np.cumsum(lengths, dtype=np.int32), pa.StructArray.from_arrays([*flat, pa.array(values, pa.string())], names))


def finder(names: list[str], how: str):
    """A function from a text to (text, pattern ids, normalized starts, normalized ends). how: `unicode`, `ascii` or `none`."""
    key, names = named(names)
    lengths = np.array([len(n) for n in names], np.int64)

    def find(text):
        found = hits(automaton(key, names), fold(text, how) if text else "", lengths)
        return text, found[:, 2], found[:, 0] + found[:, 1], found[:, 0]

    return find


def matcher(names: list[str], how: str):
    """A column function from a text to its mentions."""
    find = finder(names, how)

    @F.arrow_udf(MENTIONS)
    def mentions(texts):
        return listed(map(find, texts.to_pylist()), how)

    return mentions


def any_matcher(names: list[str], how: str):
    """A column function from a text to whether it has a mention; it stops at the first."""
    key, names = named(names)

    @F.arrow_udf("boolean")
    def has(texts):
        import pyarrow as pa

        machine = automaton(key, names)
        return pa.array([bool(t) and len(machine) > 0 and next(machine.iter(fold(t, how)), None) is not None for t in texts.to_pylist()], pa.bool_())

    return has


def fits(patterns: DataFrame, config: MatchConfig) -> bool:
    """Whether names and targets are small enough to go to every worker."""
    targets = F.aggregate("target_ids", F.lit(0).cast("bigint"), lambda n, t: n + F.coalesce(F.octet_length(t), F.lit(0)))
    return (patterns.agg(F.sum(F.octet_length("norm_name") + F.coalesce(targets, F.lit(0)))).first()[0] or 0) <= config.max_broadcast


def collected(patterns: DataFrame) -> list[str]:
    """The names in order of their ids, which have no gaps; callers have asked fits()."""
    return [r[0] for r in patterns.select("norm_name", "pattern_id").orderBy("pattern_id").collect()]


def refuse_stream(docs: DataFrame) -> None:
    if docs.isStreaming:
        raise ValueError("the dictionary is larger than max_broadcast; a stream can't be joined with it")


def with_mentions(docs: DataFrame, patterns: DataFrame, config: MatchConfig = MatchConfig(), text: str = "text", small: bool | None = None) -> DataFrame:
    """docs with the array `mentions`, row by row: repeated ids are not merged. A small dictionary takes no shuffle; with a larger
    one, places are joined back on the hash of the text. small: what fits() says, if it is known."""
    if fits(patterns, config) if small is None else small:
        return docs.withColumn("mentions", matcher(collected(patterns), config.normalize)(F.col(text)))
    return joined_columns(docs.drop("mentions"), patterns, config, text).select("row.*", "mentions")


def with_mentions_and_targets(docs: DataFrame, patterns: DataFrame, config: MatchConfig = MatchConfig(), text: str = "text") -> DataFrame:
    """docs with `mentions` and their distinct `targets` in byte order by one join, whatever the size of the dictionary."""
    joined = joined_columns(docs.drop("mentions", "targets"), patterns, config, text)
    return joined.select("row.*", "mentions", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def joined_columns(docs: DataFrame, patterns: DataFrame, config: MatchConfig, text: str) -> DataFrame:
    """(row, mentions, targets) by the join; targets are null where there are no mentions."""
    refuse_stream(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.md5(text).alias("key"))
    found = joined_places(rows.select("key", "text"), patterns, config).withColumnRenamed("key", "of")
    placed = rows.join(found, F.col("key") == F.col("of"), "left")
    return placed.select("row", located(config.normalize)("text", "found").alias("mentions"), "targets")


def exploded(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, token_num and the fields of a mention) of rows (id, mentions). An inner explode would have the optimizer ask beforehand
    whether a list is empty, and find the mentions twice for it."""
    each = docs.select(id_col, F.posexplode_outer("mentions").alias("token_num", "m")).filter("m is not null")
    return each.select(id_col, "token_num", "m.*")


def filter_made(docs: DataFrame, condition: Column) -> DataFrame:
    """docs.filter(condition), on columns as they were made: the optimizer would push it below them and make them twice; it doesn't
    where a random number is among them."""
    number = "_made"
    while number in map(str.lower, docs.columns):
        number = f"_{number}"
    return docs.withColumn(number, F.rand(0)).filter(condition & (F.col(number) >= 0)).drop(number)


def mentions(docs: DataFrame, patterns: DataFrame, config: MatchConfig = MatchConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, token_num and the fields of a mention): one row per mention. token_num: 0, 1, ... by end and then
    longest first. The strategy follows the size of the dictionary."""
    return exploded(with_mentions(docs.select(id_col, text), patterns, config, text), id_col)


def joined_mentions(docs: DataFrame, patterns: DataFrame, config: MatchConfig = MatchConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of mentions by the join, whatever the size of the dictionary."""
    return exploded(with_mentions(docs.select(id_col, text), patterns, config, text, small=False), id_col)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * FACTOR
    return x ^ (x >> np.uint32(15))


def stem_hashes(points: np.ndarray, sizes) -> dict[int, np.ndarray]:
    """For each of these STEMS the hashes of so many characters from each place on, where there are so many."""
    h, n, out, largest = mixed(points + np.uint32(1)), 1, {}, max(sizes, default=1)
    while len(h):
        if n in sizes:
            out[n] = h
        if n >= largest:
            break
        h, n = mixed(h[:-n] * STEP + h[n:]), 2 * n
    return out


def whole_hashes(first: np.ndarray, last: np.ndarray, size) -> np.ndarray:
    """Hashes of names by those of their first and last characters and their sizes."""
    return mixed(first * STEP + mixed(last + size))


def stem_of(size: int) -> int:
    return max(n for n in STEMS if n <= size)


def name_bits(n_bits: int):
    """A column function from a name to its bits in a filter of 2 ** n_bits: those of its stem and of the whole."""

    @F.arrow_udf("array<long>")
    def bits(names):
        import pyarrow as pa

        names = names.to_pylist()
        size = np.array([len(n) for n in names], np.int64)
        stem, end = np.array([stem_of(n) for n in size.tolist()], np.int64), np.cumsum(size)
        keys = np.empty((len(names), 2), np.uint32)
        for n, h in stem_hashes(points("".join(names)), set(stem.tolist())).items():
            of = stem == n
            first, last = h[(end - size)[of]], h[end[of] - n]
            keys[of, 0], keys[of, 1] = first, whole_hashes(first, last, size[of].astype(np.uint32))
        flat = np.concatenate([(keys * p) >> np.uint32(32 - n_bits) for p in PROBES], 1).astype(np.int64)
        return pa.ListArray.from_arrays(np.arange(len(names) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))

    return bits


def filter_of(names: DataFrame, n_bits: int) -> np.ndarray:
    """The filter as bytes, put together from words of 64 bits: names are not collected."""
    bit = names.select(F.explode(name_bits(n_bits)("norm_name")).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(max(1, 2**n_bits // 64), "<i8")
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def table_of(bits: np.ndarray) -> np.ndarray:
    """A small filter as one truth value for each bit; else the filter."""
    return np.unpackbits(bits, bitorder="little").view(bool) if len(bits) * 8 <= UNPACKED else bits


def passing(table: np.ndarray, n_bits: int, keys: np.ndarray) -> np.ndarray:
    """Which of the keys have all their bits in the filter."""
    left = None
    for p in PROBES:
        bit = (keys * p) >> np.uint32(32 - n_bits)
        hit = np.flatnonzero(table.take(bit) if table.dtype == bool else (table.take(bit >> np.uint32(3)) >> (bit & np.uint32(7)).astype(np.uint8)) & np.uint8(1))
        left, keys = hit if left is None else left[hit], keys[hit]
    return left


def likely(text: np.ndarray, ends: np.ndarray, table: np.ndarray, n_bits: int, sizes: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the places where a name may stand; none is missed. text: code points of texts that end at ends; sizes: those of names,
    by stem."""
    starts, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    longest = max(max(x) for x in sizes.values())
    step = max(WINDOW, longest)
    for begin in range(0, len(text), step):
        window = text[begin : begin + step + longest - 1]
        for n, h in stem_hashes(window, sizes).items():
            at = passing(table, n_bits, h[:step])
            room = ends[np.searchsorted(ends, at + begin, "right")] - begin - at
            for size in sizes[n]:
                fit = at[room >= size]
                fit = fit[passing(table, n_bits, whole_hashes(h[fit], h[fit + (size - n)], np.uint32(size)))]
                starts.append(fit + begin)
                lengths.append(np.full(len(fit), size))
    return np.concatenate(starts), np.concatenate(lengths)


def likely_names(bits: np.ndarray, n_bits: int, sizes: dict[int, list[int]], how: str):
    """A column function from a text to what may be a name in it, each with its normalized starts."""

    def together(texts):
        """Runs of texts of TOGETHER characters in all, or one that is longer."""
        run, held = [], 0
        for text in texts:
            text = text.as_py()
            run.append(fold(text, how) if text else "")
            held += len(run[-1])
            if held >= TOGETHER:
                yield run
                run, held = [], 0
        if run:
            yield run

    @F.arrow_udf("array<struct<name:string,starts:array<int>>>")
    def find(texts):
        import pyarrow as pa

        rows, names, lists, places, table = [0], [], [0], [], table_of(bits)
        for run in together(texts):
            ends = np.cumsum([len(t) for t in run], dtype=np.int64)
            at, size = likely(points("".join(run)), ends, table, n_bits, sizes)
            of = np.searchsorted(ends, at, "right")
            order = np.lexsort((at, of))
            at = at - np.concatenate(([0], ends))[of]
            cuts = np.searchsorted(of[order], np.arange(len(run) + 1))
            at, size = at[order].tolist(), size[order].tolist()
            for i, text in enumerate(run):
                found = {}
                for x in range(cuts[i], cuts[i + 1]):
                    found.setdefault(text[at[x] : at[x] + size[x]], []).append(at[x])
                for name, starts in found.items():
                    names.append(name)
                    places += starts
                    lists.append(len(places))
                rows.append(len(names))
        starts = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(places, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), starts], ["name", "starts"]))

    return find


def joined_places(texts: DataFrame, patterns: DataFrame, config: MatchConfig) -> DataFrame:
    """(key, found, targets): normalized places of the names in texts (key, text), in order, and the distinct targets of these
    names (null if patterns have none), for dictionaries of any size.

    A filter of bits lets a place of a text through if its first 32, 16, 8, 4, 2 or 1 characters are those of a name of that stem, and
    then each size of name at which first and last characters together are those of a name; a few others pass by chance. What
    stands at these places is joined with the names, so that only names are left.
    """
    patterns = patterns.filter("norm_name <> ''")
    known = patterns.withColumn("target_ids", F.lit(None).cast("array<string>")) if "target_ids" not in patterns.columns else patterns
    known = known.select("pattern_id", F.col("norm_name").alias("name"), "target_ids")
    counts = {r[0]: r[1] for r in patterns.groupBy(F.length("norm_name")).count().collect()}  # as many rows as sizes of names
    if not counts:
        return texts.select("key", F.array().cast("array<struct<norm_end:int,less:int,pattern_id:int,norm_start:int>>").alias("found"), F.array().cast("array<string>").alias("targets")).limit(0)
    sizes = {n: sorted(x for x in counts if stem_of(x) == n) for n in {stem_of(x) for x in counts}}
    parts = -(-sum(counts.values()) // FILTER_NAMES)
    n_bits = max(10, (FILTER_BITS * -(-sum(counts.values()) // parts) - 1).bit_length())
    seen = None
    for part in range(parts):
        names = patterns.filter(F.pmod(F.xxhash64("norm_name"), F.lit(parts)) == part) if parts > 1 else patterns
        each = texts.filter("text <> ''").select("key", likely_names(filter_of(names, n_bits), n_bits, sizes, config.normalize)("text").alias("likely"))
        # Equal texts have equal places: one list of them is kept.
        each = each.groupBy("key").agg(F.first("likely").alias("likely")).select("key", F.explode("likely").alias("m"))
        seen = each if seen is None else seen.union(each)
    # Merged: the planner takes exploded rows for few and could broadcast them.
    met = seen.select("key", "m.name", "m.starts").distinct() if parts > 1 else seen.select("key", "m.name", "m.starts")
    met = met.hint("merge").join(known, "name")
    size = F.length("name")
    places = F.transform("starts", lambda x: F.struct((x + size).alias("norm_end"), (-size).alias("less"), "pattern_id", x.alias("norm_start")))
    out = met.select("key", places.alias("places"), "target_ids").groupBy("key").agg(F.collect_list("places").alias("places"), F.collect_set("target_ids").alias("t"))
    targets = F.filter(F.sort_array(F.array_distinct(F.flatten("t"))), lambda t: t.isNotNull())
    return out.select("key", F.sort_array(F.flatten("places")).alias("found"), targets.alias("targets"))


def located(how: str):
    """A column function from a text and its normalized places (null: none) to its mentions."""

    @F.arrow_udf(MENTIONS)
    def place(texts, found):
        places = ([np.array([r[k] for r in rows or ()], np.int64) for k in ("pattern_id", "norm_start", "norm_end")] for rows in found.to_pylist())
        return listed(((text, *three) for text, three in zip(texts.to_pylist(), places, strict=True)), how)

    return place


def events(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document and end position, with its longest pattern and the number of patterns that end there."""
    return found.groupBy(id_col, "norm_end").agg(F.max_by("pattern_id", F.col("norm_end") - F.col("norm_start")).alias("pattern_id"), F.count("*").alias("match_num"))


def has_mention(patterns: DataFrame, config: MatchConfig, text: str = "text") -> Column | None:
    """Whether a row has a mention, as a column if the dictionary is small; else None."""
    return any_matcher(collected(patterns), config.normalize)(F.col(text)) if fits(patterns, config) else None


def keep_documents(docs: DataFrame, patterns: DataFrame, config: MatchConfig = MatchConfig(), text: str = "text") -> DataFrame:
    """The documents with a mention, or, negated, those without. A small dictionary's search of a text ends at the first
    mention; a larger one is joined, and the rows of docs semi- or anti-joined on the hash of their text."""
    some = has_mention(patterns, config, text)
    if some is not None:
        return docs.filter(~some if config.negate else some)
    refuse_stream(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.md5(text).alias("key"))
    found = joined_places(rows.select("key", "text"), patterns, config).select(F.col("key").alias("of"))
    return rows.join(found, F.col("key") == F.col("of"), "left_anti" if config.negate else "left_semi").select("row.*")


def best_text(docs: DataFrame, config: MatchConfig, columns: dict[str, str] | None = None) -> DataFrame:
    """docs with text and content_form."""
    text, form = best_content(config.text_source, columns)
    return docs.withColumns({"text": text, "content_form": form})
