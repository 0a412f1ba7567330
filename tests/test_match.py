import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.functions.normalize import fold
from lexispark.operators import annotate, match, names, token_match
from lexispark.plans.config import MatchConfig
from lexispark.plans.job import matched, run
from lexispark.plans.sql import register


def names_df(spark, rows):
    return spark.createDataFrame(rows, "name string, target_id string")


def docs_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, texts, rows, **config):
    c = MatchConfig(**config)
    p = names.prepare(names_df(spark, rows), c)
    return match.mentions(docs_df(spark, texts), p, c).orderBy("doc_id", "token_num").collect()


@given(st.text("ab", max_size=30), st.lists(st.text("ab", min_size=1, max_size=4), min_size=1, max_size=6, unique=True))
@settings(max_examples=200)
def test_automaton_equals_naive_search(text, words):
    import numpy as np

    lengths = np.array([len(w) for w in words])
    got = match.hits(match.automaton("\0".join(words), tuple(words)), text, lengths)
    want = sorted((i + len(w), -len(w), k) for k, w in enumerate(words) for i in range(len(text) - len(w) + 1) if text.startswith(w, i))
    assert list(map(tuple, got)) == want


def test_overlaps_nesting_and_ends(spark):
    rows = found(spark, ["aaaa", "xMara Quilly", "say José", None, ""], [("aa", "t"), ("aaa", "t"), ("mara quill", "u"), ("José", "v")], min_bytes=2)
    assert [(r.doc_id, r.norm_start, r.norm_end) for r in rows if r.doc_id == 0] == [(0, 0, 2), (0, 0, 3), (0, 1, 3), (0, 1, 4), (0, 2, 4)]
    assert [r.value for r in rows if r.doc_id == 1] == ["Mara Quill"]
    last = [r for r in rows if r.doc_id == 2]
    assert [(r.value, r.start_char, r.end_char, r.start_byte, r.end_byte) for r in last] == [("José", 4, 9, 4, 10)]


def test_length_is_counted_after_normalization(spark):
    assert not found(spark, ["abcdé"], [("abcdé", "t")], min_bytes=6)
    assert len(found(spark, ["abcdé"], [("abcdé", "t")], min_bytes=5)) == 1


def test_duplicate_policies(spark):
    rows = [("José Pérez", "t1"), ("Jose Perez", "t2")]
    first, union = (names.prepare(names_df(spark, rows), MatchConfig(duplicates=p)).collect() for p in ("first", "union"))
    assert [(r.name, r.target_ids) for r in first] == [("Jose Perez", ["t2"])]
    assert [r.target_ids for r in union] == [["t1", "t2"]]


MODES = ("unicode", "ascii", "none")


def by_force(texts, pats, how):
    """Every place of every name, found one position at a time."""
    out = []
    for i, text in enumerate(texts):
        norm = fold(text or "", how)
        out += [(i, n, s, s + len(n)) for n in pats for s in range(len(norm) - len(n) + 1) if norm.startswith(n, s)]
    return sorted(out)


@pytest.mark.parametrize("how", MODES)
def test_join_equals_automaton_equals_brute_force(spark, how):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aáBb.  c\nß\U0001d41aﬁ") for _ in range(rng.randrange(0, 900))) for _ in range(12)] + ["", None, "b" * 700]
    words = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(2, 6))) for _ in range(25)} | {"b" * 40, "a" * 33, "ab" * 9, "fi"})
    docs = spark.createDataFrame([(None if i % 4 == 0 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    small, big = (MatchConfig(min_bytes=2, normalize=how, max_broadcast=n) for n in (1 << 20, 0))
    p = names.prepare(names_df(spark, [(w, f"t{i % 7}") for i, w in enumerate(words)]), small).cache()
    known = {r.pattern_id: r.norm_name for r in p.collect()}
    assert sorted(known) == list(range(len(known))) and sorted(known.values()) == [known[i] for i in range(len(known))]
    every = ("token_num", "pattern_id", "norm_start", "norm_end", "start_byte", "end_byte", "start_char", "end_char", "value")
    key = lambda df: sorted((tuple(r) for r in df.select("doc_id", *every).collect()), key=str)
    a, b = key(match.mentions(docs, p, small)), key(match.mentions(docs, p, big))
    assert a == b == key(match.joined_mentions(docs, p, small)) and len(a) > 200
    whole = match.with_mentions(docs_df(spark, texts), p, small).collect()
    assert sorted((r.doc_id, known[m.pattern_id], m.norm_start, m.norm_end) for r in whole for m in r.mentions) == by_force(texts, list(known.values()), how)
    for r in whole:
        for m in r.mentions:
            assert m.value == r.text[m.start_char : m.end_char] and m.value.encode() == r.text.encode()[m.start_byte : m.end_byte]
            assert fold(m.value, how).strip(" ") == known[m.pattern_id].strip(" ") or how == "unicode" and "ﬁ" in r.text
    targets = lambda c: sorted(((r.doc_id, r.text, r.targets) for r in annotate.with_targets(match.with_mentions(docs, p, c), p, c).collect()), key=str)
    assert targets(small) == targets(big)
    for negate in (False, True):
        kept = [sorted(map(str, match.keep_documents(docs, p, MatchConfig(min_bytes=2, normalize=how, negate=negate, max_broadcast=n)).collect())) for n in (0, 1 << 20)]
        assert kept[0] == kept[1] and 0 < len(kept[0]) < len(texts)
    p.unpersist()


def test_ascii_offsets(spark):
    for size in (0, 1 << 20):
        rows = found(spark, ["M...   MARA   QUILL x"], [("mara quill", "t")], normalize="ascii", max_broadcast=size)
        assert [(r.start_char, r.end_char, r.value) for r in rows] == [(7, 19, "MARA   QUILL")]


def test_join_keeps_mentions_of_null_ids(spark):
    p = names.prepare(names_df(spark, [("abc", "t")]), MatchConfig(min_bytes=2))
    docs = spark.createDataFrame([(None, "x abc"), (None, "abc abc"), (1, "abc")], "doc_id long, text string")
    found = match.joined_mentions(docs, p, MatchConfig(min_bytes=2)).select("doc_id", "token_num", "norm_start").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(None, 0, 2), (None, 0, 0), (None, 1, 4), (1, 0, 0)], key=str)


def test_large_dictionary_is_joined(spark):
    """A hundred thousand names that are never collected; streams refuse them."""
    made = spark.range(100_000).selectExpr("concat('name ', lpad(id, 6, '0')) AS name", "cast(id AS string) AS target_id")
    c = MatchConfig(max_broadcast=1000)
    p = names.prepare(made, c).cache()
    texts = ["x Name  004711 y", "nothing", "name 000000 and name 0999991", "name 100000"]
    got = sorted((r.doc_id, r.pattern_id, r.value) for r in match.mentions(docs_df(spark, texts), p, c).collect())
    assert got == [(0, 4711, "Name  004711"), (2, 0, "name 000000"), (2, 99999, "name 099999")]
    assert [r.targets for r in matched(docs_df(spark, texts), p, c, {"clean_visible": "text"}).orderBy("doc_id").collect()] == [["4711"], [], ["0", "99999"], []]
    p.unpersist()
    stream = spark.readStream.format("rate").load().selectExpr("value AS doc_id", "'name 000001' AS text")
    for call in (lambda: match.with_mentions(stream, p, c), lambda: match.keep_documents(stream, p, c), lambda: annotate.with_targets(stream.withColumn("mentions", F.array().cast(match.MENTIONS)), p, c)):
        with pytest.raises(ValueError, match="stream"):
            call()
    with pytest.raises(ValueError):
        register(spark, p, c)


def rows_made(plan):
    """(operator, rows that it made) of a plan that ran, stages of adaptive execution included."""
    kind = plan.getClass().getSimpleName()
    metric = plan.metrics().get("numOutputRows")
    yield plan.nodeName(), metric.get().value() if metric.isDefined() else 0
    if kind == "AdaptiveSparkPlanExec":
        yield from rows_made(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from rows_made(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from rows_made(children.apply(i))


def test_join_makes_rows_of_likely_names_only(spark):
    """Not one for each character; and a text is searched once for mentions and targets."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(500)) for _ in range(20)]
    c = MatchConfig(max_broadcast=0)
    p = names.prepare(names_df(spark, [(f"{a} {b}", f"t{i % 9}") for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]), c).cache()
    got = matched(docs_df(spark, texts), p, c, {"clean_visible": "text"}).select("doc_id", "mentions", "targets")
    rows = got.collect()
    n_found, n_chars = sum(len(r.mentions) for r in rows), sum(map(len, texts))
    exploded = [n for name, n in rows_made(got._jdf.queryExecution().executedPlan()) if name == "Generate"]
    assert n_found > 20 and exploded and sum(exploded) < 2 * n_found + n_chars // 200
    small = matched(docs_df(spark, texts), p, MatchConfig(), {"clean_visible": "text"}).select("doc_id", "mentions", "targets")
    assert sorted(rows) == sorted(small.collect())
    p.unpersist()


@pytest.mark.parametrize("unpacked", [0, 1 << 20])
@pytest.mark.parametrize("window", [1, 1 << 17])
def test_filter_misses_no_name(monkeypatch, unpacked, window):
    import numpy as np

    from lexispark.functions.normalize import points

    monkeypatch.setattr(match, "UNPACKED", unpacked)
    monkeypatch.setattr(match, "WINDOW", window)
    rng = random.Random(window)
    words = sorted({"".join(rng.choice("ab\U0001d41a ") for _ in range(rng.choice((1, 2, 3, 4, 7, 8, 15, 33, 70)))) for _ in range(40)})
    texts = ["".join(rng.choice(["a", "b", " ", *words]) for _ in range(rng.randrange(20))) for _ in range(60)]
    n_bits, bits, sizes = 11, np.zeros(256, np.uint8), {}
    for w in words:
        n = match.stem_of(len(w))
        sizes[n] = sorted({*sizes.get(n, []), len(w)})
        h = match.stem_hashes(points(w), (n,))[n]
        for key in (h[:1], match.whole_hashes(h[:1], h[-1:], np.uint32(len(w)))):
            for probe in match.PROBES:
                bit = int((key * probe)[0] >> np.uint32(32 - n_bits))
                bits[bit >> 3] |= 1 << (bit & 7)
    ends = np.cumsum([len(t) for t in texts])
    starts, lengths = match.likely(points("".join(texts)), ends, match.table_of(bits), n_bits, sizes)
    got = set(zip(starts.tolist(), lengths.tolist(), strict=True))
    want = {(int(end) - len(t) + s, len(w)) for t, end in zip(texts, ends, strict=True) for w in words for s in range(len(t)) if t.startswith(w, s)}
    assert len(got) == len(starts) and want <= got and len(want) > 500
    assert all(np.searchsorted(ends, s, "right") == np.searchsorted(ends, s + n - 1, "right") for s, n in got)


def test_names_of_several_filters(spark, monkeypatch):
    """Names that need a filter each, and others that pass by chance in the filters of others."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(2, 12))).strip() for _ in range(300)} - {"", "a", "b", "c"})
    docs = docs_df(spark, ["".join(rng.choice("abc ") for _ in range(300)) for _ in range(10)] + ["", None])
    small, big = MatchConfig(min_bytes=2), MatchConfig(min_bytes=2, max_broadcast=0)
    p = names.prepare(names_df(spark, [(w, "t") for w in words]), small).cache()
    want = sorted(match.mentions(docs, p, small).collect())
    monkeypatch.setattr(match, "FILTER_NAMES", 100)
    monkeypatch.setattr(match, "FILTER_BITS", 1)
    assert p.count() > 200 and len(want) > 1000 and sorted(match.mentions(docs, p, big).collect()) == want
    assert match.keep_documents(docs, p, big).count() == 10
    p.unpersist()


def naive(texts, name_targets):
    """(processed, written, mentions, ratings, events) by searching each name at each place."""
    pats = {}
    for n, t in sorted(name_targets):
        pats.setdefault(fold(n), {}).setdefault(n, []).append(t)
    pats = {k: v[min(v)] for k, v in pats.items() if len(k.encode()) >= 3}
    hits = [[(s + len(n), n) for n in pats for s in range(len(t)) if t.startswith(n, s)] for t in map(fold, texts)]
    return len(texts), sum(map(bool, hits)), sum(map(len, hits)), sum(len({t for _, n in h for t in pats[n]}) for h in hits), sum(len({e for e, _ in h}) for h in hits)


def golden():
    """664 names, some alike but for accents, case or blanks, some within others and four with two targets, each between
    runs of a filler that is glued to its end; 20 blank documents."""
    rng = random.Random(7)
    first = [a + b for a in ("Jo", "An", "Ør", "Mi", "Bo", "Li", "Ka", "Sé", "Ti", "Vø") for b in ("sé", "na", "re", "ël", "x", "wen", "Lu", "dá", "k", "rin")]
    last = ["Pérez", "Quill", "van Dam", "Ek", "Øst", "Brücke", "Li"]
    surfaces = [f"{a} {b}" for a in first for b in last][:600]
    surfaces += [s.replace("é", "e").replace("ü", "u").upper() for s in surfaces if "é" in s or "ü" in s]
    surfaces = [*dict.fromkeys(surfaces)][:650] + ["KDX", "Ann\u00a0Ek", "Bo  Li", "van Dam", "Brücke", "Pérez", "Quill", "Jo", "Ør", "Ann Ekman", "Mia Pérezlind", "É k", "Lu", "xi quill"]
    targets = [(s, f"t{i // 2}") for i, s in enumerate(surfaces)] + [(surfaces[i], "other") for i in (3, 90, 300, 500)]
    texts = ["pad " * rng.randrange(1, 11) + s + "pad " * rng.randrange(1, 11) + "\n" for s in surfaces] + ["\n"] * 20
    return texts, targets


def test_golden_counts(spark):
    texts, rows = golden()
    assert len(texts) == 684 and len({n for n, _ in rows}) == 664
    c = MatchConfig(min_bytes=3)
    p = names.prepare(names_df(spark, rows), c).cache()
    full = annotate.with_targets(match.with_mentions(docs_df(spark, texts), p, c), p)
    s = annotate.summary(full, c).first()
    events = match.events(match.mentions(docs_df(spark, texts), p, c)).count()
    want = naive(texts, rows)
    assert (s.processed, s.written, s.mentions, s.ratings, events) == want
    assert 660 <= s.written <= 664 and s.mentions > events > 664 and s.ratings > 664 and p.count() < 664
    assert annotate.summary(full.limit(0), c).first().ratings_per_written is None
    p.unpersist()


def test_run_keeps_negates_and_blanks(spark):
    texts, rows = golden()
    texts, rows = texts[:600:20] + texts[-5:], rows[:600:20]
    p = names.prepare(names_df(spark, rows), MatchConfig(min_bytes=3)).cache()
    own = ("text", "content_form", "mentions", "targets", "row", "kept", "source_raw")
    docs = docs_df(spark, texts).withColumnRenamed("text", "clean_visible").selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in own])
    n_kept = naive(texts, rows)[1]
    for size in (0, 1 << 20):
        go = lambda **k: run(docs, p, MatchConfig(min_bytes=3, max_broadcast=size, **k), {"clean_visible": "clean_visible"}).collect()  # noqa: E731, B023
        assert len(go()) == n_kept and len(go(negate=True)) == len(texts) - n_kept
        blanked = go(emit_empties=True)
        assert len(blanked) == len(texts) and sum(r.clean_visible == "" for r in blanked) == len(texts) - n_kept
        assert len(go(max_items=10)) == naive(texts[:10], rows)[1] and len(go(max_items=0)) == 0
        for row in go():
            assert all(row[c] == f"{c}{row.doc_id}" for c in own)
            assert row.ratings["lexispark"][0].target.target_id and set(row.sentences["lexispark"][0].tokens[0].offsets) == {"BYTES", "CHARS"}
    p.unpersist()


#: Double blanks, a line end and a tab, a wide blank, glued endings, a missing blank; names of one to three tokens.
TEXTS = [
    "Mara  Quill was here, twice blanked.",
    "M. Quill would need the full stop in its name\n",
    "M Quillfeather is longer, M Quillson too.\n",
    "split over lines: Mara\n\n\tQuill, who stays one name\n",
    "a wide blank: Mara\u205fQuill\n",
    "glued: Mara Quillson. missing blank: MaraQuill\n",
    "M M Quill, M Quill Quill and Mara Mara Quill",
    "",
]
NAMES = [r"Mara\WQuill\Wson", r"Mara\WQuillson", r"M\WQuill\Wson", r"M\WQuillson", r"M\WQuill", r"Mara\WQuill", "Mara", r"Quill\WQuill", "Quill, M"]


def tokens_by_force(names, text, boundary, compat):
    """The rules of the token matcher, one character at a time."""
    out = []
    for number, name in enumerate(names):
        tokens, k, first, limit = name.split("\\W"), 0, 0, -1
        for p, c in enumerate(text):
            starts = c not in boundary and (p == 0 or text[p - 1] in boundary)
            if not starts or p <= limit:
                continue
            if k and not text.startswith(tokens[k], p):
                k = 0
                if compat:
                    continue
            if text.startswith(tokens[k], p):
                first = p if k == 0 else first
                limit = p + len(tokens[k])
                k += 1
                if k == len(tokens):
                    out.append((number, first, limit))
                    k = 0
    return out


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("boundary", [token_match.BOUNDARY, token_match.UNICODE_BOUNDARY])
def test_token_matcher_equals_brute_force(boundary, compat):
    rng = random.Random(31)
    texts = TEXTS + ["".join(rng.choice(("a", "b", "ab", " ", "  ", "\n", "c")) for _ in range(rng.randrange(60))) for _ in range(200)]
    names = [*NAMES, *["\\W".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))) for _ in range(20)], "a b"]
    matcher = token_match.TokenMatcher(names, boundary, compat)
    found = 0
    for t in texts:
        want = tokens_by_force(names, t, boundary, compat)
        assert matcher.find(t) == want
        found += len(want)
    assert found > 500


def test_labels_are_appended(spark):
    docs = spark.createDataFrame([(1, "x Mara Quill Mara Quill", "l"), (2, "none", "l"), (3, None, "l")], "doc_id long, text string, row string")
    names_ = names_df(spark, [(r"Mara\WQuill", "t2"), (r"Mara\WQuill", "t1"), ("none", "t3")])
    once_ = token_match.with_labels(docs, names_, "me")
    rows = {r.doc_id: r for r in token_match.with_labels(once_, names_, "me").collect()}
    assert [(x.target.target_id, x.first, x.length) for x in rows[1].labels["me"]] == 2 * [("t1", 2, 10), ("t2", 2, 10), ("t1", 13, 10), ("t2", 13, 10)]
    assert len(rows[1].ratings["me"]) == 8 and len(rows[2].ratings["me"]) == 2 and rows[3].labels is None and rows[1].row == "l"


def test_token_dictionary_is_checked(spark):
    with pytest.raises(ValueError):
        token_match.token_mentions(docs_df(spark, ["x"]).text, names_df(spark, [("abc", "t")]), most=2)


def test_token_matcher_rules(spark):
    find = lambda name, text, **k: [x[1:] for x in token_match.TokenMatcher([name], **k).find(text)]
    assert find(r"M\WQuill", "a M M Quill", compat=True) == []
    assert find(r"M\WQuill", "a M M Quill") == [(4, 11)]
    assert find("Dora Linde", "x Dora Linde and") == [(2, 12)] and find("Dora Linde", "x Dora  Linde") == []
    assert find("dora", "Dora") == []
    for bad in ([], [""], [r"a\W"]):
        with pytest.raises(ValueError):
            token_match.TokenMatcher(bad)
    rows = token_match.mentions(docs_df(spark, ["x Dora Linde", None]), names_df(spark, [("Dora Linde", "u1"), ("Dora Linde", "u2")]))
    assert token_match.labels(rows).count() == 2


def test_texts_with_odd_blanks_and_accents(spark):
    texts = ["\nMara  Quill is", "to Mara\n\tQuill, and", "a wide one: Mara\u205fQuill\n", "glued: Mara Quillson.\n", "xx Mâra   \t  \t\tQüill yy", "of a brøød, no", "full stop: M. Quill"]
    rows = found(spark, texts, [(n, "t") for n in ("m quill", "mara quill", "brøød")])
    assert [r.doc_id for r in rows] == list(range(6))
    assert all(fold(r.value) in ("mara quill", "brøød") for r in rows)


def test_config_is_checked():
    for bad in ({"text_source": "html"}, {"duplicates": "last"}, {"min_bytes": 0}, {"max_names": -1}, {"normalize": "nfc"}):
        with pytest.raises(ValueError):
            MatchConfig(**bad)
