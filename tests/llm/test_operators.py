"""The operators against brute force on small fixtures, with nulls, empty texts, ties, repeated rows, empty tables and odd columns."""

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexispark.llm import ann, chat, lines, mixing, passages, quality, sentencepiece, sharding, simhash, toxicity, urls
from lexispark.llm.common import Tables, components

WORDS = "the of and to in is that was for it with on are this by red green blue tree house river stone cloud bird table chair window door light dark sun moon star".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd(spark, rows):
    """Documents with an extra column of a clashing name and a null in any column."""
    return spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, size string")


def base(rng):
    rows = [(i, sentence(rng, rng.choice((1, 3, 30, 80))), rng.choice(("a", "b", "ü"))) for i in range(60)]
    rows += [(100 + i, rows[5][1], "a") for i in range(25)]  # a group of copies
    rows += [(200, None, "a"), (201, "", None), (None, "x y z", None), (203, " \t\n", "b"), (204, sentence(rng, 4000), "a")]
    return rows + [rows[3], rows[3]]


@pytest.fixture(scope="module")
def rows():
    return base(random.Random(2))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return odd(spark, rows)


def words(text):
    return (text or "").encode().split()


# 1


def test_sharding(spark, docs, rows):
    got = sharding.by_text(docs, 5).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(5)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    size = {i: len((t or "").encode()) + 16 for i, t, _ in rows}
    assert all(r["size"] == size[r.doc_id] for r in got)
    where = defaultdict(Counter)
    for r in got:
        where[r.text_crc32][r.shard] += 1
    assert sum(len(c) > 1 for c in where.values()) <= 2  # the large group needs two shards
    assert sorted(map(tuple, sharding.by_text(docs, 5).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert sharding.by_text(docs.limit(0), 5).count() == 0


def test_quotas_never_overfill():
    asked = np.array([[0, 9, 9], [0, 0, 9], [9, 0, 0]])
    share = sharding.quotas(asked, np.array([20.0, 20, 20]), np.array([22.0, 22, 22]))
    moved = asked * share
    assert (20 + moved.sum(0) - moved.sum(1) <= 22 + 1e-6).all() and (share <= 1).all()


# 2


def call(i, name, arguments, **more):
    return {"id": i, "name": name, "arguments": arguments, **more}


def test_tool_calls(spark):
    J = json.dumps
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", J({"content": "x", "tool_calls": [call("b", "fetch", J({"url": "u", "timeout": 1.5}), depends_on=["a"]), call("a", "search", {"query": "q", "limit": 3, "b": {"z": 1, "a": [{"y": 2, "x": None}]}})]})),
        (1, 2, "tool", J({"tool_call_id": "b", "content": {"k": 1}})),
        (1, 3, "tool", J({"tool_call_id": "a", "content": "res"})),
        (1, 4, "tool", J({"tool_call_id": "zz", "content": 1})),
        (1, 5, "assistant", J({"tool_calls": [call("c", "search", {"limit": "x"}), call("d", "nope", {}), call("e", "search", "[1"), call("a", "search", {"query": 2})]})),
        (2, 0, "assistant", J({"tool_calls": [call("p", "calculate", {"expression": "1"}, depends_on=["q"]), call("q", "calculate", {"expression": "1"}, depends_on=["p"])]})),
        (2, 1, "tool", J({"tool_call_id": "p", "content": 1})),
        (2, 2, "tool", J({"tool_call_id": "q", "content": 1})),
        (2, 3, "tool", J({"tool_call_id": "q", "content": 2})),
        (None, None, None, None),
        (3, 0, "user", ""),
        (3, 1, "user", "{not json"),
    ]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    state = {(r.conv_id, r.turn, r.call_id): (r.status, r.link) for r in got if r.kind != "message"}
    assert state[1, 1, "a"] == ("valid", "answered") and state[1, 1, "b"] == ("valid", "answered")
    assert state[1, 4, "zz"][1] == "orphan" and state[2, 3, "q"][1] == "duplicate"
    assert [state[1, 5, i] for i in "cdea"] == [("missing:query", "unanswered"), ("unknown_tool", "unanswered"), ("not_an_object", "unanswered"), ("wrong_type:query", "duplicate")]
    assert state[2, 0, "p"][1] == state[2, 0, "q"][1] == "cycle"
    order = [(r.kind, r.call_id) for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.level, r.turn, r.part))]
    places = [order.index(x) for x in (("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"))]
    assert places == sorted(places)
    for r in got:
        body = json.loads(r.json)
        assert r.json == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 3


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).collect()
    size, weight = Counter(), {}
    for _, t, s in rows:
        size[s] += len(words(t))
    for k, s in enumerate(sorted(size, key=lambda s: (s is None, s))):
        weight[s] = (5, 2, 1)[k % 3]
    left, open_, target = 1.5 * sum(size.values()), set(size), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source]
        rate = target[r.source] / size[r.source] if size[r.source] else 0
        assert int(rate) <= r.copies <= int(rate) + 1 and r.copies <= 2
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(5)).collect()}
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(1)
    big = spark.createDataFrame([(i, sentence(rng, rng.randrange(1, 40)), f"s{i % 4}") for i in range(8000)], "doc_id long, text string, source string")
    taken = {r.source: (r.taken, r.target) for r in mixing.mix(big).groupBy("source", "target").agg({"*": "count"}).select("source", "target").join(mixing.mix(big).selectExpr("source", "size * copies AS taken").groupBy("source").sum("taken").withColumnRenamed("sum(taken)", "taken"), "source").collect()}
    assert all(abs(a - b) < 0.06 * b for a, b in taken.values())


# 4


def fingerprint(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(ids, linked):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_equals_brute_force(spark, docs, rows):
    rows = [*rows, (300, rows[-3][1] + " end", "a")]
    fps = [fingerprint(t) for _, t, _ in rows]
    want = groups([r[0] for r in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    got = simhash.near_duplicates(odd(spark, rows)).collect()
    key = lambda x: sorted(x, key=str)
    assert key((r.doc_id, r.fp[0] % (1 << 64), r.component_id) for r in got) == key((r[0], f, c) for r, f, c in zip(rows, fps, want, strict=True))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("paired", "hot"), [(2, 64), (64, 64), (2, 3), (64, 2)])
def test_links_give_all_groups_in_small_and_crowded_buckets(spark, monkeypatch, paired, hot):
    for name, value in (("PAIRED", paired), ("HOT", hot), ("SAMPLED", 75 if hot < 64 else 20_000)):
        monkeypatch.setattr(simhash, name, value)
    rng, values = random.Random(paired), set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(25)}
    values = [simhash.signed(v) for v in values]
    fps = spark.createDataFrame([(v, [v]) for v in values], "node long, fp array<long>")
    tables = Tables(spark)
    comp = {r.node: r.comp for r in components(tables, simhash.links(tables, fps, 1, 4)).collect()}
    want = groups(values, lambda i, j: ((values[i] ^ values[j]) % (1 << 64)).bit_count() <= 4)
    assert [comp.get(v, v) for v in values] == want


def test_keep_one_catches_similar_texts(spark):
    rng = random.Random(9)
    texts, twin = [], {}
    for i in range(60):
        t = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(200)]
        texts.append((2 * i, " ".join(t)))
        if i % 2:
            t = t[:]
            for k in rng.sample(range(200), 2):
                t[k] = "other"
            twin[2 * i + 1] = 2 * i
            texts.append((2 * i + 1, " ".join(t)))
    docs = spark.createDataFrame([*texts, texts[0], (None, None), (900, ""), (901, None)], "doc_id long, text string")
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) and set(range(0, 120, 2)) <= set(kept)
    assert sum(t in kept for t in twin) == 0
    assert {900} == set(kept) - set(range(120))  # texts without words are one group


@pytest.mark.parametrize("hot", [64, 10_000])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, hot):
    """600 fingerprints in one bucket, counted in parts or not, 300 pairs that are near and share no other."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(12)
    rows = []
    for i in range(300):
        fp = [rng.getrandbits(64) for _ in range(8)]
        fp[0] = fp[0] >> 32 << 32 | 7
        twin = [x ^ 0b1110 << 32 ^ (0b1110 if k else 0) for k, x in enumerate(fp)]
        rows += [(2 * i, [simhash.signed(x) for x in fp] + [0] * 16), (2 * i + 1, [simhash.signed(x) for x in twin] + [0] * 16)]
    rng.shuffle(rows)
    tables = Tables(spark)
    fps = tables.keep(spark.createDataFrame(rows, "node long, fp array<long>"))
    got = {(r.a, r.b) for r in simhash.links(tables, fps, 8, 85).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(300)}


def test_keep_one_keeps_one_of_each_group_whatever_its_ids(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(60)) for _ in range(40)]
    rows = [(None, t) for t in texts[:30]] + [(5, t) for t in texts[30:36]] + [(None, texts[0]), (5, texts[30]), (7, texts[1]), (8, texts[36]), (9, texts[36])]
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(None, texts[0]), (7, texts[1]), *[(None, t) for t in texts[2:30]], *[(5, t) for t in texts[30:36]], (8, texts[36])]
    assert got == sorted(want, key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(500, 500)]
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    near = {frozenset(e) for e in edges}
    want = groups(nodes, lambda i, j: frozenset((nodes[i], nodes[j])) in near)
    got = {r.node: r.comp for r in components(Tables(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict(zip(nodes, want, strict=True))


# 5


def cut_by_force(docs, least):
    """Every line in a span of `least` words or more that equals a span that starts earlier."""
    out, first, spans = {}, {}, []
    for i, t in sorted(docs.items()):
        lines_ = t.split("\n")
        own = [(k, len(words(x))) for k, x in enumerate(lines_) if words(x)]
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += own[b][1]
                if n >= least:
                    spans.append((i, own[a][0], own[b][0], tuple(lines_[k] for k, _ in own[a : b + 1])))
    for i, a, _, s in spans:
        first[s] = min(first.get(s, (i, a)), (i, a))
    gone = defaultdict(set)
    for i, a, b, s in spans:
        if first[s] != (i, a):
            gone[i] |= set(range(a, b + 1))
    for i, t in docs.items():
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [sentence(rng, rng.randrange(1, 9)) for _ in range(12)] + ["", "  "]
    texts = {i: "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for i in range(60)}
    run = "\n".join(pool[:6])
    texts |= {70: "start\n" + run + "\nend", 71: run, 72: "x\n" + run + "\n" + run, 73: ""}
    docs = spark.createDataFrame([*texts.items(), (80, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup(docs, least=12).collect()}
    assert got.pop(80) is None and got == cut_by_force(texts, 12)


def test_line_dedup_edges(spark, docs, rows):
    out = lines.dedup(docs)
    assert out.columns == [*docs.columns, "cut_lines"] and out.count() == len(rows)
    assert lines.dedup(docs.limit(0)).count() == 0
    long = sentence(random.Random(3), 60)
    same = spark.createDataFrame([(1, long), (1, long), (2, long + "\n" + long), (2, "other\n" + long)], "doc_id long, text string")
    assert sorted(r.text for r in lines.dedup(same).collect()) == sorted(["", long, long, "other"])


def passages_by_force(docs, least):
    """Texts without the words of every window that equals one that starts earlier."""
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        w, gone = words(t), set()
        for k in range(len(w) - least + 1):
            window = tuple(w[k : k + least])
            if window in seen:
                gone |= set(range(k, k + least))
            seen.add(window)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_passages_within_lines_equal_brute_force(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = fresh(93)
    texts = {1: " ".join(fresh(300) + shared + fresh(400)), 2: " ".join(fresh(5)) + "\n" + " ".join(fresh(700) + shared + fresh(7)) + "\n" + " ".join(fresh(9))}
    texts |= {3: " ".join(fresh(40) + shared[:50] + fresh(20) + shared[43:] + fresh(3)), 4: " ".join(fresh(8) + shared[:49] + fresh(8)), 5: " ".join(shared), 6: " ".join(x := fresh(60)) + " and " + " ".join(x)}
    texts |= {i: " ".join(rng.choice("ab") for _ in range(rng.randrange(120))) for i in range(10, 30)} | {40: "", 41: " \n x  " + " ".join(shared) + "  y"}
    for least in (50, 12):
        docs = spark.createDataFrame([*texts.items(), (1, texts[1]), (50, None)], "doc_id long, text string")
        rows = passages.dedup(docs, least=least).collect()
        got = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(texts) + 2 and got.pop(50) is None
        assert {i: words(t) for i, t in got.items()} == passages_by_force(texts, least)
        assert all(r.cut_words == len(words(texts.get(r.doc_id))) - len(words(r.text)) for r in rows)
    assert got[41] == " \n x  y" and got[5] == ""


def test_passages_have_few_marks(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    marks, twice = passages.window_marks(F.col("text"), 50)
    row = spark.createDataFrame([(text,)], "text string").select(marks.alias("marks"), twice.alias("twice")).first()
    assert len(row.marks) == 4951 and not row.twice and 150 < len(set(row.marks)) < 350


def test_pipeline_cuts_passages_within_lines(spark):
    import corpus_pipeline

    rng = random.Random(14)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = fresh(93)
    a, b, c = f"{fresh(60)} {shared} {fresh(60)}", fresh(70), fresh(80)
    docs = spark.createDataFrame([(1, a, 1), (2, f"{b} {shared}\n{c}", 1), (3, shared, 1)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: (a, len(a)), 2: (f"{b} \n{c}", len(b) + len(c) + 2)}


# 6


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [sentence(rng, rng.choice((0, 1, 7, 8, 9, 25, 120))) for _ in range(40)]
    texts += ["a b c d e f g h " * 4, ("one two three four five six seven eight nine ten " * 3) + "x", "a#b $ c\n\na#b $ c\nx\n \n", None, "", " \t", "\x0b\x0cx\r\r"]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, q int")).collect()}
    for i, t in enumerate(texts):
        w, q = words(t), got[i].q
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines_ = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in quality.SYMBOLS for c in t or ""), len(lines_) - len(set(lines_)), len(cover))
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert got[i].base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert not (got[i].base_failed and got[i].kept)
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 7


def test_ann_small_tables_are_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype("float32")
    x[40:60] = x[40]  # equal vectors
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(300, None, 1), (301, [0.0] * 8, 1), (302, [1.0, None] + [0.0] * 6, 1), (303, [float("nan")] * 8, 1), (304, [1.0], 1), (305, [], 1), (None, [1.0] * 8, 1), (20, x[20].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in ann.search(df, lambda i: i % 20 == 0, k=20, recall=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d = x.astype(float)
    assert set(got) == set(range(0, 300, 20))
    hit = 0
    for q, found in got.items():
        s = (d * d[q]).sum(1)
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        hit += len({i for i, _ in found} & set(want))
        assert all(abs(s[i] - v) < 1e-12 for i, v in found) and [v for _, v in found] == sorted((v for _, v in found), reverse=True)
    assert hit >= 0.97 * 20 * len(got)
    assert ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = ann.search(df.filter("vec_id < 4"), lambda i: i % 2 == 0).collect()
    assert Counter(r.query_id for r in few) == {0: 3, 2: 3}


def test_walk_visits_all_cells_in_order():
    rng = np.random.default_rng(1)
    first, second, q = rng.normal(size=(5, 3)), rng.normal(size=(4, 2)), rng.normal(size=5)
    cells = [c for c, _ in ann.walk(q, first, second, np.ones(20, int), np.inf)]
    dist = [-(first[c // 4] @ q[:3]) - second[c % 4] @ q[3:] for c in cells]
    assert sorted(cells) == list(range(20)) and dist == sorted(dist)


# 8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_codec_equals_the_library():
    from sentencepiece import SentencePieceProcessor

    with open(MODEL, "rb") as f:
        codec = sentencepiece.Codec(f.read(), cache=500)
    library, rng = SentencePieceProcessor(model_file=MODEL), random.Random(6)
    texts = ["", " ", "  Hello  world\n\tx 日本 ﬁ ½ \x01 😀  ", "a" * 500, "ab" * 400, "=" * 40 + "!" * 9, "internationalization"]
    texts += ["".join(rng.choice(("in", "er", "ing", "th", "t", "a", " ", "é", "=", ".", "1", "ation")) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    for t, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode(t) and codec.decode(ids) == t
    assert codec.encode(None).tolist() == []


def test_streaming_commits_early_and_equals_whole_words():
    with open(MODEL, "rb") as f:
        codec = sentencepiece.Codec(f.read())
    text = "▁" + "thingnation" * 300
    runs = list(codec.stream(text))
    assert len(runs) > 5 and sum(runs, []) == codec.path([("", 0.0), *((lambda b: [b.append(codec.edge(text, i, b, 0)) for i in range(1, len(text) + 1)] and b)([("", 0.0)]))[1:]], len(text))


def test_encode_and_decode_columns(spark, docs, rows):
    with open(MODEL, "rb") as f:
        model = f.read()
    both = sentencepiece.decode(sentencepiece.encode(docs, model), model, text="back").collect()
    assert len(both) == len(rows) and all(r.back == (r.text or "") for r in both)
    assert sentencepiece.encode(docs.limit(0), model).count() == 0


# 9


def test_toxicity(spark, data):
    import pandas as pd

    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.train(docs, labels)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(None, None), (-1, ""), (-2, "a " * 5000)], "doc_id long, text string"))
    got = toxicity.score(more, model).toPandas()
    assert len(got) == docs.count() + 3 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    both = got.merge(pd.read_parquet(f"{data}/labels.parquet"), on="doc_id")
    assert both.score[both.toxic == 1].mean() > both.score[both.toxic == 0].mean() + 0.2
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert none.scores(["x", None]).tolist() == [0.0, 0.0]


def test_toxicity_holds_out(spark):
    """Accuracy on rows that the model has not seen, of made-up insults among clean words."""
    rng = random.Random(3)
    rows = [(i, sentence(rng, 30) + (" you " + rng.choice(("idiot", "zzgrub", "zzmolk")) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(800)]
    model = toxicity.fit([t for _, t, _ in rows[:600]], np.array([y for *_, y in rows[:600]]))
    score = model.scores([t for _, t, _ in rows[600:]])
    assert ((score >= 0.5) == np.array([y for *_, y in rows[600:]])).mean() > 0.97


@pytest.mark.parametrize("seed", range(30))
def test_isotonic_is_monotone(seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=rng.integers(5, 500)).round(1)
    at, rate = toxicity.isotonic(m, (rng.random(len(m)) < 1 / (1 + np.exp(-m))).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(rate) > 0).all() and (0 < rate).all() and (rate < 1).all()


# 10


def test_url_rules(spark):
    rows = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org", "ftp://x.com/fr/", "ftp://x.com/de/1", "http://notcom/fr/", "http://h.net?/a/b", "http://h.net/a#b", "no scheme", None, "", "http://x.org/#a"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(rows)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = [(r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, none).orderBy("page_id").collect()]
    assert got[:6] == [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "", None, "allow"), ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "/de/1", "com/de/", "block"), ("notcom", "/fr/", None, "allow")]
    assert got[6:] == [("h.net", "", None, "allow"), ("h.net", "/a", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("x.org", "/", "org/", "allow")]
    assert urls.judge(pages.limit(0), none).count() == 0


def test_reputation_shrinks(spark):
    rows = [("http://bad.spam.net/1", 1)] * 40 + [("http://one.spam.net/", 1)] + [("http://good.fine.net/", 0)] * 60 + [("http://new.fine.net/", 1)] + [("http://good.fine.net/", None)] * 3
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = urls.judge(pages, spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "page_id long, bad int")).collect()
    verdict = {r.host: (r.verdict, r.n_labelled, r.n_bad) for r in got}
    assert verdict["bad.spam.net"] == ("block", 40, 40) and verdict["good.fine.net"] == ("allow", 60, 0)
    assert verdict["new.fine.net"] == ("allow", 1, 1)  # one bad page of a good domain


def test_reputation_bound_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"http://h{rng.randrange(6)}.d{rng.randrange(4)}.{rng.choice(('net', 'co.uk', 'info'))}/", int(rng.random() < 0.4)) for _ in range(400)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.host: r.low for r in urls.judge(pages, spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "page_id long, bad int")).collect()}
    counts = defaultdict(lambda: [0, 0])
    for u, b in rows:
        h = u[7:-1]
        n = 2 if h.endswith(".co.uk") else 1
        parts = h.split(".")
        for path in (("",), ("", s := ".".join(parts[-n:])), ("", s, d := ".".join(parts[-n - 1 :])), ("", s, d, h)):
            counts[path][0] += 1
            counts[path][1] += b

    def strength(parent):
        kids = [counts[p] for p in counts if len(p) == len(parent) + 1 and p[: len(parent)] == parent]
        nn, bb, k = sum(n for n, _ in kids), sum(b for _, b in kids), len(kids)
        mean = bb / nn
        room, within = nn - sum(n * n for n, _ in kids) / nn - (k - 1), mean * (1 - mean)
        spread = sum(b * b / n for n, b in kids) - bb * mean
        r = max(0.0, (spread / within - (k - 1)) / room) if within > 0 and room > 0 else 0.0
        return min(max(1 / r - 1, 1.0), 1000.0) if r > 0 else 1000.0

    def mean_of(path):
        n, b = counts[path]
        if len(path) == 1:
            return b / n
        s = strength(path[:-1])
        return (b + s * mean_of(path[:-1])) / (n + s)

    for path, (n, b) in counts.items():
        if len(path) == 4:
            s, prior = strength(path[:3]), mean_of(path[:3])
            x, y = b + s * prior, n - b + s * (1 - prior)
            low = x / (x + y) - 1.645 * (x * y / ((x + y) ** 2 * (x + y + 1))) ** 0.5
            assert abs(got[path[3]] - low) < 1e-8


def test_equal_long_rules_go_by_code_point(spark):
    page = spark.createDataFrame([(1, "http://a.b/cdef", 1), (1, "http://a.b/cdef", 1)], "page_id long, url string, low int")
    rules = (("block", "b/cdef"), ("allow", "a.b/cd"))
    got = urls.judge(page, spark.createDataFrame([], "page_id long, bad int"), rules=rules).collect()
    assert [(r.rule, r.verdict) for r in got] == [("a.b/cd", "allow")] * 2


# All


CLASHING = "_id _th _t _row row id th text_ _w _l _h q base_failed kept cut_lines cut_words cuts _cuts cut_id size source_size target copies copy _copy _source of_source comp rank best_id best_th node fp _both both ids_ a.b mark span first".split()


def test_columns_of_any_name_keep_their_values(spark):
    import corpus_pipeline as p

    rng = random.Random(21)
    rows = [(i, sentence(rng, 60) + "\n" + sentence(rng, 40), "ab"[i % 2], *(f"{c}{i}" for c in CLASHING)) for i in range(12)] + [(None, None, None, *(None for _ in CLASHING))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *CLASHING])
    tail = {r[0]: tuple(r[3:]) for r in rows}
    with open(MODEL, "rb") as f:
        model = f.read()
    made = {"judge": ("q", "base_failed", "kept"), "dedup": ("cut_lines",), "passages": ("cut_words",), "mix": ("size", "source_size", "target", "copies")}
    for name, out in {
        "judge": quality.judge(docs), "keep": quality.keep(docs), "dedup": lines.dedup(docs), "passages": passages.dedup(docs), "keep_one": simhash.keep_one(docs), "mix": mixing.mix(docs),
        "emit": mixing.emit(docs), "encode": sentencepiece.encode(docs, model), "checked": sentencepiece.encode_checked(docs, model), **{k: f(spark, docs, "") for k, f in p.STAGES[:4]},
    }.items():
        got = out.collect()
        assert got, name
        same = [c for c in CLASHING if c not in made.get(name, ())]
        assert set(same) <= set(out.columns), name
        for r in got:
            assert [r[c] for c in same] == [tail[r.doc_id][CLASHING.index(c)] for c in same], name


def test_stages_take_empty_tables_and_null_rows(spark):
    import corpus_pipeline as p

    rng = random.Random(22)
    rows = [(None, None, None), (None, sentence(rng, 60), None), (1, "", "a"), (2, sentence(rng, 60), "a"), (2, sentence(rng, 60), "a"), (3, sentence(rng, 70), "b")]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, source string")
    sizes = {}
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
        sizes[name] = stage(spark, docs, "").count()
    assert sizes["quality_rules"] == 5 and sizes["line_dedup"] == 7 and sizes["simhash_near_dedup"] == 5 and sizes["sentencepiece_encoding"] == 7


# 1


def cut(rows, of):
    """Pairs of rows of equal texts in different shards."""
    by = defaultdict(Counter)
    for r in rows:
        by[r.text_crc32][of(r)] += 1
    return sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in by.values())


def test_sharding_cuts_few_edges(spark):
    rng = random.Random(23)
    texts = [sentence(rng, 12) for _ in range(120)]
    docs = spark.createDataFrame([(i, rng.choice(texts)) for i in range(1500)] + [(2000 + i, sentence(rng, 13)) for i in range(900)], "doc_id long, text string")
    got = sharding.by_text(docs, 8).collect()
    counts = Counter(r.shard for r in got)
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1
    start = {r.doc_id: r.s for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("s")).collect()}
    assert cut(got, lambda r: r.shard) < 0.1 * cut(got, lambda r: start[r.doc_id])


# 2


def chat_by_force(rows):
    """(place) -> (link, order_turn, level) of every call and result, by recursion."""
    items = []
    for n, (conv, turn, _, text) in enumerate(rows):
        body = json.loads(text)
        if "tool_call_id" in body:
            items.append({"conv": conv, "turn": turn, "n": n, "part": 0, "kind": "result", "id": body["tool_call_id"], "needs": []})
        for k, c in enumerate(body.get("tool_calls", [])):
            items.append({"conv": conv, "turn": turn, "n": n, "part": k + 1, "kind": "call", "id": c["id"], "needs": c.get("depends_on", [])})
    first = {}
    for x in sorted(items, key=lambda x: (x["turn"], x["part"], x["n"])):
        first.setdefault((x["conv"], x["kind"], x["id"]), x)
    waits = {}
    for x in items:
        own, other = first[x["conv"], x["kind"], x["id"]], first.get((x["conv"], "call" if x["kind"] == "result" else "result", x["id"]))
        if x["kind"] == "call":
            x["link"] = "duplicate" if own is not x else "answered" if other else "unanswered"
            asked = {(x["conv"], i) for i in x["needs"]} if own is x else set()
            waits[id(x)] = [first[c, "result", i] for c, i in asked if (c, "result", i) in first and (c, "call", i) in first]
        else:
            x["link"] = "orphan" if not other else "linked" if own is x else "duplicate"
            waits[id(x)] = [other] if other else []
    needed = {id(y) for w in waits.values() for y in w}
    place, busy = {}, set()

    def at(x):
        k = id(x)
        if k in busy:
            return None
        if k not in place:
            busy.add(k)
            known = [at(y) for y in waits[k]]
            busy.discard(k)
            if None in known:
                return None
            late = max(known, default=(x["turn"] - 1, 0))
            place[k] = (late[0], late[1] + 1) if waits[k] and late[0] >= x["turn"] else (x["turn"], 0)
        return place[k]

    out = {}
    for x in items:
        o = at(x)
        stuck = o is None
        out[x["conv"], x["turn"], x["part"], x["kind"], x["id"]] = ("cycle" if stuck and x["kind"] == "call" else x["link"], *(o if not stuck and (waits[id(x)] or id(x) in needed) else (x["turn"], 0)))
    return out


def test_tool_calls_equal_brute_force(spark):
    rng = random.Random(24)
    rows = []
    for conv in (1, 2, 3, None):
        names = [f"c{i}" for i in range(9)]
        turns = list(range(26))
        rng.shuffle(turns)
        for turn in turns[:22]:
            if rng.random() < 0.5:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*names, "zz"]), "content": "r"})))
            else:
                calls = [call(rng.choice(names), "search", {"query": "q"}, depends_on=rng.sample(names, rng.randrange(3))) for _ in range(rng.randrange(1, 3))]
                ids = [c["id"] for c in calls]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls if len(set(ids)) == len(ids) else calls[:1]})))
    chain = [(9, 2 * i, "assistant", json.dumps({"tool_calls": [call(f"k{i}", "search", {"query": "q"}, depends_on=[f"k{i + 1}"] if i < 7 else [])]})) for i in range(8)]
    rows += [*chain, *[(9, 2 * i + 1, "tool", json.dumps({"tool_call_id": f"k{i}", "content": 1})) for i in range(8)]]
    schema = "conv_id string, turn long, role string, text string"
    named = [(c if c is None else str(c), *r) for c, *r in rows]
    got = {(r.conv_id, r.turn, r.part, r.kind, r.call_id): (r.link, r.order_turn, r.level) for r in chat.link(spark.createDataFrame(named, schema)).collect() if r.kind != "message"}
    assert got == chat_by_force(named)


def test_null_conversations_are_not_the_one_called_null(spark):
    J = json.dumps
    rows = [(None, 0, "assistant", J({"tool_calls": [call("a", "search", {"query": "q"})]})), ("null", 1, "tool", J({"tool_call_id": "a", "content": 1}))]
    rows += [("x", 0, "user", "long " * 50_000), ("x", 0, "user", "long " * 50_000)]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "conv_id string, turn long, role string, text string, link string")
    got = chat.link(docs).collect()
    assert sorted(r.link for r in got) == ["none", "none", "orphan", "unanswered"]


# 4


def test_near_dedup_finds_nine_in_ten_at_the_threshold(spark):
    rng = random.Random(25)
    rows, near, far = [], [], []
    for i in range(150):
        t = [f"{rng.choice(WORDS)}{rng.randrange(90)}" for _ in range(rng.randrange(120, 400))]
        u = t[:]
        # Each changed word changes five shingles; a similarity of 0.8 leaves eight ninths of them.
        for k in range(0, len(t), 50 if i < 100 else 9):
            u[min(len(t) - 1, k + rng.randrange(5))] = "other"
        sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (t, u)]
        similarity = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        if similarity >= 0.8:
            near.append((2 * i, 2 * i + 1))
        elif similarity < 0.6:
            far.append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(u))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 60 and len(far) == 50
    assert sum(b not in kept for _, b in near) >= 0.9 * len(near)
    assert all(a in kept and b in kept for a, b in far) and all(a in kept for a, _ in near)


# 7


def test_ann_finds_nine_in_ten_with_many_cells(spark, monkeypatch):
    for name, n in (("MEMBERS", 100), ("QUERIES", 16)):
        monkeypatch.setattr(ann, name, n)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 2
    x = (centres[rng.integers(0, 40, 1600)] + rng.normal(size=(1600, 16))).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(df, lambda i: i % 20 == 0, k=20, per_cell=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d, hit = x.astype(float), 0
    assert set(got) == set(range(0, 1600, 20)) and all(len(v) == 20 for v in got.values())
    for q, found in got.items():
        s = (d * d[q]).sum(1)
        assert all(abs(s[i] - v) < 1e-12 for i, v in found)
        hit += len({i for i, _ in found} & set(sorted((i for i in range(1600) if i != q), key=lambda i: (-s[i], i))[:20]))
    assert hit >= 0.9 * 20 * len(got)


# 8


def test_encode_checked_equals_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    with open(MODEL, "rb") as f:
        model = f.read()
    rng, library = random.Random(26), SentencePieceProcessor(model_file=MODEL)
    texts = ["", None, " ", "word", "x" * 3000, "ab" * 900 + " c", "日本語" * 400, "a\u2581b  \u2581", "\x00\ufffd", "=" * 17, "=" * 16, "internationalization " * 3]
    texts += [sentence(rng, 4000)] + ["".join(rng.choice("aeinrst \u00e9=.1日") for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, both string")
    rows = sentencepiece.encode_checked(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id] or "") and r.round_trip and r.both == "x"


def test_table_equals_a_dictionary():
    from lexispark.llm.lattice import Table

    rng = np.random.default_rng(4)
    table, known = Table(bits=2), {}
    for _ in range(30):
        keys = rng.integers(0, 4000, 60) * 2**40 % 2**62
        assert table.get(keys).tolist() == [known.get(k, -1) for k in keys.tolist()]
        new = np.array([k for k in np.unique(keys).tolist() if k not in known], np.int64)
        values = rng.integers(0, 9, len(new)).astype(np.int32)
        table.put(new, values)
        known |= dict(zip(new.tolist(), values.tolist(), strict=True))
    assert table.get(np.array(list(known), np.int64)).tolist() == list(known.values()) and len(known) > 900


def unigram(pieces):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.vocab_size = len(pieces) + 3
    proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.escape_whitespaces = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    for piece, score, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((p, s, 1) for p, s in pieces)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    return proto.SerializeToString()


@pytest.mark.parametrize("inner", [False, True])
def test_unigram_models_equal_the_library(inner):
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(27)
    pieces = {c: -8 - rng.random() for c in "abc\u2581"} | {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))): -9 - 3 * rng.random() for _ in range(60)}
    pieces |= {"\u2581" + p: s + rng.random() for p, s in list(pieces.items())[:30] if "\u2581" not in p} | ({"a\u2581b": -9.5, "\u2581ab\u2581": -9.1} if inner else {})
    content = unigram(list(pieces.items()))
    codec, library = sentencepiece.Codec(content), SentencePieceProcessor(model_proto=content)
    assert (codec.stretches is None) == inner
    texts = ["".join(rng.choice("aaabbc ") for _ in range(rng.randrange(1, 200))) for _ in range(200)]
    for t, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode(t) and codec.decode(ids) == t
    for t in ("", "x", "axxb", "  é\n\nabc日本a", "ab" * 200 + "?" + "c" * 300):
        assert codec.encode(t).tolist() == library.encode(t)


# 9


def test_trees_and_features_equal_brute_force():
    rng = random.Random(28)
    texts = [sentence(rng, rng.randrange(1, 60)) + rng.choice(("", " YOU idiot!", " you, id1ot?", " ton crétin")) for _ in range(200)] + ["", None, "IDIOT"]
    y = np.array([float("id" in (t or "").lower() or "cr" in (t or "")) for t in texts])
    model = toxicity.fit(texts, y)

    def walked(row):
        out = model.trees.base
        for nodes in model.trees.trees:
            at = 0
            while nodes[at][0] >= 0:
                f, cut_, left, right, _ = nodes[at]
                at = left if sum(c < row[f] for c in model.trees.cuts[f]) <= cut_ else right
            out += model.trees.rate * nodes[at][4]
        return out

    for t in texts[::7] + texts[-3:]:
        w = toxicity.tokens(t)
        x = dict(zip(toxicity.FEATURES, toxicity.features(t, w, model.lexicon), strict=True))
        bad = [i for i, v in enumerate(w) if v not in toxicity.SECOND and (v in toxicity.SEEDS or v in model.lexicon or len(v) > 5 and "<" + v[:5] in model.lexicon)]
        you = [i for i, v in enumerate(w) if v in toxicity.SECOND]
        n = max(1, len(w))
        assert x["hits"] == len(bad) / n and x["you"] == len(you) / n and x["distinct"] == len({w[i] for i in bad} | {v for v in set(w) & toxicity.SECOND if v in model.lexicon})
        assert x["exclaimed"] == (t or "").count("!") / n and x["shouted"] == float((t or "").isupper())
        margin = model.trees.margin(np.array([list(x.values())]))[0]
        assert abs(margin - walked(list(x.values()))) < 1e-9
        score = np.interp(margin, model.at, model.rate) * 0.998 + 0.002 / (1 + np.exp(-margin))
        assert abs(model.scores([t])[0] - score) < 1e-9


def test_scores_of_repeated_rows_and_clashing_columns():
    rng = random.Random(29)
    texts = [sentence(rng, 20) + (" you idiot" if i % 3 == 0 else "") for i in range(120)]
    model = toxicity.fit(texts, np.array([float(i % 3 == 0) for i in range(120)]))
    twice = model.scores([*texts[:9], *texts[:9]])
    assert twice[:9].tolist() == twice[9:].tolist()


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append((len(texts), sum(len(t or "") for t in texts))))
    docs = spark.createDataFrame([(i % 50, f"{i} " + "x" * 1000, 1) for i in range(2000)] + [(3, "y" * 10**6, 1), (4, None, 1)], "doc_id long, text string, bytes int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.Model({}, None, np.zeros(1), np.array([0.25]))
    scored = toxicity.score(docs.withColumn("score", F.lit("x")).withColumn("predicted", F.lit("x")), model).collect()
    assert len(scored) == 2002 and {(r.score, r.predicted) for r in scored} == {(0.25, 0)}
    toxicity.train(docs, labels, most=100)
    toxicity.train(docs, labels, most_bytes=200_000)
    assert seen[0][0] <= 180 and seen[1][1] <= 300_000 and seen[1][0] > 50


# Executors


def test_operators_travel_with_their_code(tmp_path):
    """Executors that can't import the package encode, fingerprint, search and score."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})  # of the driver only
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.executor.memory", "512m").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from lexispark.llm import ann, sentencepiece, simhash, toxicity
docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
assert sentencepiece.encode_checked(docs, sentencepiece.read_model(spark, {MODEL!r})).filter("round_trip").count() == 2
assert simhash.keep_one(docs).count() == 2
assert toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))).count() == 2
assert ann.search(spark.createDataFrame([(i, [1.0, i * 1.0]) for i in range(5)], "vec_id long, embedding array<float>"), lambda i: i == 0).count() == 4
print("DONE")
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("DONE"), out.stderr[-2000:]
