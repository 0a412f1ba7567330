import pytest

from lexispark.llm.common import Tables
from lexispark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_one_query_per_operator():
    import __spark_entry__ as entry

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


def test_pipeline(spark, data):
    """Each stage on what the one before kept, against what it has to keep."""
    import corpus_pipeline as p

    docs, kept = spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in p.STAGES:
        out = Tables(spark).keep(stage(spark, docs, data))
        kept[name] = out.toPandas()
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    ids = {k: set(v.doc_id) for k, v in kept.items()}
    assert ids["line_dedup"] <= ids["quality_rules"] and ids["simhash_near_dedup"] <= ids["line_dedup"]
    assert ids["source_mixing"] <= ids["simhash_near_dedup"] and ids["sentencepiece_encoding"] == ids["source_mixing"]
    one = kept["simhash_near_dedup"]
    assert one.doc_id.is_unique and one.text.is_unique
    labels = spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1").toPandas()
    there = set(labels.doc_id)
    assert len(ids["quality_rules"] & there) >= 0.9 * len(there)
    last = kept["sentencepiece_encoding"]
    assert len(last) == len(kept["source_mixing"]) and (last.n_ids == last.ids.map(len)).all()
    assert len(p.run(spark, data).collect()) == len(last)
