from lexispark.operators import names
from lexispark.plans.sql import register


def test_functions_in_sql(spark):
    p = names.prepare(spark.createDataFrame([("Mara Quill", "t")], "name string, target_id string"))
    register(spark, p)
    rows = spark.sql("SELECT m.value, m.start_char FROM (SELECT explode(lexi_mentions('a Mara  Quill, mara quill')) AS m)").collect()
    assert [tuple(r) for r in rows] == [("Mara  Quill", 2), ("mara quill", 15)]
    assert spark.sql("SELECT lexi_normalize('  ÀB c'), lexi_decode(X'41FF42')").first() == ("ab c", "A")
    rows = spark.sql("SELECT f.* FROM VALUES ('x MARA QUILL'), (NULL) AS t(x), LATERAL lexi_find(x) AS f").collect()
    assert [tuple(r) for r in rows] == [(0, 2, 12, "MARA QUILL")]
