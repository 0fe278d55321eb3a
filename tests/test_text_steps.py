"""The cleaning rules as steps: the same texts as in one expression, each rule planned once."""

from pyspark.sql import functions as F

from tidemark.operators import text
from tidemark.plans.text_queries import text_pipeline

ODD = [
    None, "", " ", "aaaa bbbbb!!!!!! #39;x amp;lt; &lt;b&gt; &copy", "go go go go go stop", "A/B#C\nD  E", "XXL Hello hEllo É é ÉCOLE", "ha! ha! ha! ha! HA!",
    "<br />quot;q\\\" @-@ w &amp;amp; nbsp;nbsp;", "世界世世世世世 \\n", "ǅ ǅabc ΑΒ Σας ß İİ",
]


def test_steps_equal_one_expression(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "i long, t string")
    want = {r.i: r.c for r in df.select("i", text.clean(F.col("t")).alias("c")).collect()}
    assert {r.i: r.t for r in text.cleaned(df, "t").collect()} == want
    assert text.cleaned(df, "t").columns == df.columns


def test_caps_as_before(spark):
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(ODD) if t], "i long, t array<string>")

    def plain(t):
        if t.lower() == t:
            return [t]
        if t.upper() == t and len(t) > 1:
            return ["xxup", t.lower()]
        return ["xxmaj", t.lower()] if t[0] != t[0].lower() and t[1:].lower() == t[1:] else [t.lower()]

    for r in df.select("t", text.mark_caps(F.col("t")).alias("m")).collect():
        if "İİ" not in r.t:
            assert r.m == [x for t in r.t for x in plain(t)]


def test_pipeline_plans_each_rule_once(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query = text_pipeline(spark, f"file://{tmp_path}")
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" xxrep ") == plan.count(" xxwrep ") == 1
    assert query.count() == len(ODD)
