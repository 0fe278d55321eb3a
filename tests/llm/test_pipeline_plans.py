"""Plans that the driver holds stay small: what is read twice is written once, and a step reads its edges once a use."""

import pytest
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import mixing, simhash


def leaves(df: DataFrame) -> int:
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


@pytest.fixture()
def written(monkeypatch):
    """Leaves of each plan that the two operators write."""
    sizes: list[tuple[str, int]] = []
    for module in (mixing, simhash):
        keep = module.staged

        def staged(df, name, *rest, _keep=keep):
            sizes.append((name, leaves(df)))
            return _keep(df, name, *rest)

        monkeypatch.setattr(module, "staged", staged)
    return sizes


def test_mix_is_planned_once(spark, written):
    rows = [(i % 90, f"w{i} and so on " * (i % 7), "en", "abc"[i % 3], i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.apply_mix(docs)
    assert leaves(out) <= 8  # the mix alone has more
    assert max(n for _, n in written) <= 10
    each = mixing.mix(docs).groupBy("doc_id").agg(F.sum(F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)).alias("t"))
    counts = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) > 0 and set(counts) <= {r.doc_id for r in each.where("t > 0").collect()}


def test_rounds_read_edges_four_times(spark, written):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (70, 70)], "a long, b long")
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    assert root == {i: 0 for i in range(1, 31)} | {55: 50, 60: 50}  # a root is its own
    assert max(n for name, n in written if name == "links") <= 4
