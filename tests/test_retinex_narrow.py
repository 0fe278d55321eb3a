"""Retinex of narrow planes: one pass over tiles of whole rows gives what two passes over strips give, and shuffles no blurs."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import planes


def test_one_pass_equals_two(spark, monkeypatch):
    monkeypatch.setattr(planes, "ROWS", 16)  # several tiles, neighbours beyond the next one too
    rng = np.random.default_rng(5)
    rows = [(p, x, y, float(v)) for p, (w, h) in enumerate([(9, 70), (1, 1), (12, 3), (5, 33)]) for y in range(h) for x, v in enumerate(rng.integers(0, 256, w))]
    cells = spark.createDataFrame(rows, "plane long, x long, y long, v double")
    got, want = (
        {(r.plane, r.x, r.y): (r.v, r.b0, r.b1) for r in planes.blurred(cells, (1.0, 9.0), 8, narrow=n).collect()} for n in (256, 0)
    )
    assert len(got) == len(rows) and got == want
    got, want = ({tuple(r) for r in planes.retinex(cells, (1.0, 9.0), 8, narrow=n).collect()} for n in (256, 0))
    assert got == want


def test_narrow_planes_meet_once(spark):
    cells = spark.range(256).select(F.lit(0).cast("long").alias("plane"), (F.col("id") % 8).alias("x"), F.expr("id div 8").alias("y"), F.col("id").cast("double").alias("v"))
    plan = planes.blurred(cells, (1.0,))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert planes.blurred(cells.limit(0), (1.0,)).count() == 0
