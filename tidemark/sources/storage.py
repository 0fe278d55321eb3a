"""Fitted stages and vocabularies as Parquet folders: what training has learnt, written once and loaded by any session."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import tabular

STAGES = {c.__name__: c for c in (tabular.Categorify, tabular.FillMissing, tabular.Normalize)}


def save_chain(spark: SparkSession, chain: tabular.Chain, path: str) -> None:
    """``stages`` holds a row a stage, its parameters as JSON; ``codes-i-column`` the table of a categorical column."""
    rows = []
    for i, stage in enumerate(chain.stages):
        values = {f.name: getattr(stage, f.name) for f in fields(stage) if f.name != "tables"}
        rows.append((i, type(stage).__name__, json.dumps(values)))
        for column, table in getattr(stage, "tables", {}).items():
            table.write.parquet(f"{path}/codes-{i}-{column}")
    spark.createDataFrame(rows, "place int, kind string, parameters string").coalesce(1).write.parquet(f"{path}/stages")


def load_chain(spark: SparkSession, path: str) -> tabular.Chain:
    """The stages of a folder, ready to apply."""
    stages = []
    for row in spark.read.parquet(f"{path}/stages").orderBy("place").collect():
        stage = STAGES[row.kind](**json.loads(row.parameters))
        if row.kind == "Categorify":
            stage.tables = {c: spark.read.parquet(f"{path}/codes-{row.place}-{c}") for c in stage.columns}
        stages.append(stage)
    return tabular.Chain(stages)


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """id and token."""
    vocab.select("id", "token").write.parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """id and token."""
    return spark.read.schema("id long, token string").parquet(path)
