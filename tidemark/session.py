"""Session helpers shared by the query modules."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (REPO, env.get("PYTHONPATH", "")) if p)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set and all is one machine."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(where)
    return where


#: Rows of a part that ``dealt`` makes.
PART_ROWS = 200_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt by columns to parts of about ``PART_ROWS`` of its ``rows``: their number grows with the input, a part doesn't."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)), *by)


#: Bytes of a batch that goes to Python in ``small_batches``.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """While it lasts, batches of about ``most`` bytes go to Python: executor and worker each hold a batch more than once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Tables that this driver has staged and not released.
_TABLES: list[str] = []


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """A mark for ``release``."""
    return len(_TABLES)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables staged after a mark, but for those that the DataFrames ``keep`` still read."""
    still = {unquote(f.rpartition("/")[0]).rpartition("/")[2] for df in keep for f in df.inputFiles()}
    gone = [path for path in _TABLES[since:] if path.rpartition("/")[2] not in still]
    _TABLES[since:] = [path for path in _TABLES[since:] if path not in gone]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
