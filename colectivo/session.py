"""Session settings and durable cuts of long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "colectivo", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job relies on; cluster sizing stays with the caller."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineages.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder, because executors on other machines could
    not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def snapshot(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Iterative jobs call this each round: the lineage is cut, the result
    survives lost executors, and the next plan sees real file sizes, so
    adaptive execution can choose its joins well.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/colectivo-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB: on the heap of executors it would grow with all keys ever seen."""
    kind = "spark.sql.streaming.stateStore"
    wanted = {
        f"{kind}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{kind}.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
