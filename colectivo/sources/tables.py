"""Stored tables: typed reads, quality checks, snapshot upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import latest_by
from ..schemas import ENUMS, KEYS, schema


def read_table(spark: SparkSession, root: str, table: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Read a table with its fixed schema; nothing is inferred.

    ``fmt="jdbc"`` with ``url`` and ``dbtable`` options reads the same table
    from a database and casts to the schema.
    """
    wanted = schema(table)
    if fmt == "jdbc":
        raw = spark.read.format("jdbc").options(**options).load()
        return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
    return spark.read.schema(wanted).format(fmt).options(**options).load(f"{root}/{table}")


def write_table(df: DataFrame, root: str, table: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{table}")


def quality_report(df: DataFrame, table: str) -> DataFrame:
    """Rows breaking an enum or a unique key of the table: check, bad_rows."""
    checks = []
    for (name, column), allowed in ENUMS.items():
        if name == table and column in df.columns:
            checks.append(F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).alias(f"enum:{column}"))
    spark = df.sparkSession
    parts = []
    if checks:
        row = df.agg(*checks)
        names = row.columns
        parts.append(
            row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("bad_rows")) for n in names])).alias("c")).select("c.*")
        )
    if table in KEYS and all(k in df.columns for k in KEYS[table]):
        dup = df.groupBy(*KEYS[table]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(dup.agg(F.lit("unique:" + ",".join(KEYS[table])).alias("check"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("bad_rows")))
    if not parts:
        return spark.createDataFrame([], "check string, bad_rows bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of old and new rows with the latest per key, for a new snapshot of the table."""
    return latest_by(current.unionByName(changes, allowMissingColumns=True), keys, [F.col(c) for c in order])


def sync_devices(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Insert devices not known yet; known ones stay as they are."""
    new = seen.select("device_id").where("device_id IS NOT NULL").distinct().join(current.select("device_id"), "device_id", "left_anti")
    return current.unionByName(new, allowMissingColumns=True)


def upsert_devices(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest values per device; empty fields of an update keep the stored value.

    ``updates`` carry device_id, push_token, platform, locale, at.
    """
    fields = ["push_token", "platform", "locale"]
    newest = updates.groupBy("device_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"_{c}") for c in fields],
        F.min("at").alias("_first"), F.max("at").alias("_last"),
    )
    return current.join(newest, "device_id", "full").select(
        "device_id", *[F.coalesce(f"_{c}", c).alias(c) for c in fields],
        F.coalesce("_last", "last_seen_at").alias("last_seen_at"), F.coalesce("created_at", "_first").alias("created_at"),
    )


def replace_subscriptions(current: DataFrame, requests: DataFrame) -> DataFrame:
    """A request (device_id, line_ids, at) replaces all subscriptions of its device; the latest wins."""
    last = requests.groupBy("device_id").agg(F.max_by("line_ids", "at").alias("line_ids"))
    fresh = last.select("device_id", F.explode(F.array_distinct("line_ids")).alias("line_id"), F.lit("commute").alias("kind"))
    return current.join(last, "device_id", "left_anti").select("device_id", "line_id", "kind").union(fresh)
