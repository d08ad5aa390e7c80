"""Incremental refresh: landed changes update only the facilities they touch.

A batch replayed after a failure at any step gives the same tables: upserts are by key, outputs
replace whole partitions, and the facilities a batch touches are stored under its stream and id
before the silver table changes, as afterwards the former facility of a moved record is no longer
known. Stored names only ever add to what the batch itself touches, so a stale folder cannot hide a
facility. Streams on one table take turns; each has a checkpoint of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.operators import measures
from dossierlake.sources.files import delete_path, written
from dossierlake.sources.upserts import delete_keys, upsert_submissions, write_partitions


def latest_changes(batch: DataFrame, key: list[str], ordinal: str = "seq") -> DataFrame:
    """Last change per key within a batch."""
    rest = [c for c in batch.columns if c not in key]
    return batch.groupBy(*key).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(*key, "_r.*")


def apply_changes(table: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Upserts and deletions (``op`` 'upsert' or 'delete') on the current table."""
    changes = latest_changes(batch, key)
    fresh = changes.filter(F.col("op") == "upsert").drop("op", "seq")
    gone = changes.filter(F.col("op") == "delete")
    return upsert_submissions(delete_keys(table, gone, key), fresh, key)


def affected(table: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Facilities named by a change, plus those its records belonged to before."""
    former = table.join(batch.select(*key).distinct(), key, "left_semi").select("facility_type")
    return batch.select("facility_type").unionByName(former).distinct()


def refresh_partitions(
    spark: SparkSession,
    silver: str,
    target: str,
    key: list[str],
    build: Callable[[DataFrame], DataFrame],
    source: str = "",
) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: merge the batch into the silver table, then rebuild the target for
    the affected facilities only. ``source`` names the stream: its batch numbers start at 0 again
    for every checkpoint location.

    Facility types are a small fixed domain, so their names may reach the driver. A facility
    left without rows loses its partitions.
    """
    stream = f"source={zlib.crc32(source.encode()):08x}"

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        current = spark.read.parquet(silver)
        touched = f"{silver}__touched/{stream}/batch={batch_id}"
        if not written(spark, touched):
            affected(current, batch, key).write.mode("overwrite").parquet(touched)
        stored = spark.read.schema("facility_type string").parquet(touched)
        # at most one name per facility type: literals that prune the partitions to read
        names = [r[0] for r in stored.unionByName(affected(current, batch, key)).distinct().collect()]
        scope = current.filter(F.col("facility_type").isin(names))
        staged = f"{silver}__staged/{stream}"
        # written first: the merge reads the partitions it is about to replace
        apply_changes(scope, batch, key).write.mode("overwrite").partitionBy("facility_type").parquet(staged)
        fresh = spark.read.schema(current.schema).parquet(staged)
        kept = {r[0] for r in fresh.select("facility_type").distinct().collect()}
        write_partitions(fresh, silver)
        write_partitions(build(fresh), target)
        for name in names:
            if name not in kept:
                for path in (silver, target):
                    delete_path(spark, f"{path}/facility_type={name}")
        # the batch before is committed once this one runs
        delete_path(spark, f"{silver}__touched/{stream}/batch={batch_id - 1}")

    return run


def start_refresh(
    spark: SparkSession, landing: str, schema, silver: str, target: str, checkpoint: str,
    key: list[str], build: Callable[[DataFrame], DataFrame],
):
    """File-source stream over a landing folder of change records (with tombstones)."""
    changes = spark.readStream.schema(schema).parquet(landing)
    return (
        changes.writeStream.foreachBatch(refresh_partitions(spark, silver, target, key, build, checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_landing_validation(spark: SparkSession, landing: str, schema, flags: str, checkpoint: str, keys: list[str]):
    """Stateless stream: every landed row of measures adds its flags; nothing is blocked."""
    rows = spark.readStream.schema(schema).parquet(landing)
    return (
        measures.measure_flags(rows, keys)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", flags)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
