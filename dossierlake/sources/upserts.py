"""Record maintenance as joins over whole tables, written by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _is_empty(c: str, kind: str):
    col = F.col(c)
    if kind.startswith("array") or kind.startswith("map"):
        return col.isNull() | (F.size(col) == 0)
    return col.isNull() | (col.cast("string") == "")


def upsert_projects(old: DataFrame, new: DataFrame, key: list[str], extras: list[str], merge: bool = True) -> DataFrame:
    """New scalars replace old ones; empty extras are ignored. With ``merge`` the old
    submissions and creation time are kept."""
    kinds = {f.name: f.dataType.simpleString() for f in old.schema}
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in key], F.lit(True).alias("_new"))
    joined = old.join(n, key, "full_outer")
    out = []
    for c in old.columns:
        if c in key:
            continue
        if f"_n_{c}" not in joined.columns:
            out.append(F.col(c))
            continue
        fresh = F.col(f"_n_{c}")
        if merge and c in ("submissions", "created_at"):
            out.append(F.coalesce(F.col(c), fresh).alias(c))
        elif c in extras:
            out.append(F.when(~_is_empty(f"_n_{c}", kinds[c]), fresh).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_new"), fresh).otherwise(F.col(c)).alias(c))
    return joined.select(*key, *out)


def enrich_projects(old: DataFrame, extras: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Fill only fields that are empty; existing input is never overwritten."""
    kinds = {f.name: f.dataType.simpleString() for f in old.schema}
    n = extras.select(*key, *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = old.join(n, key, "left")
    return joined.select(
        *[
            F.when(_is_empty(c, kinds[c]) & ~_is_empty(f"_n_{c}", kinds[c]), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
            if c in fields else F.col(c)
            for c in old.columns
        ]
    )


def upsert_submissions(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_keys(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def stale_facilities(old: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """Facilities whose pattern and index a change outdates: the new and the former one."""
    fresh = changed.select("facility_type")
    former = old.join(changed.select(*key), key, "left_semi").select("facility_type")
    return fresh.unionByName(former).distinct()


def duplicate_ids(projects: DataFrame, id_column: str = "competition_id") -> DataFrame:
    """Generated ids that several projects share."""
    return projects.groupBy("facility_type", id_column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def write_partitions(df: DataFrame, path: str, by: str = "facility_type") -> None:
    """Replace exactly the partitions present in ``df``; the others stay."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(by).parquet(path)
    )


def backfill(old: DataFrame, new: DataFrame, key: list[str], items: str = "addresses") -> DataFrame:
    """Records whose recomputed block gains addresses or did not exist; nothing is written.

    ``items`` is an array column; NULL in ``old`` means the block is missing.
    """
    n = new.select(*key, F.col(items).alias("_new"))
    filled = lambda c: F.size(F.filter(c, lambda a: F.coalesce(a != "", F.lit(False))))
    before = F.coalesce(F.when(F.col(items).isNotNull(), filled(F.col(items))), F.lit(0))
    after = filled(F.col("_new"))
    return (
        old.join(n, key)
        .withColumn("before", before)
        .withColumn("after", after)
        .filter((F.col("after") > F.col("before")) | (F.col(items).isNull() & (F.size("_new") > 0)))
        .drop("_new")
    )


def backfill_changes(old: DataFrame, new: DataFrame, key: list[str], item: str) -> DataFrame:
    """Records whose recomputed rows fill more items than the stored ones, or that had none: key,
    before, after. One row per item on both sides, so no record is held in one row."""
    filled = F.count_if(F.trim(F.coalesce(item, F.lit(""))) != "")
    before = old.groupBy(*key).agg(filled.alias("before"))
    after = new.groupBy(*key).agg(filled.alias("after"))
    return after.join(before, key, "left").where(F.col("before").isNull() | (F.col("after") > F.col("before"))).select(
        *key, F.coalesce("before", F.lit(0)).alias("before"), "after"
    )


def apply_backfill(spark: SparkSession, path: str, new: DataFrame, key: list[str], item: str, by: str, dry_run: bool = True) -> DataFrame:
    """Replace the rows of records that ``backfill_changes`` names in a table partitioned by ``by``;
    returns the changes. A dry run only returns them.

    Only partitions with a change are rewritten, each as a whole, from rows written aside first; a
    second run finds no change and writes nothing.
    """
    old = spark.read.parquet(path)
    changes = backfill_changes(old, new, key, item)
    if dry_run:
        return changes
    noted = f"{path}__changes"
    changes.write.mode("overwrite").parquet(noted)
    changes = spark.read.parquet(noted)
    fresh = new.join(changes.select(*key), key, "left_semi")
    kept = old.join(changes.select(*key), key, "left_anti").withColumn(by, F.col(by).cast(new.schema[by].dataType))
    touched = fresh.select(by).distinct()
    staged = f"{path}__staged"
    kept.join(touched, by, "left_semi").unionByName(fresh).write.mode("overwrite").parquet(staged)
    write_partitions(spark.read.parquet(staged), path, by)
    return changes


def export_sheets(sheets: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """One output folder per logical sheet."""
    for name, df in sheets.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.format(fmt).save(f"{root}/{name}")
