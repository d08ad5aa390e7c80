"""Bounded samples of labelled documents."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm import common


def lowest_hashed(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """The ``most`` rows whose ids hash lowest, in that order.

    The rows are counted first, and only hashes below twice the share that is wanted are sorted, so
    about 2 * ``most`` rows leave their tasks, however many tasks there are.
    """
    total = rows.count()
    h = F.xxhash64(F.col(id_col))
    if total > 2 * most:
        rows = rows.where(h < F.lit(int((2 * most / total) * 2.0**64) - 2**63))
    return rows.orderBy(h, F.col(id_col)).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int, id_col: str = "doc_id",
                    text_col: str = "text", folds: int = 5) -> list[tuple[str, int]]:
    """Texts and labels to learn from, in a fixed order.

    Per class, the ``per_class`` rows whose id hashes lowest, of rows whose crc32(id as text) modulo
    ``folds`` is not 0; of those, the ones with a text of 1 to ``most_bytes`` bytes. So at most
    2 * per_class * most_bytes bytes reach the driver. Ids are chosen from the labels alone; only the
    texts chosen are read by a join, with a broadcast of that many ids. Rows with a null id or label
    are not learned from.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).where(
        (common.id_crc_bucket(id_col, folds) != 0) & F.col(id_col).isNotNull()
    )
    chosen = None
    for value in (0, 1):
        part = lowest_hashed(rows.where(F.col("_label") == value), "_id", per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    size = F.octet_length(text_col)
    texts = docs.where(size.between(1, most_bytes)).select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(chosen.dropDuplicates(["_id"])), F.col("_key") == F.col("_id"))
    found = joined.groupBy("_id").agg(F.first("_text").alias("_text"), F.first("_label").alias("_label")).toArrow().to_pylist()
    return [(r["_text"], r["_label"]) for r in sorted(found, key=lambda r: r["_id"])]


def give_back() -> None:
    """Return the memory that a sample and its training took to the system, where its library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return
