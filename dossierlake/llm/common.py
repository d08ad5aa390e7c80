"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dossierlake.sources.files import shared_folder

#: A-Z to a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every ASCII byte that is neither letter nor digit becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


#: Bytes of a batch that goes to a Python worker or comes from it (a longer row goes alone).
BATCH_BYTES = 4 << 20


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of ASCII letters, ASCII digits and all characters beyond ASCII."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between blanks: space, tab, newline, vertical tab, form feed, return."""
    return text.encode().translate(LOWER).split() if text else []


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of Arrow batches, row by row."""
    for batch in small(batches):
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def small(batches: Iterable[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def arrow_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded length and, as far as strings and binaries go, bounded bytes."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= size or weight >= max_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow form of a DDL schema of plain types."""
    plain = {
        "LongType": pa.int64(), "IntegerType": pa.int32(), "StringType": pa.string(), "BinaryType": pa.binary(),
        "DoubleType": pa.float64(), "BooleanType": pa.bool_(),
    }
    kinds = T._parse_datatype_string(ddl) if isinstance(ddl, str) else ddl

    def kind(t):
        return pa.list_(kind(t.elementType)) if isinstance(t, T.ArrayType) else plain[type(t).__name__]

    return pa.schema([(f.name, kind(f.dataType)) for f in kinds.fields])


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; Python workers get them in batches of ``BATCH_BYTES``, whatever a row's length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return freed memory to the system, where its library can: a worker lives longer than its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def map_rows(df: DataFrame, names: list[str], work, ddl: str) -> DataFrame:
    """``work`` maps an iterator of tuples of the named columns to tuples of ``ddl``; batches
    stream, so a task holds only a few thousand rows of either side."""
    schema = arrow_schema(ddl)

    def run(batches):
        yield from arrow_batches(work(rows_of(batches, *names)), schema)
        give_back()

    return bounded(df.select(*names)).mapInArrow(run, ddl)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_crc_bucket(id_col: str | Column, mod: int = 5) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as an empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def local_table(spark: SparkSession, columns: dict[str, np.ndarray | list], ddl: str) -> DataFrame:
    """A DataFrame of columns that the driver holds; callers bound their length."""
    schema = arrow_schema(ddl)
    arrays = [pa.array(columns[f.name], f.type) for f in schema]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema), T._parse_datatype_string(ddl))


def class_counts(df: DataFrame, cls: str, sums: dict[str, str] | None = None) -> dict[str, np.ndarray]:
    """Rows (and sums) per class, combined before the shuffle, collected. The caller bounds the
    number of classes."""
    aggs = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in (sums or {}).items())]
    got = df.groupBy(cls).agg(*aggs).toArrow()
    order = np.argsort(got.column(cls).to_numpy())
    return {name: got.column(name).to_numpy()[order].astype(np.int64) for name in got.column_names}


def ranked(df: DataFrame, cls: str, order: list[str], counts: dict[str, np.ndarray], base: np.ndarray | None = None,
           extra: dict[str, tuple[str, np.ndarray]] | None = None, least: int = 1_000, out: str = "rank") -> DataFrame:
    """Number the rows of every class of a bounded set of classes gaplessly, from ``base`` (0).

    ``counts`` is ``class_counts(df, cls)``. A class beyond four mean classes (at least ``least``
    rows) is split by a hash of ``order``, and each split starts where the one before ends, so that
    no task numbers a hot class alone. ``extra`` brings further columns per class. What is broadcast
    has one row per class and at most a quarter as many further splits, whatever the table's size.
    """
    ids, n = counts[cls], counts["n"]
    spark = df.sparkSession
    target = max(least, 4 * int(n.sum()) // max(1, len(n)))
    k = np.maximum(1, -(-n // target))
    start = np.zeros(len(n), np.int64) if base is None else np.asarray(base, np.int64)
    offsets: list[list[int]] = [[int(s)] for s in start]
    hashed = F.xxhash64(*[F.col(c) for c in order])
    hot = np.flatnonzero(k > 1)
    if len(hot):
        keys = local_table(spark, {"_cls": ids[hot], "_k": k[hot]}, "_cls long, _k long")
        split = df.join(F.broadcast(keys), F.col(cls) == F.col("_cls")).select("_cls", F.pmod(hashed, F.col("_k")).alias("_sub"))
        found = {(r._cls, r._sub): r.n for r in split.groupBy("_cls", "_sub").agg(F.count(F.lit(1)).alias("n")).collect()}
        for i in hot:
            sizes = [found.get((int(ids[i]), s), 0) for s in range(int(k[i]))]
            offsets[i] = (int(start[i]) + np.concatenate([[0], np.cumsum(sizes[:-1])])).astype(np.int64).tolist()
    more = extra or {}
    ddl = "_cls long, _k long, _offsets array<long>" + "".join(f", {c} {kind}" for c, (kind, _) in more.items())
    plan = local_table(spark, {"_cls": ids, "_k": k, "_offsets": offsets, **{c: v for c, (_, v) in more.items()}}, ddl)
    within = Window.partitionBy("_cls", "_sub").orderBy(*order)
    return (
        df.join(F.broadcast(plan), F.col(cls) == F.col("_cls"))
        .withColumn("_sub", F.pmod(hashed, F.col("_k")))
        .withColumn(out, F.get("_offsets", F.col("_sub").cast("int")) + F.row_number().over(within) - 1)
        .drop("_cls", "_sub", "_k", "_offsets")
    )
