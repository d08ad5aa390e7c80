"""Product codes of vectors: every part is assigned exactly, few distances are computed.

Distances of all parts to fixed pivots are computed once and stored. In every round the pivots'
distances to the codebook's entries give a lower bound for each pair by the triangle inequality;
entries are evaluated from the lowest bound on, and those whose bound exceeds the best distance never.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm import common

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 4, 256, 4, 1024, 16
#: Parts that are compared with all entries at a time, and entries that are evaluated first.
BLOCK, FIRST = 128, 8
#: A label of more than one in so many rows has its total broadcast; so there are fewer than that.
FREQUENT = 1024


def kept_vectors(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is not null and holds neither nulls nor values that are not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    return vectors.where(F.col(vector_col).isNotNull() & F.forall(F.col(vector_col).cast("array<double>"), finite))


def _largest(width: int) -> int:
    """Greatest size of a component at which squared distances of ``width`` components fit."""
    return math.isqrt((1 << 61) // max(1, width)) // 2


def _whole_numbers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Components as whole numbers, one row a vector; short vectors are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    most = _largest(width)
    return np.clip(np.floor(out * scale), -most, most).astype(np.int64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots, rounded to single precision."""
    out = np.empty((len(x), len(pivots)), np.float32)
    for k, pivot in enumerate(pivots):
        d = (x - pivot).astype(np.float64)
        out[:, k] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Entries far from each other: the first, then always the one farthest from those chosen."""
    chosen = [0]
    far = _distances(entries, entries[:1])[:, 0]
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry (ties: lower index) of every row, its squared distance, and how many exact
    distances that took."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    greatest = 4 * most * most * max(1, x.shape[1])
    # sums of whole numbers are exact as long as they fit the significand
    kind = np.float32 if greatest < 2**24 else np.float64 if greatest < 2**53 else np.int64
    x, entries = x.astype(kind), entries.astype(kind)
    count, across = len(entries), np.ascontiguousarray(entry_pivots.T)
    index, best, evaluated = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
    for at in range(0, len(x), BLOCK):
        rows, known = x[at : at + BLOCK], to_pivots[at : at + BLOCK]
        each = np.arange(len(rows))
        bound, gap = np.zeros((2, len(rows), count), np.float32)
        for k in range(known.shape[1]):
            np.subtract(known[:, k, None], across[k], out=gap)
            np.maximum(bound, np.abs(gap, out=gap), out=bound)
        # distances are rounded: what rounding may add to a bound is taken off
        bound -= np.float32(1e-6) * (known.max(1, initial=0)[:, None] + entry_pivots.max(initial=0))
        least, winner = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), count)
        for _ in range(min(FIRST, count)):
            low = bound.argmin(1)
            bound[each, low] = np.inf
            d = rows - entries.take(low, 0)
            d = np.einsum("ij,ij->i", d, d).astype(np.int64)
            better = (d < least) | ((d == least) & (low < winner))
            least, winner = np.where(better, d, least), np.where(better, low, winner)
        left = bound <= (np.sqrt(least.astype(np.float64)) * (1 + 1e-6)).astype(np.float32)[:, None]
        many = left.sum(1)
        entry = np.flatnonzero(left) % count
        evaluated += min(FIRST, count) * len(rows) + len(entry)
        here = np.flatnonzero(many)
        if len(here):
            d = rows.repeat(many, 0)
            d -= entries.take(entry, 0)
            d = np.einsum("ij,ij->i", d, d)
            starts = (np.cumsum(many) - many)[here]
            shortest = np.minimum.reduceat(d, starts)
            lowest = np.minimum.reduceat(np.where(d == shortest.repeat(many[here]), entry, count), starts)
            shortest = shortest.astype(np.int64)
            better = (shortest < least[here]) | ((shortest == least[here]) & (lowest < winner[here]))
            least[here[better]], winner[here[better]] = shortest[better], lowest[better]
        index[at : at + BLOCK], best[at : at + BLOCK] = winner, least
    return index, best, evaluated


class Codebook:
    """Entries of every part, whole numbers: parts x entries x components; and the fixed pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots
        self.to_pivots = [_distances(e, p) for e, p in zip(entries, pivots)]

    def digest(self) -> str:
        """sha256 of all components, by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _stored_parts(kept: DataFrame, vector_col: str, keep: dict[str, str], book: Codebook, scale: int) -> DataFrame:
    """Whole numbers and distances to the pivots of every vector, computed once and written."""
    parts, _, size = book.entries.shape
    pivots = book.pivots

    def work(batches):
        for batch in common.small(batches, 4096):
            x = _whole_numbers(batch.column(0), parts * size, scale)
            d = np.concatenate([_distances(x[:, p * size : (p + 1) * size], pivots[p]) for p in range(parts)], 1)
            fixed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x.astype("<i4"), d.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *fixed], names=names)

    names = [*keep, "_x", "_d"]
    plain = kept.select(F.col(vector_col).cast("array<double>").alias("_v"), *[F.col(c).alias(k) for k, c in keep.items()])
    schema = T.StructType([*[T.StructField(k, kept.schema[c].dataType) for k, c in keep.items()],
                           T.StructField("_x", T.BinaryType()), T.StructField("_d", T.BinaryType())])
    return common.stored(plain.mapInArrow(work, schema), "vector-parts")


def _assigned(batch: pa.RecordBatch, book: Codebook):
    """Per part: components of the batch's vectors, their entries and squared distances."""
    parts, _, size = book.entries.shape
    x = np.frombuffer(b"".join(batch.column("_x").to_pylist()), "<i4").reshape(batch.num_rows, parts, size)
    d = np.frombuffer(b"".join(batch.column("_d").to_pylist()), "<f4").reshape(batch.num_rows, parts, -1)
    for p in range(parts):
        index, distance, _ = nearest(x[:, p], d[:, p], book.entries[p], book.to_pivots[p])
        yield p, x[:, p], index, distance


def _moved(stored: DataFrame, book: Codebook) -> np.ndarray:
    """Every entry as the mean of its parts, rounded down; sums are added up in every task first."""
    parts, count, size = book.entries.shape

    def work(batches):
        total = np.zeros((parts, count, size + 1), np.int64)
        for batch in batches:
            for p, x, index, _ in _assigned(batch, book):
                order = np.argsort(index, kind="stable")
                at = np.flatnonzero(np.diff(index[order], prepend=-1))
                total[p, index[order][at], :size] += np.add.reduceat(x[order].astype(np.int64), at, axis=0)
                total[p, :, size] += np.bincount(index, minlength=count)
        flat = total.ravel()
        cell = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[cell])], names=["cell", "total"])

    got = stored.select("_x", "_d").mapInArrow(work, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    total = np.zeros(parts * count * (size + 1), np.int64)
    total[got.column("cell").to_numpy()] = got.column("total").to_numpy()
    total = total.reshape(parts, count, size + 1)
    n = total[:, :, size:]
    return np.where(n > 0, np.floor_divide(total[:, :, :size], np.maximum(n, 1)), book.entries)


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None,
                   parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
                   pivots: int = PIVOTS) -> tuple[DataFrame, Codebook | None]:
    """Codes of all vectors and the codebook learned from all of them.

    Rows: the id, the columns of ``keep``, ``code`` (two hexadecimal digits per part), ``error`` (the
    squared distances to the entries, summed over the parts). A component x counts as
    floor(``scale`` * x). The codebook of a part starts with that part of the ``entries`` smallest
    ids (ties: smaller vector) and moves to the mean of its parts, rounded down, in every round;
    entries that nothing chose stay. At most 256 entries.

    Vectors that are null or hold nulls or values that are not finite are left out. Shorter vectors
    are filled with zeros to the longest length, itself rounded up to a multiple of ``parts``;
    components so large that squared distances would leave 64 bits are brought down to the largest
    size that does not. Rows without an id are coded but start no entry; where no row has an id,
    the entries start with the smallest vectors. Repeated rows are all kept. Without any vector
    there are no rows and no codebook. What the driver holds is one codebook.
    """
    keep = keep or []
    names = {f"c{i}": c for i, c in enumerate([id_col, *keep])}
    kept = kept_vectors(vectors, vector_col)
    kind = f"{vectors.schema[id_col].simpleString().split(':', 1)[1]}"
    ddl = T.StructType([*[T.StructField(c, vectors.schema[c].dataType) for c in names.values()],
                        T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    longest = kept.agg(F.max(F.size(vector_col))).first()[0]
    if longest is None:
        return vectors.sparkSession.createDataFrame([], ddl), None
    size = -(-longest // parts)
    start = kept.orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(entries)
    start = start.select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).isNull().alias("loose")).toArrow()
    loose = start.column("loose").to_numpy()
    first = _whole_numbers(start.column("v"), parts * size, scale)[~loose if not loose.all() else slice(None)]
    books = first.reshape(len(first), parts, size).transpose(1, 0, 2)
    book = Codebook(books, np.stack([choose_pivots(b, pivots) for b in books]))
    stored = _stored_parts(kept, vector_col, names, book, scale)
    for _ in range(rounds):
        book = Codebook(_moved(stored, book), book.pivots)

    def code(batches):
        for batch in batches:
            done = list(_assigned(batch, book))
            digits = np.stack([index for _, _, index, _ in done], 1).astype(np.uint8).tobytes().hex() if batch.num_rows else ""
            width = 2 * parts
            codes = [digits[i * width : (i + 1) * width] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in names], pa.array(codes, pa.string()), pa.array(sum(d for *_, d in done))],
                names=[f.name for f in ddl],
            )

    return stored.mapInArrow(code, ddl), book


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over equal labels, nulls together.

    Totals are combined before the shuffle. Those of labels that hold more than one in ``FREQUENT``
    rows, fewer than ``FREQUENT``, are broadcast; other rows meet theirs by a shuffle on the label.
    ``coded`` is read several times, so it is a stored table.
    """
    totals = coded.groupBy(F.col(label_col).alias("_label")).agg(F.count(F.lit(1)).alias("_n"), F.sum("error").alias("label_error"))
    totals = common.stored(totals, "label-errors")
    rows = coded.count()
    often = totals.where(F.col("_n") * FREQUENT > rows).select("_label", "label_error")
    seldom = totals.where(F.col("_n") * FREQUENT <= rows).select("_label", "label_error")
    same = F.col(label_col).eqNullSafe(F.col("_label"))
    return (
        coded.join(F.broadcast(often), same).drop("_label")
        .unionByName(coded.join(F.broadcast(often), same, "left_anti").join(seldom, same).drop("_label"))
    )
