"""Document fingerprints: Lempel-Ziv phrases, hashed, as a minimum-hash signature."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm import common

#: Minimum hashes of a signature; 16 bits of each are kept.
HASHES = 128
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
EMPTY = "ffff" * HASHES


def phrase_ends(text: str, start: int, stop: int, seen: set[str]) -> list[int]:
    """LZ78 phrases of ``text[start:stop]``: each is the shortest piece that is not in ``seen``,
    which takes it up. A rest that is known already is no phrase. Returns where phrases end.

    ``seen`` holds with a phrase all its beginnings, so a phrase's length is looked for around the
    length of the one before.
    """
    ends: list[int] = []
    length = 1
    while start < stop:
        end = start + length
        if text[start:end] in seen:
            end += 1
            while end <= stop and text[start:end] in seen:
                end += 1
        else:
            while end - start > 1 and text[start : end - 1] not in seen:
                end -= 1
        if end > stop:
            if text[start:stop] in seen:
                break
            # the guess ran past the end: take the shortest unknown piece before it
            end = stop
            while end - start > 1 and text[start : end - 1] not in seen:
                end -= 1
        seen.add(text[start:end])
        ends.append(end)
        length = end - start
        start = end
    return ends


class Signer:
    """Minimum-hash signatures of phrases, given as positions in a text."""

    def __init__(self, hashes: int = HASHES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.powers, self.inverses = np.cumprod(up), np.cumprod(down)

    def hashes(self, text: str, start: int, ends: list[int]) -> np.ndarray:
        """64-bit hashes of consecutive phrases; a phrase hashes alike wherever it stands."""
        if not ends:
            return np.zeros(0, np.uint64)
        points = np.frombuffer(text[start : ends[-1]].encode("utf-32-le"), "<u4").astype(np.uint64)
        self._powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * self.powers[: len(points)], out=sums[1:])
        at = np.array(ends, np.int64) - start
        begin = np.concatenate([[0], at[:-1]])
        h = (sums[at] - sums[begin]) * self.inverses[begin] + (at - begin).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 2048):
            np.minimum(least, (hashes[at : at + 2048, None] * self.factors).min(axis=0), out=least)
        return least


def short(minima: np.ndarray) -> np.ndarray:
    """The 16 bits of every minimum that are kept."""
    return ((minima >> np.uint64(16)) & np.uint64(0xFFFF)).astype(">u2")


def edit(text: str, following: str) -> str:
    """The last quarter of the text replaced by the beginning of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def signatures(signer: Signer, text: str, edited: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Signatures of a text and of its edited form, which share the phrases of their common start."""
    seen: set[str] = set()
    if edited is None:
        return short(signer.minima(signer.hashes(text, 0, phrase_ends(text, 0, len(text), seen)))), None
    cut = len(text) - len(text) // 4
    ends = phrase_ends(text, 0, cut, seen)
    at = ends[-1] if ends else 0
    common_part = signer.minima(signer.hashes(text, 0, ends))
    out = []
    for form in (edited, text):
        more = phrase_ends(form, at, len(form), seen)
        out.append(short(np.minimum(common_part, signer.minima(signer.hashes(form, at, more)))))
        begin = at
        for end in more:
            seen.discard(form[begin:end])
            begin = end
    return out[1], out[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima: an estimate of the Jaccard index of the phrase sets. Two texts without
    phrases are alike; one without and one with are not."""
    return float(np.mean(a == b))


def phrase_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every whole text: doc_id, n_chars, fingerprint (hex). No shuffle.

    Null and empty texts have no phrases and share one fingerprint; equal texts have equal ones.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(rows):
        signer = Signer()
        for doc_id, text in rows:
            yield doc_id, len(text or ""), signatures(signer, text or "", None)[0].tobytes().hex()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_rows(rows, ["doc_id", "text"], work, f"doc_id {kind}, n_chars long, fingerprint string")


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form and their likeness to each other and to the
    next document's, in ascending order of a numeric id; the last document's next is the first.

    The edited form has the last floor(n/4) code points replaced by the first as many of the next
    text, or by all of it. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Texts travel once: into ranges of ids, sorted, with the first document of the following range as
    a closing row. A task reads its ranges as a stream and holds two texts at a time. The driver sees
    one id and one hash per range.

    Null ids come last; equal ids are ordered by their text's hash, and repeated rows follow each
    other. A null text counts as empty. A single document is its own next. Only named columns are read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ranges = 8 * parts
    cuts = rows.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    bounds = np.unique(np.array(cuts, float))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(float, na_value=np.inf), side="right"))

    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"), range_of("doc_id").alias("range"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    firsts = sorted((r.range, r.first.doc_id, r.first.mark) for r in keyed.groupBy("range").agg(F.min(order).alias("first")).collect())
    if not firsts:
        return spark.createDataFrame([], f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    closing = [(firsts[i - 1][0], firsts[i][1], firsts[i][2]) for i in range(len(firsts))]
    wanted = common.local_table(
        spark, dict(zip(("_before", "_id", "_mark"), map(list, zip(*closing)))), f"_before int, _id {kind}, _mark long"
    )
    closers = (
        keyed.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
        .groupBy("_before")
        .agg(F.min(F.struct("doc_id", "text", "mark")).alias("row"))
        .select("row.doc_id", "row.text", "row.mark", F.col("_before").alias("range"), F.lit(1).alias("closes"))
    )
    dealt = (
        keyed.withColumn("closes", F.lit(0))
        .unionByName(closers)
        .repartition(parts, "range")
        .sortWithinPartitions("range", "closes", F.col("doc_id").isNull(), "doc_id", "mark")
    )

    def work(rows):
        signer = Signer()
        held = waiting = None
        for doc_id, text, closes in rows:
            if held:
                form = edit(held[1], text)
                own, edited = signatures(signer, held[1], form)
                if waiting:
                    yield *waiting[0], likeness(waiting[1], own)
                known = (held[0], len(held[1]), hashlib.sha256(form.encode()).hexdigest())
                waiting = ((*known, own.tobytes().hex(), edited.tobytes().hex(), likeness(own, edited)), own)
            held = (doc_id, text)
            if closes:
                yield *waiting[0], likeness(waiting[1], signatures(signer, text, None)[0])
                held = waiting = None

    return common.map_rows(
        dealt, ["doc_id", "text", "closes"], work,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
