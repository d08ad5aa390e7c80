"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm import common

#: Bits of the filters per word, bits that a word sets, and bytes of the filters that are broadcast
#: at a time. A larger vocabulary takes more passes.
BITS_PER_WORD, SET_BITS, PASS_BYTES = 24, 5, 16 << 20
#: Edits that a task holds at a time.
BLOCK = 1 << 18
#: Words that a task counts before it hands them on.
COUNTED = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = "A-Za-zÀ-ÿ",
                 min_length: int = 7, min_count: int = 2, drop_one_in: int = 31) -> DataFrame:
    """Words of whole texts with their number of occurrences: word, n.

    A word is a maximal run of ``letters``, A-Z lower-cased. Where the crc32 of ``id:run`` is
    divisible by ``drop_one_in``, the code point at crc32 modulo the length is left out, which gives
    every corpus its misspellings; 0 leaves all as they are. Words of fewer code points or
    occurrences are left out. A null text has no words, a null id counts as an empty text.
    """
    # a run that is too short has no longer run inside
    runs = re.compile(f"[{letters}]{{{min_length},}}")

    def work(rows):
        counts: dict[str, int] = {}
        for doc_id, text in rows:
            if not text:
                continue
            here: dict[str, int] = {}
            for run in runs.findall(text.encode().translate(common.LOWER).decode()):
                here[run] = here.get(run, 0) + 1
            name = "" if doc_id is None else str(doc_id)
            for word, n in here.items():
                if drop_one_in:
                    h = zlib.crc32(f"{name}:{word}".encode())
                    if h % drop_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                counts[word] = counts.get(word, 0) + n
            if len(counts) > COUNTED:
                yield from counts.items()
                counts = {}
        yield from counts.items()

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen = common.map_rows(plain, ["doc_id", "text"], work, "word string, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _BASE)]), dtype=np.uint64)[:n]


def _code_points(words: pa.Array):
    """Words of one length at a time, at most ``BLOCK`` letters (or one word): length, places in the
    batch, matrix of code points."""
    listed = words.to_pylist()
    lengths = np.fromiter(map(len, listed), np.int64, len(listed))
    for length in np.unique(lengths[lengths > 0]).tolist():
        same = np.flatnonzero(lengths == length)
        step = max(1, BLOCK // length)
        for i in range(0, len(same), step):
            at = same[i : i + step]
            joined = "".join([listed[j] for j in at]).encode("utf-32-le")
            yield length, at, np.frombuffer(joined, "<u4").reshape(len(at), length).astype(np.uint64)


def _sums(points: np.ndarray) -> np.ndarray:
    """Polynomial hash of every row, before mixing."""
    return (points * _powers(points.shape[1])).sum(1, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _mask(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), np.uint64)
    for k in range(SET_BITS):
        out |= np.uint64(1) << ((h >> np.uint64(64 - 6 * (k + 1))) & np.uint64(63))
    return out


class Shard:
    """Part of a filter: words of one length, or of one slice of their hashes, in blocks of 64 bits."""

    def __init__(self, length: int, part: int, parts: int, base: int, blocks: int):
        self.length, self.part, self.parts, self.base, self.blocks = length, part, parts, base, blocks

    def place(self, h: np.ndarray) -> np.ndarray:
        """The block of every hash, -1 where it belongs to another slice."""
        block = (h // np.uint64(self.parts) % np.uint64(self.blocks)).astype(np.int64) + self.base
        return block if self.parts == 1 else np.where(h % np.uint64(self.parts) == np.uint64(self.part), block, -1)


def plan_passes(sizes: dict[int, int], pass_bytes: int = PASS_BYTES) -> list[list[Shard]]:
    """Filters for ``sizes[length]`` words, dealt into passes of at most ``pass_bytes`` each."""
    most = pass_bytes // 8
    passes: list[list[Shard]] = []
    used = most + 1
    for length, n in sorted(sizes.items()):
        parts = max(1, -(-n * BITS_PER_WORD // (64 * most)))
        blocks = max(1, min(most, -(-n * BITS_PER_WORD // (64 * parts))))
        for part in range(parts):
            if used + blocks > most:
                passes.append([])
                used = 0
            passes[-1].append(Shard(length, part, parts, used, blocks))
            used += blocks
    return passes


def _filter_bits(words: DataFrame, shards: list[Shard]) -> np.ndarray:
    """The filter of one pass: every word sets its bits; words of a block are combined by Spark, and
    what comes to the driver is bounded by the size of a pass."""
    lengths = sorted({s.length for s in shards})

    def bits(batches):
        for batch in batches:
            for length, _, points in _code_points(batch.column(0)):
                h = _mixed(_sums(points))
                for s in shards:
                    if s.length == length:
                        block = s.place(h)
                        keep = block >= 0
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(block[keep]), pa.array(_mask(h[keep]).view(np.int64))], names=["block", "mask"]
                        )

    size = F.length("word")
    chosen = words.where(size.between(lengths[0], lengths[-1])).select("word")
    got = chosen.mapInArrow(bits, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(max(s.base + s.blocks for s in shards), np.uint64)
    out[got.column("block").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return out


def _edits(points: np.ndarray, alphabet: np.ndarray, change: bool, drop: bool):
    """Edits of words of one length, in blocks: the kind's shift in length, row, place, new code
    point (-1: deleted), hash. Replacements only by greater code points, deletions only of the first
    of equal neighbours; the other word of a pair or the other letter gives the rest."""
    rows, length = points.shape
    power = _powers(length)
    term = points * power
    before = np.cumsum(term, 1, dtype=np.uint64) - term
    total = before[:, -1] + term[:, -1]
    if drop:
        for at in range(0, rows, max(1, BLOCK // length)):
            part = slice(at, at + max(1, BLOCK // length))
            h = before[part] + (total[part, None] - before[part] - term[part]) * _BACK
            first = np.ones(h.shape, bool)
            first[:, 1:] = points[part, 1:] != points[part, :-1]
            row, place = np.nonzero(first)
            yield -1, row + at, place, np.full(len(row), -1), _mixed(h[row, place])
    if change:
        # flat places of the matrix, so that one very long word is cut as well
        step = max(1, BLOCK // max(1, len(alphabet)))
        flat, sums = points.ravel(), total
        for at in range(0, flat.size, step):
            where = np.arange(at, min(at + step, flat.size))
            row, place = np.divmod(where, length)
            old = flat[where]
            i, a = np.nonzero(alphabet[None, :] > old[:, None])
            h = sums[row[i]] + (alphabet[a] - old[i]) * power[place[i]]
            yield 0, row[i], place[i], alphabet[a].astype(np.int64), _mixed(h)


def _positives(words: DataFrame, shards: list[Shard], bits, alphabet: np.ndarray) -> DataFrame:
    """Edits that a filter lets pass: hash of the edit, of the word, place and new code point."""

    def probe(batches):
        bitmap = bits.value
        by_length: dict[int, list[Shard]] = {}
        for s in shards:
            by_length.setdefault(s.length, []).append(s)
        for batch in batches:
            for length, _, points in _code_points(batch.column(0)):
                if length not in by_length and length - 1 not in by_length:
                    continue
                own = _mixed(_sums(points))
                for shift, row, place, new, h in _edits(points, alphabet, length in by_length, length - 1 in by_length):
                    mask = _mask(h)
                    for s in by_length.get(length + shift, ()):
                        block = s.place(h)
                        hit = np.flatnonzero((block >= 0) & ((bitmap[block] & mask) == mask))
                        if len(hit):
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(h[hit].view(np.int64)), pa.array(own[row[hit]].view(np.int64)),
                                    pa.array(place[hit]), pa.array([chr(c) if c >= 0 else "" for c in new[hit].tolist()], pa.string()),
                                ],
                                names=["edit", "own", "place", "new"],
                            )

    return words.select("word").mapInArrow(probe, "edit long, own long, place long, new string")


def _hashed(words: DataFrame) -> DataFrame:
    """word, n and the word's hash."""

    def work(batches):
        for batch in batches:
            h = np.zeros(batch.num_rows, np.int64)
            for _, at, points in _code_points(batch.column(0)):
                h[at] = _mixed(_sums(points)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h)], names=["word", "n", "h"])

    return words.select("word", "n").mapInArrow(work, "word string, n long, h long")


def near_pairs(words: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Pairs of distinct words that differ by exactly one inserted, deleted or replaced code point,
    each once: word, n, other, other_n. ``words`` is a stored table of distinct words.

    Deletions and replacements of every word are generated and tried against Bloom filters of the
    vocabulary, one shard for every length; an insertion is the other word's deletion. Only what a
    filter lets pass is shuffled, as hashes, to the vocabulary, and what is left is compared letter
    by letter. Filters are broadcast at most ``pass_bytes`` at a time: a larger vocabulary is dealt
    into more passes, a length too large for one into slices of the hash.
    """
    spark = words.sparkSession
    sizes = {r.size: r.n for r in words.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect() if r.size}
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()
    alphabet = np.array(sorted(ord(r.c) for r in letters if r.c), np.uint64)
    vocabulary = common.stored(_hashed(words), "vocabulary")
    found = None
    for shards in plan_passes(sizes, pass_bytes):
        bits = spark.sparkContext.broadcast(_filter_bits(words, shards))
        part = common.stored(_positives(words, shards, bits, alphabet), "edits")
        bits.destroy()
        found = part if found is None else found.unionAll(part)
    if found is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    left = vocabulary.select("word", "n", F.col("h").alias("own"))
    right = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("h").alias("edit"))
    place = F.col("place").cast("int")
    edited = F.concat(F.substr("word", F.lit(1), place), "new", F.substr("word", place + 2))
    return found.join(right, "edit").join(left, "own").where(F.col("other") == edited).select("word", "n", "other", "other_n")


def group_variants(words: DataFrame, ratio: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Every word with its accepted form: word, n, n_near, form, form_n, root.

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of these (ties: smallest
    in code-point order) if it occurs at least ``ratio`` times as often, else null; ``root`` follows
    forms to the last and is the word itself where there is none.

    ``words`` has distinct non-null words and their counts (``corpus_words``); an empty table gives
    no rows; words may be of any length.
    """
    words = common.stored(words.select("word", "n"), "words")
    both = F.explode(
        F.array(
            F.struct(F.col("word").alias("a"), F.col("n").alias("an"), F.col("other").alias("b"), F.col("other_n").alias("bn")),
            F.struct(F.col("other").alias("a"), F.col("other_n").alias("an"), F.col("word").alias("b"), F.col("n").alias("bn")),
        )
    )
    pairs = near_pairs(words, pass_bytes).select(both.alias("p"))
    best = pairs.groupBy(F.col("p.a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("p.bn")).alias("rank"), F.col("p.b").alias("near"))).alias("best")
    )
    enough = -F.col("best.rank") >= F.col("n") * ratio
    near = common.stored(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.rank")).alias("form_n"),
        ),
        "variants",
    )
    # every form is `ratio` times as frequent, so the longest chain follows from the largest count
    most, least = near.agg(F.max("n"), F.min("n")).first()
    steps = 0 if not most else int(math.log(most / max(1, least), ratio) + 1e-9)
    roots = near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = common.stored(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return near.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
