"""Best-fit packing of documents into token sequences by exact-complement hashing."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm import common

CAPACITY = 4096
#: Words whose ids a task keeps in each of two tables, and the longest word kept.
CACHE, KEPT_WORD = 150_000, 64
_PLAIN = re.compile("[\\t-\\r !-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\t-\\r a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for every byte in byte-level vocabularies: printable bytes for
    themselves, the others numbered from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}



class WordIds(dict):
    """Token ids (little-endian uint32) of words and parts of words, looked up once each.

    The tokenizer never joins characters across white space, so a text's ids are those of its words
    in turn. Texts and words of ASCII and Latin-1 letters are split into parts here, which go to the
    model; every other word goes through the whole tokenizer. Lives in a broadcast, so a Python
    worker keeps what it has looked up. A full table becomes the old one, and what is met again moves
    up from there: frequent words stay while memory is bounded.
    """

    def __init__(self, tokenizer_json: str):
        super().__init__()
        self.source = tokenizer_json
        self.tokenizer = None
        self.old: dict[str | bytes, bytes] = {}

    def __reduce__(self):
        return WordIds, (self.source,)

    def open(self) -> WordIds:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.source)
            self.model = self.tokenizer.model
            self.letters = _byte_letters()
        return self

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, _PARTS.findall(text.lower())))
        return b"".join(map(self.__getitem__, text.encode().split()))

    def __missing__(self, key: str | bytes) -> bytes:
        """A part as text, a word as bytes."""
        found = self.old.get(key)
        if found is None:
            found = self.part(key) if isinstance(key, str) else self.word(key.decode())
            if len(key) > KEPT_WORD:
                return found
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

    def word(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self.ids(text)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        shown = text if text.isascii() else "".join([self.letters[b] for b in text.encode()])
        got = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(got)}I", *got)


def token_pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Token ids of whole texts, then ``end_id``, cut into pieces of ``capacity``: doc_id, piece,
    start, length and ids_crc32. A null text counts as empty and so gives one piece of one id."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        words = spark.sparkContext.broadcast(WordIds(f.read()))
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def work(rows):
        table = words.value.open()
        for doc_id, text in rows:
            ids = memoryview(table.ids(text) + end)
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)

    return common.map_rows(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], work,
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long",
    )


class _Stock:
    """How many pieces of every length are left, and which sums they can form."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self.capacity = len(counts) - 1
        self.pairs: np.ndarray | None = None

    def pair_sums(self) -> np.ndarray:
        """Whether two pieces on hand add up to a sum (two of one length may be one; ``pair`` checks)."""
        if self.pairs is None:
            on_hand = np.fft.rfft((self.left > 0).astype(float), 2 * len(self.left))
            self.pairs = np.fft.irfft(on_hand * on_hand)[: len(self.left)] > 0.5
        return self.pairs

    def pair(self, total: int) -> tuple[int, int] | None:
        """The most unequal pair on hand with this sum."""
        if total < 2:
            return None
        small = np.arange(1, total // 2 + 1)
        ok = (self.left[small] > 0) & (self.left[total - small] > 0)
        if total % 2 == 0:
            ok[-1] &= self.left[total // 2] > 1
        at = np.flatnonzero(ok)
        return (int(total - small[at[0]]), int(small[at[0]])) if len(at) else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three pieces on hand with this sum, the largest as large as can be."""
        if total < 3:
            return None
        first = np.arange(total - 2, 0, -1)
        for a in first[(self.left[first] > 0) & self.pair_sums()[total - first]]:
            self.left[a] -= 1
            rest = self.pair(total - int(a))
            self.left[a] += 1
            if rest:
                return int(a), *rest
        return None

    def fill(self, gap: int) -> list[int]:
        """Pieces for a gap: one, two or three that fill it exactly, else the largest that fits and
        so on."""
        taken: list[int] = []
        while gap:
            exact = (gap,) if self.left[gap] else self.pair(gap) or self.triple(gap)
            if exact:
                taken += exact
                for x in exact:
                    self.left[x] -= 1
                break
            fits = np.flatnonzero(self.left[: gap + 1])
            if not len(fits):
                break
            taken.append(int(fits[-1]))
            self.left[fits[-1]] -= 1
            gap -= int(fits[-1])
            self.pairs = None if not self.left[taken[-1]] else self.pairs
        for x in taken:
            self.left[x] += 1
        return taken


def plan_sequences(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Patterns of lengths that fill sequences, from ``counts[length]``, index 0 unused.

    The longest piece on hand opens a pattern, ``fill`` completes it, and the pattern is used as
    often as its pieces last; so each round uses up a length and the plan is bounded by the
    capacity, not by the corpus. Nothing that is left fits into a sequence that is closed.
    Rows of the plan: pieces ``first`` to ``last`` (exclusive) of a ``length`` go, ``per`` in a
    sequence, to sequences from ``sequence`` on, at ``offset``.
    """
    stock = _Stock(np.asarray(counts, np.int64))
    used = np.zeros(len(counts), np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0
    while (on_hand := np.flatnonzero(stock.left)).size:
        longest = int(on_hand[-1])
        stock.left[longest] -= 1
        parts = [longest, *stock.fill(stock.capacity - longest)]
        stock.left[longest] += 1
        lengths, per = np.unique(parts, return_counts=True)
        times = int((stock.left[lengths] // per).min())
        offset = 0
        for length, n in zip(lengths[::-1].tolist(), per[::-1].tolist()):
            rows.append((length, int(used[length]), int(used[length]) + times * n, n, sequence, offset))
            used[length] += times * n
            stock.left[length] -= times * n
            offset += length * n
        if not stock.left[lengths].all():
            stock.pairs = None
        sequence += times
    names = ("length", "first", "last", "per", "sequence", "offset")
    return {k: np.array(v, np.int64) for k, v in zip(names, zip(*sorted(rows)))} if rows else {k: np.zeros(0, np.int64) for k in names}


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = 1) -> DataFrame:
    """Pack whole documents into as few sequences of ``capacity`` tokens as the plan can.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. The driver sees only the
    number of pieces of every length (at most ``capacity`` figures) and plans with them; every piece
    then finds its place by its number among the pieces of its length.

    A null or empty text is one piece with the end id alone. Null and repeated ids and repeated rows
    are all packed. An empty table gives no rows. Only the two named columns are read.
    """
    spark = docs.sparkSession
    pieces = common.checkpoint(token_pieces(docs, tokenizer_file, id_col, text_col, capacity, end_id))
    counts = common.class_counts(pieces, "length")
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[counts["length"]] = counts["n"]
    plan = plan_sequences(histogram)
    shared = spark.sparkContext.broadcast(plan)
    numbered = common.ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"], counts)
    kind = docs.schema[id_col].dataType.simpleString()

    def place(rows):
        p = shared.value
        keys = (p["length"] << 44) + p["first"]
        for doc_id, piece, start, length, crc, rank in rows:
            i = int(np.searchsorted(keys, (length << 44) + rank, side="right")) - 1
            number, within = divmod(rank - int(p["first"][i]), int(p["per"][i]))
            yield doc_id, piece, start, length, crc, int(p["sequence"][i]) + number, int(p["offset"][i]) + within * length

    return common.map_rows(
        numbered, ["doc_id", "piece", "start", "length", "ids_crc32", "rank"], place,
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
