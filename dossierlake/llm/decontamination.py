"""Benchmark decontamination: Wu-Manber search of many test passages at once, over words."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm import common

#: Words of a window, and words of a block whose shift the tables hold.
WINDOW, BLOCK = 10, 2
#: Benchmark text that one pass searches for; a longer benchmark is searched for in several passes.
PASS_BYTES = 1 << 20


class WuManber:
    """Search for many word sequences of one length.

    ``shift`` says for the block of words ending a position how far the position may move on: to
    where that block could end in a pattern. Where it is 0, ``buckets`` holds the patterns that end
    in the block, and comparing them with the words decides.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]], length: int):
        self.length = length
        self.block = min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for words in patterns:
            for end in range(self.block, length + 1):
                key = self.key(words, end)
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            self.buckets[self.key(words, length)].append((words, patterns[words]))

    def key(self, words, end: int):
        """The block that ends before ``end``."""
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def search(self, words: list[bytes]):
        """Start of every occurrence, and what the pattern belongs to."""
        length, most, total = self.length, self.most, len(words)
        shift, buckets, end = self.shift, self.buckets, self.length
        if self.block == 1:
            while end <= total:
                move = shift.get(words[end - 1], most)
                if move:
                    end += move
                    continue
                for pattern, items in buckets[words[end - 1]]:
                    if words[end - length] == pattern[0] and tuple(words[end - length : end]) == pattern:
                        yield end - length, items
                end += 1
            return
        while end <= total:
            block = (words[end - 2], words[end - 1])
            move = shift.get(block, most)
            if move:
                end += move
                continue
            for pattern, items in buckets[block]:
                if words[end - length] == pattern[0] and tuple(words[end - length : end]) == pattern:
                    yield end - length, items
            end += 1


def build_searchers(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One searcher per window length: full windows, and whole items of fewer words."""
    by_length: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = common.alnum_words(text)
        size = min(window, len(words))
        for start in range(len(words) - size + 1 if size else 0):
            by_length[size][tuple(words[start : start + size])].add(item_id)
    return [WuManber(dict(patterns), size) for size, patterns in sorted(by_length.items())]


def scan(words: list[bytes], searchers: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Disjoint word ranges covered by windows, in order, and the items met."""
    ranges: list[tuple[int, int]] = []
    met: set = set()
    for searcher in searchers:
        for start, items in searcher.search(words):
            ranges.append((start, start + searcher.length))
            met |= items
    return merge(ranges), met


def merge(ranges) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _passes(benchmark: DataFrame, item_col: str, text_col: str, pass_bytes: int):
    """The benchmark in portions of about ``pass_bytes``, one at a time on the driver."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // pass_bytes) or 1
    part = F.pmod(F.xxhash64("text"), F.lit(parts))
    for i in range(parts):
        portion = rows if parts == 1 else rows.where(part == i)
        yield [(r.item_id, r.text) for r in portion.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Occurrences of benchmark windows in whole documents.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
    one window. Columns: doc_id, n_words, n_hit (words inside an occurrence), ranges (flat array of
    the starts and ends of the disjoint word ranges that windows cover) and items (distinct ids of
    the items met, sorted as strings).

    One scan of the documents finds all windows of a benchmark up to ``pass_bytes``. A longer one is
    searched for portion by portion, each in tasks of its own, and a document's findings are united;
    so the tables that are broadcast stay bounded.

    Null and empty texts have no words and no hits. An item without words is never found; one with a
    null id hits, but is not listed. Repeated documents are all returned; repeated items count
    once. Without a benchmark every document is clean. Only the named columns are read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"doc_id {kind}, mark long, n_words long, ranges array<long>, items array<string>"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    frames = []
    for items in _passes(benchmark, item_col, item_text_col, pass_bytes):
        tables = spark.sparkContext.broadcast(build_searchers(items, window))

        def work(rows, tables=tables):
            for doc_id, mark, text in rows:
                words = common.alnum_words(text)
                ranges, met = scan(words, tables.value)
                yield doc_id, mark, len(words), [x for r in ranges for x in r], sorted(str(i) for i in met if i is not None)

        frames.append(common.map_rows(rows, ["doc_id", "mark", "text"], work, ddl))
    found = frames[0]
    if len(frames) > 1:
        for frame in frames[1:]:
            found = found.unionAll(frame)
        united = found.groupBy("doc_id", "mark", "n_words").agg(
            F.flatten(F.collect_list("ranges")).alias("ranges"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            (F.count(F.lit(1)) / len(frames)).cast("long").alias("copies"),
        )

        def unite(rows):
            for doc_id, mark, n_words, ranges, items, copies in rows:
                flat = [x for r in merge(zip(ranges[::2], ranges[1::2])) for x in r]
                for _ in range(copies):
                    yield doc_id, mark, n_words, flat, items

        found = common.map_rows(united, ["doc_id", "mark", "n_words", "ranges", "items", "copies"], unite, ddl)
    covered = F.aggregate(
        F.transform("ranges", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return found.select("doc_id", "n_words", covered.alias("n_hit"), "ranges", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns.

    Documents never leave their task. With several portions of the benchmark, what is left is
    written between them, so that a task holds one portion's tables. Null and empty texts stay.
    """
    for number, items in enumerate(_passes(benchmark, item_col, item_text_col, pass_bytes)):
        tables = docs.sparkSession.sparkContext.broadcast(build_searchers(items, window))

        def clean(batches, tables=tables):
            for batch in common.small(batches):
                texts = batch.column(text_col).to_pylist()
                yield batch.filter(pa.array([not any(True for s in tables.value for _ in s.search(w)) for w in map(common.alnum_words, texts)], pa.bool_()))
            common.give_back()

        docs = common.bounded(common.checkpoint(docs) if number else docs).mapInArrow(clean, docs.schema)
    return docs
