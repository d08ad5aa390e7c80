"""A stored full-text index: positional postings by bucket, totals kept by differences, refreshed by
generations.

Layout under one folder, every part Parquet and keyed by ``generation``:

``postings``   bucket, gram, key, len, at: places of a gram in a document (column and place in one long)
``documents``  key, len: documents that came with the generation
``removed``    key, len: documents that were live before it and are not any more
``totals``     one row: live documents, their length, settings, last batch applied per source

A generation counts once its totals are written. One that was not finished is written anew by the
replay of its batch, and one that was finished is not applied twice.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.operators.search import B, K1, SMALLEST_IDF
from dossierlake.sources.files import delete_path

# executors need not have the library installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS, SPLITS = 64, 4
#: Bits of a place within its column; above them stands the column's number.
PLACE_BITS = 40
#: Places that are put together at once, and that a task takes at most and at least (documents stay whole).
PLACES_AT_ONCE, PLACES_OF_TASK, PLACES_AT_LEAST = 1 << 21, 1 << 23, 1 << 20
TOTALS = (
    "generation int, base int, docs long, length long, buckets int, splits int, tokens string, key string, columns array<string>, "
    "applied map<string,bigint>"
)


def _tokens(text: Column, kind: str) -> Column:
    """Tokens of a text in order: overlapping character trigrams, or words of letters and digits."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    if kind == "trigram":
        return F.regexp_extract_all(lowered, F.lit("(?s)(?=(...))"), F.lit(1))
    return F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrase_tokens(spark: SparkSession, phrase: str, kind: str) -> list[tuple[int, str]]:
    """Tokens that a phrase needs, with their distance from its start; none if it is too short.

    Of trigrams every third one and the last cover all characters."""
    text = phrase.lower()
    if kind == "word":
        return list(enumerate(spark.range(1).select(_tokens(F.lit(text), kind).alias("t")).first().t))
    last = len(text) - 3
    return [(i, text[i : i + 3]) for i in sorted({*range(0, last + 1, 3), last})] if last >= 0 else []


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def _folder(path: str, part: str, generation: int) -> str:
    return f"{path}/{part}/generation={generation}"


class Index:
    """The committed state of a stored index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.schema(TOTALS).parquet(f"{path}/totals").orderBy(F.col("generation").desc()).limit(1).collect()
        self.state = rows[0].asDict()

    def read(self, part: str) -> DataFrame:
        """One part of all generations that count; the first has nothing to remove."""
        first = self.state["base"] + (part == "removed")
        now = [_folder(self.path, part, g) for g in range(first, self.state["generation"] + 1)]
        return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(*now)

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows of documents that no later generation removed; the index of one generation has none
        to look for."""
        if self.state["base"] == self.state["generation"]:
            return rows
        gone = self.read("removed").groupBy(F.col("key").alias("_key")).agg(F.max("generation").alias("_gone"))
        return rows.join(gone, (F.col("key") == F.col("_key")) & (F.col("generation") < F.col("_gone")), "left_anti")

    def documents(self) -> DataFrame:
        """key, len of all live documents."""
        return self.live(self.read("documents")).select("key", "len")

    def postings(self, grams: list[str] | None = None) -> DataFrame:
        """Live postings: gram, key, len, at; of some grams only their buckets are read."""
        rows = self.read("postings")
        if grams is not None:
            buckets = sorted({zlib.crc32(g.encode()) % self.state["buckets"] for g in grams})
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        return self.live(rows).select("gram", "key", "len", "at")


def _measured(docs: DataFrame, key: str, columns: list[str], tokens: str) -> DataFrame:
    """key, len and what the tokens of every column are made of: its text in small letters, or its words."""
    lowered = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    if tokens == "trigram":
        parts, sizes = lowered, [F.greatest(F.length(t) - 2, F.lit(0)) for t in lowered]
    else:
        parts = [_tokens(F.col(c), tokens) for c in columns]
        sizes = [F.size(t) for t in parts]
    return docs.select(F.col(key).alias("key"), sum(sizes, F.lit(0)).cast("long").alias("len"), *[t.alias(f"_t{i}") for i, t in enumerate(parts)])


def _trigrams(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Token number, row and place of every trigram, ordered by row and place; and the tokens in order."""
    texts = [t for row in zip(*[c.to_pylist() for c in columns]) for t in row]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.append([0], ends[:-1])
    count = np.maximum(ends - starts - 2, 0)
    segment = np.repeat(np.arange(len(texts)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = place + starts[segment]
    codes = points[at] << 42 | points[at + 1] << 21 | points[at + 2]
    known, number = np.unique(codes, return_inverse=True)
    names = [chr(x >> 42) + chr(x >> 21 & 0x1FFFFF) + chr(x & 0x1FFFFF) for x in known.tolist()]
    return number, segment // len(columns), place + (segment % len(columns) << PLACE_BITS), pa.array(names, pa.string())


def _words(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The same of lists of words."""
    sizes = [c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    at = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (i << PLACE_BITS) for i, n in enumerate(sizes)])
    coded = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
    by_row = np.argsort(row, kind="stable")
    return coded.indices.to_numpy()[by_row], row[by_row], at[by_row], coded.dictionary


def _grouped(batch: pa.RecordBatch, kind: str) -> pa.RecordBatch:
    """gram, key, len and places of some documents, grams together."""
    number, row, at, names = (_trigrams if kind == "trigram" else _words)(batch.columns[2:])
    order = np.argsort(number, kind="stable")
    number, row, at = number[order], row[order], at[order]
    opens = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (row[1:] != row[:-1]))) if len(number) else number
    places = pa.ListArray.from_arrays(pa.array(np.append(opens, len(number)), pa.int32()), pa.array(at, pa.int64()))
    of = pa.array(row[opens], pa.int64())
    return pa.RecordBatch.from_arrays([names.take(pa.array(number[opens], pa.int64())), batch.column(0).take(of), batch.column(1).take(of), places], ["gram", "key", "len", "at"])


def _postings(rows: DataFrame, kind: str) -> DataFrame:
    """gram, key, len, at of measured documents. A document is one row, so its places are put together
    where it is read, some millions of places at a time; nothing is exchanged."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, first = np.cumsum(batch.column(1).to_numpy()), 0
            while first < batch.num_rows:
                before = ends[first - 1] if first else 0
                last = max(int(np.searchsorted(ends, before + PLACES_AT_ONCE, "right")), first + 1)
                yield _grouped(batch.slice(first, last - first), kind)
                first = last

    key = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(grouped, f"gram string, key {key}, len bigint, at array<bigint>")


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _write_generation(docs: DataFrame, path: str, state: dict) -> None:
    """Postings and documents of one generation.

    Documents are dealt out by key, some millions of places to a task. Each task writes the postings of
    its documents, a file per bucket sorted by gram, so that statistics prune; no gram is gathered in
    one task, however frequent."""
    generation = state["generation"]
    rows = _measured(docs, state["key"], state["columns"], state["tokens"])
    rows.select("key", "len").write.mode("overwrite").parquet(_folder(path, "documents", generation))
    places = _sums(docs.sparkSession.read.parquet(_folder(path, "documents", generation)))[1]
    parts = max(-(-places // PLACES_OF_TASK), min(docs.sparkSession.sparkContext.defaultParallelism, -(-places // PLACES_AT_LEAST)), 1)
    kept = docs.select(state["key"], *state["columns"]).repartition(parts, state["key"])
    placed = _postings(_measured(kept, state["key"], state["columns"], state["tokens"]), state["tokens"])
    (
        placed.withColumn("bucket", _bucket(F.col("gram"), state["buckets"])).sortWithinPartitions("bucket", "gram")
        .write.mode("overwrite").partitionBy("bucket").parquet(_folder(path, "postings", generation))
    )


def _sums(rows: DataFrame) -> tuple[int, int]:
    return tuple(rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first())


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    names = [f.split(" ")[0] for f in TOTALS.replace("map<string,bigint>", "map").split(", ")]
    row = spark.createDataFrame([tuple(state[n] for n in names)], TOTALS).coalesce(1)
    row.drop("generation").write.mode("overwrite").parquet(_folder(path, "totals", state["generation"]))


def build_index(docs: DataFrame, key: str, columns: list[str], path: str, buckets: int = BUCKETS, splits: int = SPLITS,
                tokens: str = "trigram") -> Index:
    """Write the index of ``docs``, distinct by ``key``, to an unused folder. ``tokens`` is 'trigram',
    or 'word' for texts without part-of-word search. ``splits`` is the number of files of a bucket after
    ``compact``."""
    state = {
        "generation": 0, "base": 0, "buckets": buckets, "splits": splits, "tokens": tokens, "key": key, "columns": columns, "applied": {},
    }
    _write_generation(docs, path, state)
    spark = docs.sparkSession
    state["docs"], state["length"] = _sums(spark.read.parquet(_folder(path, "documents", 0)))
    _commit(spark, path, state)
    return Index(spark, path)


def apply_batch(spark: SparkSession, path: str, changes: DataFrame, source: str, batch_id: int, ordinal: str = "seq") -> Index:
    """Add one batch of changes: the key, ``op`` ('upsert' or 'delete'), an ordinal and the columns.

    The last change of a key counts. Count and length of the collection move by what came and what
    went; nothing else is read. ``source`` names the stream, whose batches come in order: a batch
    that was applied is skipped, one that failed half-way is written anew.
    """
    index = Index(spark, path)
    state = index.state
    if state["applied"].get(source, -1) >= batch_id:
        return index
    generation = state["generation"] + 1
    rest = [c for c in changes.columns if c != state["key"]]
    last = changes.groupBy(state["key"]).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(state["key"], "_r.*")
    changed = last.select(F.col(state["key"]).alias("key"))
    index.documents().join(changed, "key", "left_semi").write.mode("overwrite").parquet(_folder(path, "removed", generation))
    state = {**state, "generation": generation, "applied": {**state["applied"], source: batch_id}}
    _write_generation(last.where(F.col("op") == "upsert"), path, state)
    gone = _sums(spark.read.parquet(_folder(path, "removed", generation)))
    come = _sums(spark.read.parquet(_folder(path, "documents", generation)))
    state["docs"] += come[0] - gone[0]
    state["length"] += come[1] - gone[1]
    _commit(spark, path, state)
    return Index(spark, path)


def compact(spark: SparkSession, path: str) -> Index:
    """Write what is live as one generation; earlier ones are no longer read (``vacuum`` drops them)."""
    index = Index(spark, path)
    state = {**index.state, "generation": index.state["generation"] + 1}
    state["base"] = state["generation"]
    index.documents().write.mode("overwrite").parquet(_folder(path, "documents", state["generation"]))
    rows = index.postings().withColumn("bucket", _bucket(F.col("gram"), state["buckets"]))
    split = F.pmod(F.xxhash64("key"), F.lit(state["splits"]))
    (
        rows.repartition(state["buckets"] * state["splits"], "bucket", split).sortWithinPartitions("bucket", "gram")
        .write.mode("overwrite").partitionBy("bucket").parquet(_folder(path, "postings", state["generation"]))
    )
    _commit(spark, path, state)
    return Index(spark, path)


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete generations that are no longer read; only while no query reads them."""
    base = Index(spark, path).state["base"]
    for part in ("postings", "documents", "removed", "totals"):
        for generation in range(base):
            delete_path(spark, _folder(path, part, generation))


def phrase_frequencies(index: Index, phrases: list[str], weights: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """Documents that hold at least one of the phrases: key, len and per phrase its weighted,
    overlapping occurrences ``f0``, ``f1``, ...; and the phrases, without those too short to match.

    Reads the buckets of the phrases' grams once and no text. Only documents with all grams of a
    phrase are compared place by place.
    """
    spark, state = index.spark, index.state
    needed = {p: phrase_tokens(spark, p, state["tokens"]) for p in dict.fromkeys(phrases)}
    needed = {p: t for p, t in needed.items() if t}
    grams = sorted({g for t in needed.values() for _, g in t})
    number = {g: i for i, g in enumerate(grams)}
    rows = index.postings(grams)
    at = [F.max(F.when(F.col("gram") == g, F.col("at"))).alias(f"_a{i}") for g, i in number.items()]
    found = rows.groupBy("key", "len").agg(*at or [F.lit(0).alias("_a")])
    weight = F.array(*[F.lit(float((weights or {}).get(c, 0.0 if weights else 1.0))) for c in state["columns"]])
    frequencies = []
    for i, tokens in enumerate(needed.values()):
        starts = None
        for distance, gram in tokens:
            moved = _moved(F.col(f"_a{number[gram]}"), distance)
            starts = moved if starts is None else F.array_intersect(starts, moved)
        weighted = F.aggregate(starts, F.lit(0.0), lambda s, x: s + F.get(weight, F.shiftright(x, PLACE_BITS).cast("int")))
        frequencies.append(F.coalesce(weighted, F.lit(0.0)).alias(f"f{i}"))
    any_hit = F.lit(False)
    for i in range(len(needed)):
        any_hit = any_hit | (F.col(f"f{i}") > 0)
    return found.select("key", "len", *frequencies).where(any_hit), list(needed)


def phrase_matches(index: Index, phrase: str, columns: list[str] | None = None) -> DataFrame:
    """Keys of the documents that hold the phrase in any of the columns (default: all)."""
    found, _ = phrase_frequencies(index, [phrase], {c: 1.0 for c in columns} if columns else None)
    return found.select(F.col("key").alias(index.state["key"]))


def bm25(index: Index, phrases: list[str], weights: dict[str, float]) -> DataFrame:
    """Negative BM25 of an OR query over the stored index; smaller is better.

    The collection's count and mean length come from the totals, the number of documents of a phrase
    from the same grouped postings.
    """
    key = index.state["key"]
    found, kept = phrase_frequencies(index, phrases, weights)
    docs = float(index.state["docs"])
    mean = index.state["length"] / docs if docs else 0.0
    counts = found.agg(F.struct(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(kept))], F.lit(0).alias("_")).alias("t")).scalar()
    scored = found.withColumn("_n", counts)
    norm = K1 * (F.lit(1 - B) + B * F.col("len") / F.lit(mean or 1.0))
    score = F.lit(0.0)
    for i in range(len(kept)):
        n, f = F.col(f"_n.n{i}"), F.col(f"f{i}")
        idf = F.ln((F.lit(docs) - n + 0.5) / (n + 0.5))
        score = score - F.when(idf <= 0, F.lit(SMALLEST_IDF)).otherwise(idf) * f * (K1 + 1) / (f + norm)
    return scored.select(F.col("key").alias(key), score.alias("score"))


def search(index: Index, phrases: list[str], weights: dict[str, float], limit: int | None = None) -> DataFrame:
    """Best documents first, all or the first ``limit``."""
    best = bm25(index, phrases, weights).orderBy("score", index.state["key"])
    return best if limit is None else best.limit(limit)


def routed_search(index: Index, cards: DataFrame, query: str, weights: dict[str, float], facility: str | None = None,
                  result: str | None = None, keywords: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Short queries list all cards, longer ones search the stored index. Filters apply first, then
    the best ``limit`` of what they leave; scores are those of the whole collection."""
    from dossierlake.operators.comparison import card_filter

    text = (query or "").strip()
    wanted = card_filter(cards, facility, result)
    if len(text) <= 2:
        return wanted
    hits = wanted.join(bm25(index, keywords or [text], weights), index.state["key"])
    return hits if limit is None else hits.orderBy("score", index.state["key"]).limit(limit)


def start_index_refresh(spark: SparkSession, landing: str, schema, path: str, checkpoint: str):
    """Stream over a landing folder of change records that keeps the stored index up to date."""
    changes = spark.readStream.schema(schema).parquet(landing)

    def run(batch: DataFrame, batch_id: int) -> None:
        apply_batch(spark, path, batch, checkpoint, batch_id)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
