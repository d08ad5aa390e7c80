"""N-gram Jaccard join with a prefix filter under a global token order."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.llm import common, graph

#: Counters of every frequency sketch, and the slices in which they are summed.
SKETCH_BITS, SLICES = 22, 256
#: Places of the filter that keeps texts without candidates from being read twice: so many a candidate, within these powers of two.
FILTER, FILTER_BITS = 16, (20, 24)
#: Classes of a token that are paired with each other; more are tied to one of them instead.
PAIRED = 16
#: Prefix tokens that a pair has to share; prefixes are longer by all but one of them.
SHARED = 4
#: Classes and shingles of a block; two blocks meet in a task.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 20
#: Prefix tokens that go to the JVM at once.
POSTS = 1 << 17
#: Multipliers of the sketches' hashes.
SKETCHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; with fewer words, of all in one."""
    words = common.blank_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total += h[i : i + len(total)] * np.uint64(pow(0x9FB21C651E98DF25, i + 1, 1 << 64))
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(29)
    return np.unique(total)


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def short_key(key: bytes) -> int:
    """64 bits of a key."""
    return int.from_bytes(key[:8], "big", signed=True)


def place(tokens: np.ndarray, sketch: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter of every token in a sketch, and its 64-bit hash there."""
    mixed = (tokens ^ (tokens >> np.uint64(31))) * np.uint64(SKETCHES[sketch])
    return (mixed >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), mixed


def rarity(counts: np.ndarray) -> np.ndarray:
    """Counters on a scale that 16 bits hold for any count of 32 bits, fine enough to tell neighbouring
    loads apart."""
    return np.round(2047 * np.log2(1.0 + counts)).astype(np.uint16)


def prefix(tokens: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """The first tokens of a set under one global order: by the sum of their counters' logarithms, least first,
    then by hash. What else a counter holds differs from sketch to sketch, so the sum tells more than either. Two sets of the required likeness have at least ``percent`` / 100 of the larger one in
    common, so at most the rest comes before the first ``SHARED`` common tokens of either: they
    share ``SHARED`` tokens of their prefixes (all that is in common, if that is less)."""
    n = len(tokens)
    keep = n - -(-percent * n // 100) + SHARED
    if keep >= n:
        return tokens
    count = np.zeros(n, np.uint64)
    for i, sketch in enumerate(sketches):
        at, mixed = place(tokens, i)
        count += sketch[at]
    key = (count << np.uint64(47)) | (mixed & np.uint64((1 << 47) - 1))
    return tokens[np.argpartition(key, keep - 1)[:keep]]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets, from tokens that at least two of them hold."""
    total = np.zeros((len(sets), len(sets)), np.float32)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    renumber = np.cumsum(shared) - 1
    at = shared[column]
    owner, column = owner[at], renumber[column[at]]
    width = 4096
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    ends = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    for i in range(len(ends) - 1):
        part = slice(ends[i], ends[i + 1])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[part], column[part] - i * width] = 1
        total += held @ held.T
    return total


def links_within(sets: list[np.ndarray], blocks: list[int], sketches: list[np.ndarray], percent: int, cross: bool) -> np.ndarray:
    """Which sets link: pairs that share prefix tokens, then verified exactly. ``cross``: only pairs of
    different blocks."""
    sizes = np.array([len(s) for s in sets], np.int64)
    may = 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
    np.fill_diagonal(may, False)
    if cross:
        b = np.array(blocks)
        may &= b[:, None] != b[None, :]
    if not may.any():
        return may
    least = np.minimum(SHARED, -(-percent * np.maximum.outer(sizes, sizes) // 100))
    may &= overlaps([prefix(s, sketches, percent) for s in sets]) >= least
    rows = np.flatnonzero(may.any(axis=1))
    if not len(rows):
        return may
    both = np.rint(overlaps([sets[i] for i in rows])).astype(np.int64)
    union = sizes[rows][:, None] + sizes[rows][None, :] - both
    out = np.zeros_like(may)
    out[np.ix_(rows, rows)] = may[np.ix_(rows, rows)] & (100 * both >= percent * union)
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """The first member of every member's component."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _sums(rows: DataFrame, finish, kind) -> dict[int, np.ndarray]:
    """Add up partial counters (slice, packed) slice by slice, as a stream; ``finish`` is applied to
    each sum before the slices are collected, in order."""

    def add(rows):
        held: dict[int, np.ndarray] = {}
        for number, packed in rows:
            part = np.frombuffer(zlib.decompress(packed), np.uint32)
            held[number] = held[number] + part if number in held else part.astype(np.int64)
        for number, part in held.items():
            yield number, finish(part).tobytes()

    parts = common.map_rows(rows.repartition("slice"), ["slice", "packed"], add, "slice int, packed binary")
    return {r.slice: np.frombuffer(r.packed, kind) for r in parts.toLocalIterator()}


def _packed(counts: np.ndarray, first: int = 0):
    """Slices of a task's counters of 32 bits."""
    for number, part in enumerate(counts.reshape(SLICES, -1)):
        if part.any():
            yield first + number, zlib.compress(part.tobytes(), 1)


def _joined(parts: dict[int, np.ndarray], first: int, width: int, kind) -> np.ndarray:
    """Slices from ``first`` on in one array; those nobody reported are 0."""
    out = np.zeros((SLICES, width // SLICES), kind)
    for number in range(SLICES):
        if first + number in parts:
            out[number] = parts[first + number]
    return out.reshape(-1)


def _posted(batches, sketches, n: int, percent: int):
    """The prefix tokens of every set, each with its class and size. Short keys only propose: what they stand for is compared later."""
    done: set[bytes] = set()
    held: list[tuple[np.ndarray, int, int]] = []

    def batch():
        lengths = [len(p) for p, _, _ in held]
        columns = [np.concatenate([p for p, _, _ in held]).view(np.int64), np.repeat(np.array([k for _, k, _ in held], np.int64), lengths),
                   np.repeat(np.array([size for _, _, size in held], np.int32), lengths)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "key", "n"])

    waiting = 0
    for (text,) in common.rows_of(batches, "text"):
        tokens = shingles(text, n)
        if len(tokens) and (key := set_key(tokens)) not in done:
            done.add(key)
            held.append((prefix(tokens, sketches.value.open(), percent), short_key(key), len(tokens)))
            waiting += len(held[-1][0])
            if waiting >= POSTS:
                yield batch()
                waiting = 0
    if held:
        yield batch()
    common.give_back()


def _met(batches, percent: int):
    """From posts sorted by token and class: pairs (u, v, their sizes a and b) of classes at tokens of up to
    ``PAIRED`` classes whose sizes allow a link, and the classes (u, a) of more frequent tokens. A token's
    classes are held only until they are known to be too many."""
    empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    held, often = empty, None

    def batch(token, u, v, a, b):
        columns = [pa.nulls(len(u), kind) if c is None else pa.array(c, kind) for c, kind in ((token, pa.int64()), (u, pa.int64()), (v, pa.int64()), (a, pa.int32()), (b, pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["token", "u", "v", "a", "b"])

    def closed(token, key, size):
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        counts = np.diff(np.append(starts, len(token)))
        known = token[starts] == often if often is not None else np.zeros(len(starts), bool)
        many = np.repeat((counts > PAIRED) | known, counts)
        if many.any():
            yield batch(token[many], key[many], None, size[many], None)
        for width in range(2, PAIRED + 1):
            at = starts[(counts == width) & ~known]
            i, j = np.triu_indices(width, 1)
            for some in np.array_split(at, -(-len(at) * len(i) // POSTS) or 1):
                u, v = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                a, b = size[u].astype(np.int64), size[v].astype(np.int64)
                may = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
                if may.any():
                    u, v = u[may], v[may]
                    yield batch(None, key[u], key[v], size[u], size[v])

    for part in batches:
        if not part.num_rows:
            continue
        token, key, size = (np.concatenate([h, part.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("token", "key", "n")))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])  # copies of a class that several tasks posted
        token, key, size = token[new], key[new], size[new]
        cut = int(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))[-1])
        if cut:
            yield from closed(token[:cut], key[:cut], size[:cut])
        held = [token[cut:], key[cut:], size[cut:]]
        if len(held[0]) > PAIRED + 1:
            yield batch(held[0][:-1], held[1][:-1], None, held[2][:-1], None)
            held, often = [h[-1:] for h in held], int(held[0][0])
    if len(held[0]):
        yield from closed(*held)
    common.give_back()


def _edges(found: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes and ties between them whose components hold every link.

    Classes that link share ``SHARED`` prefix tokens, or all they have in common. Where one of these has few classes the pair
    was met there, and what it lacks must be among the frequent tokens of both. Where all are frequent,
    both classes have that many frequent ones, and of these the rarest shared one is not among the last: only there
    a class is tied to the next smaller one, unless their sizes, and so all across that gap, rule a link out.
    """
    least = lambda n: F.least(F.lit(SHARED), F.ceil(n * percent / 100))
    pairs = found.where("token IS NULL").select("u", "v", "tokens", least(F.greatest("a", "b")).alias("needed"))
    often = found.where("token IS NOT NULL").select("token", F.col("u").alias("key"), F.col("a").alias("n"), least(F.col("a")).alias("needed"))
    held = often.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    of = lambda c: held.select(F.col("key").alias(c), F.col("held").alias(f"{c}_held"))
    lacking = pairs.where("tokens < needed").join(of("u"), "u").join(of("v"), "v").where("tokens + least(u_held, v_held) >= needed")
    classes = often.groupBy("token").agg(F.count(F.lit(1)).alias("classes"))
    of_class = Window.partitionBy("key")
    tied = (
        often.withColumn("held", F.count(F.lit(1)).over(of_class)).where("held >= needed").join(classes, "token")
        .withColumn("place", F.row_number().over(of_class.orderBy("classes", "token"))).where("place <= held - needed + 1")
    )
    by_size = Window.partitionBy("token").orderBy("n", "key")
    before = tied.select(F.col("key").alias("u"), "n", F.lag("key").over(by_size).alias("v"), F.lag("n").over(by_size).alias("m"))
    ties = before.where("v IS NOT NULL").where(_may_link(F.col("m"), F.col("n"), percent)).select("u", "v").distinct()
    return ties.unionByName(pairs.where("tokens >= needed").select("u", "v")).unionByName(lacking.select("u", "v"))


def _noted(rows: DataFrame, mark: str) -> np.ndarray:
    """Bits, lowest first, in which the rows have set those of their marks; so many that few others are set by chance."""
    least, most = FILTER_BITS
    places = 1 << min(max((FILTER * rows.count()).bit_length(), least), most)

    def note(rows):
        held = np.zeros(places, np.uint32)
        for (value,) in rows:
            held[value % places] = 1
        yield from _packed(held)

    parts = _sums(common.map_rows(rows, [mark], note, "slice int, packed binary"), lambda part: part > 0, bool)
    return np.packbits(_joined(parts, 0, places, bool), bitorder="little")


def _may_link(a, b, percent: int):
    """Whether sets of these sizes can have the required likeness."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


class Sketches:
    """The sketches as they are broadcast: packed, and unpacked once in every Python worker."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed
        self.opened: list[np.ndarray] | None = None

    def __reduce__(self):
        return Sketches, (self.packed,)

    def open(self) -> list[np.ndarray]:
        if self.opened is None:
            self.opened = [np.frombuffer(zlib.decompress(p), np.uint16) for p in self.packed]
        return self.opened


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Documents whose ``n``-word shingle sets have a Jaccard index of ``percent`` / 100 or more.

    Columns: doc_id, mark (hash of the text), n_shingles, component_id (smallest id reachable by
    links, itself included), n_links (other documents linked directly, copies included) and stays
    (the row is the first of its component).

    Documents of equal sets form one class, and only classes go on. Two sketches over all documents'
    shingles rank them by frequency. Every class posts the prefix of its set under that order. Classes that
    meet at ``SHARED`` tokens of up to ``PAIRED`` classes become pairs, if their sizes allow a link; those that
    may meet at more frequent tokens alone are tied to one of them, so no group is paired out. The
    components of pairs and ties are the candidate groups. They are cut into blocks; two blocks meet in a task, where a pair has to share prefix
    tokens before whole sets are compared. Tasks report one root per class, whose
    components are the result.

    Null and empty texts, and texts of blanks, have no shingles and link with nothing. A null id
    takes part; it is the smallest only where no other is. Repeated rows are copies of each other.
    An empty table gives no rows. Only the two named columns are read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))

    width = 1 << SKETCH_BITS

    def first_pass(rows):
        counts = [np.zeros(width, np.uint32) for _ in SKETCHES]
        for doc_id, text, mark in rows:
            tokens = shingles(text, n)
            for i, held in enumerate(counts):
                np.add.at(held, place(tokens, i)[0], np.uint32(1))
            key = set_key(tokens) if len(tokens) else None
            yield doc_id, mark, len(tokens), key, short_key(key) if key else None, None, None
        for i, held in enumerate(counts):
            for number, packed in _packed(held, i * SLICES):
                yield None, None, None, None, None, number, packed

    read = common.checkpoint(
        common.map_rows(rows, ["doc_id", "text", "mark"], first_pass, f"doc_id {kind}, mark long, n long, key binary, short long, slice int, packed binary")
    )
    parts = _sums(read.where("slice IS NOT NULL").select("slice", "packed"), rarity, np.uint16)
    sketches = spark.sparkContext.broadcast(Sketches([zlib.compress(_joined(parts, i * SLICES, width, np.uint16), 1) for i in range(len(SKETCHES))]))
    members = read.where("slice IS NULL").select("doc_id", "mark", "n", "key", "short")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    classes = members.where("key IS NOT NULL").groupBy("key").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("short").alias("short")
    )

    posts = common.bounded(rows.select("text")).mapInArrow(lambda batches: _posted(batches, sketches, n, percent), "token long, key long, n int")
    together = common.bounded(posts.repartition("token").sortWithinPartitions("token", "key"))
    met = together.mapInArrow(lambda batches: _met(batches, percent), "token long, u long, v long, a int, b int")
    found = common.checkpoint(met.groupBy("token", "u", "v", "a", "b").agg(F.count(F.lit(1)).alias("tokens")))
    grouped = graph.components(_edges(found, percent))
    candidates = common.checkpoint(
        grouped.select(F.col("node").alias("short"), F.col("label").alias("cluster"))
        .join(classes.select("key", "n", "copies", "mark", "short"), "short")
        .drop("short")
    )
    noted = _noted(candidates, "mark")
    places, wanted = len(noted) * 8, spark.sparkContext.broadcast(noted)

    def read_sets(rows):
        held = wanted.value
        done: set[bytes] = set()
        for text, mark in rows:
            place = mark % places
            if held[place >> 3] >> (place & 7) & 1:
                tokens = shingles(text, n)
                if len(tokens) and (key := set_key(tokens)) not in done:
                    done.add(key)
                    yield key, tokens.tobytes()

    sets = common.map_rows(rows, ["text", "mark"], read_sets, "key binary, tokens binary")
    blocks = candidates.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    )
    dealt = (
        candidates.join(blocks, "cluster")
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
        .join(sets, "key")
        .dropDuplicates(["key"])
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("cluster", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "key", "copies", "tokens")
    )
    together = dealt.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "key")

    def verify(rows):
        held: list[tuple] = []
        for row in rows:
            if held and row[:3] != held[0][:3]:
                yield from verified(held)
                held = []
            held.append(row)
        if held:
            yield from verified(held)

    def verified(held):
        linked = links_within(
            [np.frombuffer(r[6], np.uint64) for r in held], [r[3] for r in held], sketches.value.open(), percent, held[0][1] != held[0][2]
        )
        weight = linked @ np.array([r[5] for r in held], np.int64)
        for r, root, links in zip(held, roots(linked).tolist(), weight.tolist()):
            if links:
                yield r[4], held[root][4], links

    found = common.checkpoint(
        common.map_rows(together, ["cluster", "a", "b", "block", "key", "copies", "tokens"], verify, "key binary, root binary, links long")
    )
    labels = graph.components(found.select(F.col("key").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "key")
    linked = labels.join(classes.select("key", "first"), "key")
    firsts = linked.groupBy("label").agg(F.min("first").alias("group_first"))
    grouped = linked.join(firsts, "label").join(found.groupBy("key").agg(F.sum("links").alias("links")), "key").select("key", "group_first", "links")
    resolved = classes.join(grouped, "key", "left").select(
        "key", "copies", F.coalesce("group_first", "first").alias("first"), F.coalesce("links", F.lit(0).cast("long")).alias("links")
    )
    return members.drop("short").join(resolved, "key", "left").select(
        "doc_id",
        "mark",
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0).cast("long")).alias("n_links"),
        (F.col("key").isNull() | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.mark") == F.col("mark")))).alias("stays"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, of every group of near duplicates only the first (by id,
    nulls last, then by the text's hash). Documents without shingles all stay."""
    linked = link_documents(docs, id_col, text_col, n, percent)
    # rows that go, or may have to; all others stay where they are, and no text of theirs is exchanged
    known = linked.groupBy("doc_id", "mark").agg((F.max("n_shingles") == 0).alias("bare"), F.count(F.lit(1)).alias("rows"), F.max("stays").alias("stays"))
    asked = common.checkpoint(known.where("NOT bare AND (rows > 1 OR NOT stays)").select("doc_id", "mark", "stays", F.xxhash64("doc_id", "mark").alias("place")))
    noted = _noted(asked, "place").view(np.int64)
    words = common.local_table(docs.sparkSession, {"words": [noted.tolist()]}, "words array<long>").scalar()
    mark = F.xxhash64(F.col(text_col))
    place = F.pmod(F.xxhash64(F.col(id_col), mark), F.lit(len(noted) * 64))
    word = F.get(words, F.shiftright(place, 6).cast("int"))
    is_asked = F.call_function("shiftright", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    # the row travels as one column, so its own columns cannot clash with these
    rows = docs.where(is_asked).select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), mark.alias("row_mark"))
    joined = rows.join(asked, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_mark") == F.col("mark")), "left").where("stays IS NULL OR stays")
    number = F.row_number().over(Window.partitionBy("row_id", "row_mark").orderBy("row_mark"))
    kept = joined.withColumn("number", number).where("stays IS NULL OR number = 1").select("row.*")
    return docs.where(~is_asked).unionAll(kept)
