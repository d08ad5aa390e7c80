"""Sharding by minimax contiguous partition over ordered atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.llm import common

#: Texts are ordered by their hash, and equal texts share one, so a range of hashes is an atomic
#: group. All groups are first ranges of 48 low bits, 65 536 of them whatever the table's size; those
#: at a cut are then cut by 12 bits more, and so on, until each holds one text only.
LEVELS = (48, 36, 24, 12, 0)


def _pieces_needed(prefix: np.ndarray, capacity: int) -> np.ndarray:
    """For every group, how many shards of ``capacity`` the groups from it on need, filled greedily."""
    n = len(prefix) - 1
    jump = np.searchsorted(prefix, prefix[:-1] + capacity, side="right") - 1
    need = np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[jump[i]]
    return need


def _fits(prefix: np.ndarray, capacity: int, shards: int) -> bool:
    at = 0
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        if at == len(prefix) - 1:
            return True
    return False


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, int]:
    """Cut positive ``sizes``, in order, into ``shards`` runs whose largest sum is least.

    The least capacity is found by binary search with a greedy check. Several cuts keep to it; each
    is put where its shard comes closest to an equal share of what is left, as long as the rest
    still fits. Returns the ``shards + 1`` cut positions and the capacity.
    """
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    n, total = len(prefix) - 1, int(prefix[-1])
    if n == 0:
        return np.zeros(shards + 1, np.int64), 0
    low, high = max(int(np.max(sizes)), -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _fits(prefix, mid, shards) else (mid + 1, high)
    need = _pieces_needed(prefix, low)
    cuts = [0]
    for left in range(shards - 1, 0, -1):
        at = cuts[-1]
        most = int(np.searchsorted(prefix, prefix[at] + low, side="right")) - 1
        # need never rises along the groups: the first group from which the rest fits
        least = max(at, int(np.searchsorted(-need, -left, side="left")))
        goal = prefix[at] + (total - int(prefix[at])) / (left + 1)
        best = int(np.searchsorted(prefix, goal))
        if best > 0 and goal - prefix[best - 1] < prefix[min(best, n)] - goal:
            best -= 1
        cuts.append(min(max(best, least), most))
    return np.array([*cuts, n], np.int64), low


def _atom(bits: int) -> Column:
    return F.shiftleft(F.shiftright("h", bits), bits)


def _sizes(rows: DataFrame, atom: Column) -> dict[int, list]:
    """Rows, bytes and whether it has one text only, of every atom."""
    got = rows.groupBy(atom.alias("atom")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), (F.min("h") == F.max("h")).alias("one")).toArrow()
    return {a: rest for a, *rest in zip(*(got.column(c).to_pylist() for c in ("atom", "n", "b", "one")))}


def contiguous_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, overhead: int = 8) -> DataFrame:
    """Deal documents into ``shards`` shards of nearly equal bytes; equal texts stay together.

    A document's size is the UTF-8 bytes of its text plus ``overhead``. Groups of texts in hash
    order are the atoms of ``minimax_cuts``; those next to a cut are cut finer until they hold one text
    each, and the cuts are found anew. Columns: the id, size, text_crc32, shard and slot (gapless
    from 0 within a shard).

    A null text counts as empty. Null ids are kept. Repeated rows each get a slot. An empty table
    gives no rows. Only the two named columns are read, so further columns cannot clash. A shard
    stays empty only where there are fewer groups than shards, or where a group larger than an
    equal share leaves too few for the rest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    sizes = _sizes(rows, _atom(LEVELS[0]))
    if not sizes:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cut_finer: list[list[int]] = []
    level_of = dict.fromkeys(sizes, 0)
    for level, bits in enumerate(LEVELS[1:]):
        order = sorted(sizes)
        cuts, _ = minimax_cuts(np.array([sizes[a][1] for a in order]), shards)
        beside = {order[i] for c in cuts[1:-1] for i in (c - 1, c) if 0 <= i < len(order)}
        # at most two atoms a cut
        finer = sorted(a for a in beside if level_of[a] == level and not sizes[a][2])
        if not finer:
            break
        cut_finer.append(finer)
        parts = _sizes(rows.where(_atom(LEVELS[level]).isin(finer)), _atom(bits))
        for a in finer:
            del sizes[a], level_of[a]
        sizes |= parts
        level_of |= dict.fromkeys(parts, level + 1)
    order = sorted(sizes)
    counts = {"group": np.array(order, np.int64), "n": np.array([sizes[a][0] for a in order], np.int64)}
    cuts, _ = minimax_cuts(np.array([sizes[a][1] for a in order]), shards)
    group = _atom(LEVELS[len(cut_finer)])
    for level in range(len(cut_finer) - 1, -1, -1):
        group = F.when(_atom(LEVELS[level]).isin(cut_finer[level]), group).otherwise(_atom(LEVELS[level]))
    shard = np.repeat(np.arange(shards), np.diff(cuts))
    before = np.concatenate([[0], np.cumsum(counts["n"])])
    base = before[:-1] - before[cuts[:-1]][shard]
    grouped = rows.withColumn("group", group).drop("h")
    dealt = common.ranked(grouped, "group", ["doc_id", "text_crc32", "size"], counts, base, {"shard": ("int", shard)}, out="slot")
    return dealt.select("doc_id", "size", "text_crc32", "shard", "slot")
