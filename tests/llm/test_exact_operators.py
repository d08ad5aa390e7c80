"""Operators with exact results, against brute force in plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import EDGE, FOLDER, LONG, edge_docs, empty_docs, prose

from dossierlake.llm import decontamination, fingerprints, packing, sharding, similarity_join, url_rules

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# decontamination


def brute_contamination(text, items, window=10):
    words, hit, met = alnum(text), set(), set()
    for item_id, item in items:
        w = alnum(item)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        at = [i for i in range(len(words) - n + 1) if n and tuple(words[i : i + n]) in grams]
        for i in at:
            hit |= set(range(i, i + n))
        if at and item_id is not None:
            met.add(str(item_id))
    return len(words), len(hit), sorted(met)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_contamination_edge_cases(spark, pass_bytes):
    items = [(1, "one two"), (2, None), (3, ""), (4, "ONE"), (4, "ONE"), (None, "one"), (5, " ".join(prose(2, 40).split()[5:25])), (6, "漢字")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(edge_docs(spark), benchmark, pass_bytes=pass_bytes)
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=repr)
    assert rows == sorted(((i, *brute_contamination(t, items)) for i, t in EDGE), key=repr)
    clean = decontamination.drop_contaminated(edge_docs(spark), benchmark, pass_bytes=pass_bytes)
    assert clean.columns == edge_docs(spark).columns
    kept = [(i, t) for i, t in EDGE if not brute_contamination(t, items)[1]]
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted(kept, key=repr)


def test_contamination_empty(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontamination.find_contamination(edge_docs(spark), nothing).collect())
    assert decontamination.find_contamination(empty_docs(spark), nothing).count() == 0


# fingerprints


def plain_phrases(text):
    seen, ends, start = set(), [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            ends.append(end)
            start = end
    return ends


def test_phrases_are_lempel_ziv():
    for text in ("", "a", "aaaaaaaaaa", "abababababab", prose(4, 50), "漢字漢字漢字é", LONG[:5000]):
        assert fingerprints.phrase_ends(text, 0, len(text), set()) == plain_phrases(text)


def brute_fingerprint(text):
    signer = fingerprints.Signer()
    return fingerprints.short(signer.minima(signer.hashes(text, 0, plain_phrases(text))))


@pytest.mark.parametrize("edge", [True, False])
def test_neighbours(spark, edge):
    rows = EDGE if edge else [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    expected = []
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        own, new, nxt = map(brute_fingerprint, (text, edited, following))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        expected.append((i, len(text), digest, own.tobytes().hex(), new.tobytes().hex(), float(np.mean(own == new)), float(np.mean(own == nxt))))
    got = fingerprints.neighbour_fingerprints(edge_docs(spark) if edge else documents(spark))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_fingerprints_edges(spark):
    assert fingerprints.neighbour_fingerprints(empty_docs(spark)).count() == 0
    alone = fingerprints.neighbour_fingerprints(edge_docs(spark, [(1, "abc abc abd")])).first()
    assert alone.near_next == 1.0
    same = {r.doc_id: r.fingerprint for r in fingerprints.phrase_fingerprints(edge_docs(spark)).collect()}
    assert same[9] == same[10] and same[1] == same[2] == fingerprints.EMPTY


# sharding


def least_capacity(sizes, shards):
    """Smallest possible largest sum, over all cuts."""
    prefix = [0, *np.cumsum(sizes).tolist()]
    best = [0] + [10**12] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[h], prefix[i] - prefix[h]) for h in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


def test_minimax_cuts():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 50, rng.integers(1, 30))
        if rng.random() < 0.3:
            sizes[0] = 5000
        shards = int(rng.integers(1, 8))
        cuts, capacity = sharding.minimax_cuts(sizes, shards)
        sums = [int(sizes[a:b].sum()) for a, b in zip(cuts[:-1], cuts[1:])]
        assert cuts[0] == 0 and cuts[-1] == len(sizes) and max(sums) <= capacity == least_capacity(sizes, shards)


@pytest.mark.parametrize("which", ["edge", "documents", "copies"])
def test_shards(spark, which):
    docs = {"edge": edge_docs(spark), "documents": documents(spark)}.get(which)
    if docs is None:
        docs = edge_docs(spark, [(i, "same text" if i % 3 == 0 else prose(i, 5)) for i in range(6000)])
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sharding.contiguous_shards(docs, shards=24).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(
        ((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts), key=repr
    )
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    home = collections.defaultdict(set)
    for r in got:
        home[(r["size"], r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for s in home.values())
    assert sharding.contiguous_shards(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("levels", [(63, 60, 57, 0), (60, 48, 0), (48, 36, 24, 12, 0), (0,)])
def test_cuts_between_single_texts(spark, monkeypatch, levels):
    """However coarse the first groups, the largest shard comes within two texts of the equal share."""
    rng = np.random.default_rng(8)
    texts = ["x" * int(rng.integers(1, 200)) + str(i % 700) for i in range(900)] + [None, ""]
    monkeypatch.setattr(sharding, "LEVELS", levels)
    got = sharding.contiguous_shards(edge_docs(spark, list(enumerate(texts))), shards=7).collect()
    sums, home = collections.Counter(), {}
    for r in got:
        sums[r.shard] += r["size"]
        assert home.setdefault((texts[r.doc_id] or ""), r.shard) == r.shard
    assert len(got) == len(texts) and max(sums.values()) <= sum(sums.values()) / 7 + 2 * 420


# url rules


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.ORG/es/x?q#f"), (4, "HTTP://A.Example.ORG/es/x?q#f"), (5, "x://org"),
            (None, "x://badexample.org/es/"), (6, "x://example.org/en/1234"), (7, "x://my-casino.example.com/en/"), (8, "x://a.com/De/"), (9, "x://h/" + "p" * 50_000)]
    pages = spark.createDataFrame([(i, u, "h", "t", 3) for i, u in rows], "page_id long, url string, host string, token string, place int")
    path = url_rules.path_rules(spark, [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "com", "/de/")])
    got = url_rules.judge_urls(pages, path.unionByName(url_rules.word_rules(spark))).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path[:9], r.rule, r.verdict) for r in got}
    assert by[1] == by[2] == by[3] == ("", "", None, "allow")
    assert by[4] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert by[5] == ("org", "", None, "allow")
    assert by[None] == ("badexample.org", "/es/", "org/", "allow")
    assert by[6] == ("example.org", "/en/1234", "example.org/en/1", "block")
    assert by[7] == ("my-casino.example.com", "/en/", "casino", "block")
    assert by[8] == ("a.com", "/De/", None, "allow")
    assert url_rules.judge_urls(pages.limit(0), path).count() == 0


# packing


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    words = packing.WordIds(open(path, encoding="utf-8").read()).open()
    for text in ("", "Hello,  WORLD's  'LL don't!!", "é É ß ÿ × ÷ \u00a0x\u2003y\x1c\x85", "<|endoftext|> a<|startoftext|>b", "漢字 🙂 Σς e\u0301", "12 345 a1b2 ___|||", LONG[:3000]):
        assert np.frombuffer(words.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("edge", [True, False])
def test_packing(spark, edge):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    docs = edge_docs(spark) if edge else documents(spark)
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            expected.append((r.doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    got = packing.pack(docs, path).collect()
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(expected, key=repr)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(e[3] for e in expected)
    assert len(sequences) <= -(-total // 4096) + 1
    assert packing.pack(empty_docs(spark), path).count() == 0


def test_plan_uses_every_piece():
    rng = np.random.default_rng(2)
    for n in (1, 5, 300, 5000):
        counts = np.bincount(np.minimum(512, 1 + rng.lognormal(3.5, 1.2, n).astype(int)), minlength=513)
        plan = packing.plan_sequences(counts)
        used = np.zeros(513, int)
        room = collections.Counter()
        for length, first, last, per, sequence, _ in zip(*(plan[k] for k in ("length", "first", "last", "per", "sequence", "offset"))):
            assert first == used[length]
            used[length] = last
            for s in range(sequence, sequence + (last - first) // per):
                room[s] += per * length
        assert (used == counts).all() and max(room.values()) <= 512


# similarity join


def brute_links(rows, n, percent):
    sets = []
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
        sets.append(frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset())
    linked = [[bool(a) and bool(b) and k != m and 100 * len(a & b) >= percent * len(a | b) for m, b in enumerate(sets)] for k, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[k], *(label[m] for m in range(len(rows)) if linked[k][m])]) for k in range(len(rows))]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[k] and rows[m][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None, sum(linked[k])))
    return out


@pytest.mark.parametrize("n,percent,blocks,paired", [(3, 90, 256, 16), (5, 80, 2, 1)])
def test_similarity_join(spark, monkeypatch, n, percent, blocks, paired):
    monkeypatch.setattr(similarity_join, "PAIRED", paired)
    rows = list(EDGE)
    base = prose(9, 120).split()
    for k in range(14):
        words = list(base)
        for j in range(k % 5):
            words[(7 * k + 31 * j) % 120] = f"new{k}{j}"
        rows.append((100 + k, " ".join(words)))
    got = similarity_join.link_documents(edge_docs(spark, rows), n=n, percent=percent, block_rows=blocks)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.collect()), key=repr) == sorted(brute_links(rows, n, percent), key=repr)


def test_keep_one(spark):
    docs = edge_docs(spark)
    got = similarity_join.keep_one(docs, n=5, percent=80)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id for r in got.collect()), key=repr)
    assert kept == sorted([1, 2, 3, 4, 5, 6, 8, 9, 11], key=repr)
    assert similarity_join.keep_one(empty_docs(spark)).count() == 0


def test_common_passages_tie_no_texts(spark, monkeypatch):
    rows = [(i, f"the old house stands here u{i} v{i} w{i}") for i in range(60)]
    clusters, real = [], similarity_join.common.checkpoint

    def seen(df):
        out = real(df)
        clusters.extend([out.count()] if "cluster" in out.columns else [])
        return out

    monkeypatch.setattr(similarity_join.common, "checkpoint", seen)
    got = similarity_join.link_documents(edge_docs(spark, rows), n=3, percent=90)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.collect()) == brute_links(rows, 3, 90)
    assert clusters == [0]  # three of six shingles in common, and one of them in the prefix


@pytest.mark.parametrize("size", [3, 7, 40])
def test_groups_met_at_frequent_tokens(spark, monkeypatch, size):
    monkeypatch.setattr(similarity_join, "PAIRED", 5)
    rows = []
    for group in range(3):
        base = prose(20 + group, 80).split()
        for k in range(size):
            words = list(base)
            words[(7 * k + 13) % 80] = f"new{group}x{k}"
            rows.append((100 * group + k, " ".join(words[: 80 - k % 3])))
    got = similarity_join.link_documents(edge_docs(spark, rows), n=3, percent=90, block_rows=16)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.collect()) == brute_links(rows, 3, 90)


def test_keep_one_exchanges_no_text_that_stays(spark):
    rows = [(1, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50)), (3, prose(2, 50)), (None, prose(1, 50)), (4, None), (4, None), (5, ""), (6, prose(3, 50))]
    got = similarity_join.keep_one(edge_docs(spark, rows), n=5, percent=80)
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([1, 2, 4, 4, 5, 6], key=repr)
    whole = got._jdf.queryExecution().sparkPlan()
    assert whole.nodeName() == "Union"
    assert "Join" not in whole.children().apply(0).toString() and "Exchange" not in whole.children().apply(0).toString()
