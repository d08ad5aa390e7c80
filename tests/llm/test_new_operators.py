"""Vector codes, spelling variants and secrets against brute force in plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from llm_helpers import EDGE, edge_docs, empty_docs, prose

from dossierlake.llm import common, secrets, spelling, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, c0 int, _label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "x", 0, 0) for i, v, y in rows], VECTORS)


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    whole = [[math.floor(scale * float(np.float32(x))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    size = width // parts
    order = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], [np.float32(x) for x in kept[k][1]]))
    out = [["", 0] for _ in kept]
    final = []
    for p in range(parts):
        x = [w[p * size : (p + 1) * size] for w in whole]
        book = [x[k] for k in order[:entries]]
        near = lambda a: min((sum((s - t) ** 2 for s, t in zip(a, b)), i) for i, b in enumerate(book))  # noqa: B023, E731
        for _ in range(rounds):
            groups = collections.defaultdict(list)
            for a in x:
                groups[near(a)[1]].append(a)
            book = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else b for i, b in enumerate(book)]
        for k, a in enumerate(x):
            d, i = near(a)
            out[k][0] += f"{i:02x}"
            out[k][1] += d
        final += [c for b in book for c in b]
    return sorted(((kept[k][0], kept[k][2], *out[k]) for k in range(len(kept))), key=repr), hashlib.sha256(",".join(map(str, final)).encode()).hexdigest()


def draw(n, width=8, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (6, width))
    return [(i, list(centres[rng.integers(6)] + rng.normal(0, 0.1, width)), i % 3) for i in range(n)]


@pytest.mark.parametrize("entries", [5, 40, 256])
def test_codes(spark, entries):
    rows = draw(120)
    rows += [(7, rows[7][1], 1), (500, rows[3][1], None), (None, rows[5][1], 2), (501, [0.0] * 8, None), (502, rows[1][1][:5], 0), (503, [], 0)]
    bad = [(600, None, 1), (601, [1.0, None] * 4, 1), (602, [math.nan] * 8, 1), (-1, [math.inf] * 8, 1)]
    coded, book = vector_codes.encode_vectors(vectors(spark, rows + bad), keep=["label"], entries=entries)
    expected, digest = brute_codes(rows, entries=entries)
    coded = common.stored(coded, "codes")
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in coded.collect()), key=repr) == expected and book.digest() == digest
    totals = collections.Counter()
    for _, y, _, e in expected:
        totals[y] += e
    got = vector_codes.label_errors(coded).collect()
    assert len(got) == len(expected) and all(r.label_error == totals[r.label] for r in got)


def test_seldom_labels_meet_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "FREQUENT", 3)
    coded = spark.createDataFrame([(1, None, 5), (2, 1, 7), (3, 1, 1), (4, 1, 2), (5, 2, 9), (6, None, 1)], "vec_id long, label int, error long")
    got = {r.vec_id: r.label_error for r in vector_codes.label_errors(coded).collect()}
    assert got == {1: 6, 6: 6, 2: 10, 3: 10, 4: 10, 5: 9}


def test_codes_of_nothing_and_of_huge_values(spark):
    coded, book = vector_codes.encode_vectors(vectors(spark, [(1, None, 1)]), keep=["label"])
    assert coded.count() == 0 and book is None and coded.columns == ["vec_id", "label", "code", "error"]
    coded, _ = vector_codes.encode_vectors(vectors(spark, [(i, [3e38 * (-1) ** i, 1.0, 2.0, i], 1) for i in range(9)]), entries=2)
    assert all(r.error >= 0 for r in coded.collect())
    coded, _ = vector_codes.encode_vectors(vectors(spark, [(None, [1.0] * 4, 1), (None, [2.0] * 4, 1)]))
    assert sorted(r.code for r in coded.collect()) == ["00000000", "01010101"]


def test_pruned_search_is_exact():
    rng = np.random.default_rng(5)
    for most in (3, 300, 40_000, 1 << 27):
        x, entries = rng.integers(-most, most, (500, 6)), rng.integers(-most, most, (50, 6))
        x[:50] = entries
        entries[7] = entries[3]
        pivots = vector_codes.choose_pivots(entries, 4)
        got, d, evaluated = vector_codes.nearest(x, vector_codes._distances(x, pivots), entries, vector_codes._distances(entries, pivots))
        exact = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (got == exact.argmin(1)).all() and (d == exact.min(1)).all()
    near, far = rng.integers(-5, 5, (200, 6)), np.repeat(np.arange(50) * 1000, 6).reshape(50, 6)
    pivots = vector_codes.choose_pivots(far, 4)
    _, _, evaluated = vector_codes.nearest(near, vector_codes._distances(near, pivots), far, vector_codes._distances(far, pivots))
    assert evaluated <= vector_codes.FIRST * 200


# spelling


def brute_words(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items())


def found_variants(words, **options):
    got = spelling.group_variants(words, **options)
    return sorted(tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_words(spark):
    rows = EDGE + [(20 + i, f"Straßenbahn ÉCOLE-école naïveté×÷ {prose(i, 60)} accommodation Accommodation") for i in range(60)]
    rows += [(i, re.sub("[0-9]+", "lettering", t)) for i, t in rows[-60:]]
    got = {r.word: r.n for r in spelling.corpus_words(edge_docs(spark, rows)).collect()}
    assert got == brute_words(rows) and len(got) > 20


WORDS = {
    "aaaaaaa": 2, "aaaaaaaa": 25, "aaaaaaaaa": 300, "aaaaaaaaaa": 4000, "baaaaaaa": 25, "abababab": 2, "bababab": 2, "abababa": 2,
    "colour-": 5, "colours": 50, "coleurs": 5, "coloursé": 2, "écolours": 2, "zebrazz": 2, "zebrazx": 20, "zebrazy": 20, "漢字漢字漢字漢": 3, "漢字漢字漢字字": 30,
}


@pytest.mark.parametrize("pass_bytes", [16 << 20, 16])
def test_variants(spark, pass_bytes):
    """The small pass makes many passes, and slices of a length."""
    words = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    assert found_variants(words, pass_bytes=pass_bytes) == brute_variants(WORDS)
    assert found_variants(words.limit(0)) == []


def test_long_words(spark):
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("abcdefgh"), 40_000))
    words = {long: 2, long[:7] + "z" + long[8:]: 40, long[:-1]: 2, long[::-1]: 3}
    assert found_variants(spark.createDataFrame(list(words.items()), "word string, n long")) == brute_variants(words)


def test_passes_are_bounded():
    plan = spelling.plan_passes({7: 1000, 8: 10, 9: 50_000}, pass_bytes=8192)
    assert all(sum(s.blocks for s in shards) <= 1024 for shards in plan) and {s.length for shards in plan for s in shards} == {7, 8, 9}
    assert sorted(s.part for shards in plan for s in shards if s.length == 9) == list(range(max(s.parts for x in plan for s in x if s.length == 9)))


# secrets


def brute_secrets(text):
    text = text or ""
    out = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) < 20 or any(re.fullmatch(p, m[0]) for p in secrets.ALLOWED):
            continue
        kind, (_, _, window, bits) = next((i, c) for i, c in enumerate(secrets.CLASSES) if re.fullmatch(c[1], m[0]))
        entropy = max(
            -sum(c / window * math.log2(c / window) for c in collections.Counter(m[0][i : i + window]).values()) for i in range(len(m[0]) - window + 1)
        )
        if entropy >= bits - 1e-9:
            out.append((m.start(), 3 + kind, m.end()))
    return sorted(out)


def secret_texts():
    rng = np.random.default_rng(9)
    pick = lambda s, n: "".join(rng.choice(list(s), n))
    hexes, letters, all64 = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", secrets.SYMBOLS
    texts = [
        'password = "abcdef12"', "secret=token: abcdefgh", "Passwd:abcde TOKEN='abcdef'", "api_key=api_key=abcdef", "apikey = é", "\U0001f600 token=abc.def",
        "AKIA" + "A" * 15, "AKIA" + "B7" * 8, "AKIAAKIA" + "Z" * 14, "f" * 23 + " " + "0" * 24, "token", "ſecret=abcdef", "toKen=abcdef",
        "123e4567-e89b-12d3-a456-426614174000", "/usr/local/lib/python/site-packages/numpy", "EXAMPLE" + pick(all64, 30), "a" * 60, "0" * 19,
    ]
    for _ in range(60):
        texts.append(" ".join([pick(hexes, 40), pick(letters, 25), pick(all64, 33), pick("ab", 30), pick("abcdefgh", 24), "é", pick(all64, 19)]))
    texts.append("é ".join(["token=abc123de " + pick(hexes, 32)] * 500))
    texts.append("a" * 3000 + pick(all64, 200) + "b" * 3000)
    return texts


def test_secrets(spark):
    rows = EDGE + [(100 + i, t) for i, t in enumerate(secret_texts())]
    got = secrets.find_secrets(edge_docs(spark, rows)).collect()
    expected = sorted(((i, brute_secrets(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, [(s.start, s.kind, s.end) for s in r.spans]) for r in got), key=repr) == expected
    assert {k for _, spans in expected for _, k, _ in spans} == set(range(6))
    assert secrets.find_secrets(empty_docs(spark)).count() == 0


def test_no_python_in_secrets(spark):
    plan = secrets.find_secrets(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
