"""Quality: attention-based multiple-instance learning over the passages of a document, in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm import common, training

#: Rows per class and bytes per text of the training sample.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 20_000
#: Words of a passage, and about how many bytes of a text are described at once.
PASSAGE, PIECE_BYTES = 64, 4 << 20
HIDDEN, GATES = 24, 12

#: Kinds of bytes: lower case, upper case, digit, blank, line end, sentence mark, exclamation or
#: question mark, symbol, bar, bracket or quote, other ASCII, beyond ASCII.
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c", "\n\r", ".,;:", "!?", "#$%&*+=@^~", "|", "()[]{}<>\"'`")
KIND = np.full(256, len(_KINDS), np.uint8)
for _number, _members in enumerate(_KINDS):
    KIND[list(_members.encode())] = _number
KIND[128:] = len(_KINDS) + 1
KINDS = len(_KINDS) + 2
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
#: Shares of neighbouring byte kinds, then: repeated neighbours, distinct words in the passage and
#: in the text, word length, length of the passage.
FEATURES = KINDS * KINDS + 5


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage of ``PASSAGE`` words of the whole text; a text without words
    is one passage of zeros. A long text is described in pieces that end between passages, which
    changes nothing."""
    raw = (text or "").encode()
    found, at, size = [], 0, PIECE_BYTES
    seen, count, last = np.zeros(0, np.int64), 0, -1
    while at < len(raw):
        end = len(raw) if at + size >= len(raw) else _passage_end(raw, at, at + size)
        if end == at:
            size *= 2
            continue
        lead = at > 0
        rows, hashed = _describe(raw[at - lead : end], lead, last)
        if len(rows):
            found.append(rows)
            seen, count, last = np.union1d(seen, hashed), count + len(hashed), int(hashed[-1])
        at, size = end, PIECE_BYTES
    if not found:
        return np.zeros((1, FEATURES), np.float32)
    out = np.concatenate(found)
    out[:, KINDS * KINDS + 2] = len(seen) / count
    return out


def _passage_end(raw: bytes, start: int, end: int) -> int:
    """Where the last passage that begins in this part of a text begins; ``start`` if none does after it."""
    blank = _BLANK[np.frombuffer(raw, np.uint8, end - start, start)]
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    k = (len(begins) - 1) // PASSAGE * PASSAGE if len(begins) else 0
    return start + int(begins[k]) if k > 0 else start


def _describe(raw: bytes, lead: bool = False, last: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of a part of a text and the hashes of its words. With ``lead`` the
    first byte is the one before the part; ``last`` is the hash of the word before."""
    words = raw.split()
    if not words:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    n = -(-len(words) // PASSAGE)
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    starts = ~blank
    starts[1:] &= blank[:-1]
    of_byte = np.maximum(np.cumsum(starts) - 1, 0) // PASSAGE
    kind = KIND[data].astype(np.int64)
    pairs = of_byte[1:] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
    out = np.zeros((n, FEATURES), np.float32)
    shares = np.bincount(pairs, minlength=n * KINDS * KINDS).reshape(n, -1)
    sizes = np.bincount(of_byte[lead:], minlength=n)
    out[:, : KINDS * KINDS] = np.sqrt(shares / np.maximum(1, sizes)[:, None])
    hashed = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    of_word = np.arange(len(words)) // PASSAGE
    held = np.bincount(of_word, minlength=n)
    same = np.zeros(len(words))
    same[1:] = hashed[1:] == hashed[:-1]
    same[0] = hashed[0] == last
    distinct = np.bincount(np.unique((of_word << 32) | hashed) >> 32, minlength=n)
    rest = out[:, KINDS * KINDS :]
    rest[:, 0] = np.bincount(of_word, same, n) / held
    rest[:, 1] = distinct / held
    rest[:, 3] = np.minimum(sizes / held, 40) / 10
    rest[:, 4] = held / PASSAGE
    return out, hashed


@dataclass
class AttentionMil:
    """Encoder tanh(xU), gated attention softmax(w . tanh(hV) * sigmoid(hG)), logistic output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray):
        u, ub, v, g, w, c, b = self.weights
        h = np.tanh(((x - self.mean) / self.scale) @ u + ub)
        tv, sg = np.tanh(h @ v), _sigmoid(h @ g)
        e = (tv * sg) @ w
        sizes = np.diff([*starts, len(x)])
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return z @ c + b[0], (h, tv, sg, a, z, sizes)

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum([len(x) for x in bags[:-1]])]).astype(np.int64)
        return _sigmoid(self.forward(np.concatenate(bags), starts)[0])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(sample: list[tuple[str, int]], epochs: int = 20, steps: int = 1200, batch: int = 32, rate: float = 0.003, decay: float = 1e-4,
        seed: int = 5) -> AttentionMil:
    """Learn from texts and labels (0 or 1) with Adam; examples of the rarer label weigh no more, so
    scores keep to the sample's shares. Without examples of both labels, every text gets the share
    of label 1 (one half without any)."""
    rng = np.random.default_rng(seed)
    bags = [passages(t) for t, _ in sample]
    y = np.array([l for _, l in sample], np.float32)
    flat = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    shapes = [(FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,)]
    weights = [rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) if len(s) == 2 or s[0] == GATES else np.zeros(s, np.float32) for s in shapes]
    model = AttentionMil(flat.mean(axis=0), flat.std(axis=0) + 0.02, weights)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        weights[-1][:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    weights[5][:] = rng.normal(0, 0.1, HIDDEN)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    done = 0
    for _ in range(max(epochs, -(-steps * batch // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            gradients = _gradients(model, [bags[i] for i in chosen], y[chosen])
            done += 1
            for k, gradient in enumerate(gradients):
                gradient = gradient + decay * weights[k]
                first[k] += 0.1 * (gradient - first[k])
                second[k] += 0.001 * (gradient**2 - second[k])
                weights[k] -= rate * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.999**done)) + 1e-8)
    return model


def _gradients(model: AttentionMil, bags: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    u, ub, v, g, w, c, b = model.weights
    starts = np.concatenate([[0], np.cumsum([len(x) for x in bags[:-1]])]).astype(np.int64)
    x = np.concatenate(bags)
    logit, (h, tv, sg, a, z, sizes) = model.forward(x, starts)
    error = (_sigmoid(logit) - y) / len(y)
    dz = np.repeat(error[:, None] * c, sizes, axis=0)
    da = (dz * h).sum(axis=1)
    # softmax: what a weight gains the others of its document lose
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
    gate = de[:, None] * w
    dtv, dsg = gate * sg * (1 - tv**2), gate * tv * sg * (1 - sg)
    dh = a[:, None] * dz + dtv @ v.T + dsg @ g.T
    dx = dh * (1 - h**2)
    scaled = (x - model.mean) / model.scale
    return [scaled.T @ dx, dx.sum(axis=0), h.T @ dtv, h.T @ dsg, (tv * sg).T @ de, z.T @ error, np.array([error.sum()])]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES,
          id_col: str = "doc_id", text_col: str = "text") -> AttentionMil:
    """Fit on a bounded sample (``training.labelled_sample``) that leaves out the held-out fold."""
    model = fit(training.labelled_sample(docs, labels, label, per_class, most_bytes, id_col, text_col))
    training.give_back()
    return model


def score_documents(docs: DataFrame, model: AttentionMil, id_col: str = "doc_id", text_col: str = "text", together: int = 4000) -> DataFrame:
    """doc_id and score (0 to 1) of whole texts, ``together`` passages at a time.

    Null and empty texts, and texts of blanks, count as one passage of zeros. Repeated rows and null
    ids are kept. Only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(rows):
        ids, bags, size = [], [], 0
        for doc_id, text in rows:
            ids.append(doc_id)
            bags.append(passages(text))
            size += len(bags[-1])
            if size >= together:
                yield from zip(ids, shared.value.scores(bags).tolist())
                ids, bags, size = [], [], 0
        if ids:
            yield from zip(ids, shared.value.scores(bags).tolist())

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_rows(rows, ["doc_id", "text"], work, f"doc_id {kind}, score double")
