"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm import common, training

#: Rows per class and bytes per text of the training sample.
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 20_000
#: Places of hashed words, and of their first four and first five bytes; one for the padding.
WORD_PLACES, PART_PLACES = 1 << 17, 1 << 16
PLACES = WORD_PLACES + 2 * PART_PLACES + 1
DIMENSIONS, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
#: Texts a hashed place must occur in to be learned, and those that count for half of its odds.
LEAST_TEXTS, TRUST = 3, 8
#: Words that are convolved at once, longer texts go piece by piece, overlapping; and bytes of a text
#: whose words are listed at once.
PIECE, PIECE_BYTES = 50_000, 1 << 20

#: Function words that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for it with as",
    "fr": "le la les des et une du que est dans pour qui",
    "de": "der die das und ist nicht ein von den mit zu auf",
    "es": "el los las que una con por para y en del se",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def word_places(words: list[bytes]) -> np.ndarray:
    """Embedding rows of every word: the word, its first four and its first five bytes."""
    out = np.empty((len(words), 3), np.int32)
    out[:, 0] = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (WORD_PLACES - 1)
    for i, n in enumerate((4, 5)):
        parts = np.fromiter(map(zlib.crc32, [w[:n] for w in words]), np.int64, len(words))
        out[:, i + 1] = (parts & (PART_PLACES - 1)) + WORD_PLACES + i * PART_PLACES
    return out


def text_places(text: str | None, piece_bytes: int = PIECE_BYTES) -> np.ndarray:
    """The same for a whole text; the words of a long one are listed piece by piece."""
    raw = text.encode().translate(common.WORD_BYTES) if text else b""
    parts, at = [], 0
    while at < len(raw):
        end = raw.find(b" ", at + piece_bytes)
        end = len(raw) if end < 0 else end
        parts.append(word_places(raw[at:end].split()))
        at = end
    return np.concatenate(parts) if parts else np.zeros((0, 3), np.int32)


def _language_table() -> np.ndarray:
    table = np.full(WORD_PLACES, len(FUNCTION_WORDS), np.int32)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        for word in words.split():
            table[zlib.crc32(word.encode()) & (WORD_PLACES - 1)] = i
    return table


def language(places: np.ndarray, table: np.ndarray) -> int:
    """Number of the language with most function words in the text; the last one without any."""
    counts = np.bincount(table[places[:, 0]], minlength=len(LANGUAGES))[: len(FUNCTION_WORDS)]
    return int(counts.argmax()) if counts.any() else len(FUNCTION_WORDS)


@dataclass
class TextCnn:
    """Sum of hashed embeddings per word, filters of several widths, largest response of each over
    the text, and a logistic output."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(LANGUAGES), 0.5))

    @classmethod
    def start(cls, rng) -> TextCnn:
        def draw(*shape):
            return rng.normal(0, 0.05, shape).astype(np.float32)

        n = FILTERS * len(WIDTHS)
        model = cls(draw(PLACES, DIMENSIONS), [draw(w, DIMENSIONS, FILTERS) for w in WIDTHS], np.zeros(n, np.float32), draw(n), np.zeros(1, np.float32))
        model.embedding[-1] = 0
        for i, f in enumerate(model.filters):
            f[:, 0, 0] = 1
            model.weight[i * FILTERS] = 1
        return model

    def responses(self, places: np.ndarray) -> np.ndarray:
        """Every filter at every word; places end with padding."""
        x = self.embedding[places].sum(axis=1)
        n = len(x) - max(WIDTHS) + 1
        out = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        for i, f in enumerate(self.filters):
            part = x[:n] @ f[0]
            for j in range(1, len(f)):
                part += x[j : n + j] @ f[j]
            out[:, i * FILTERS : (i + 1) * FILTERS] = part
        return out

    def largest(self, pieces: list[np.ndarray]) -> np.ndarray:
        """The largest response of every filter in every piece."""
        pad = np.full((max(WIDTHS) - 1, 3), PLACES - 1, np.int32)
        ends = np.cumsum([len(p) + len(pad) for p in pieces])
        starts = np.concatenate([[0], ends[:-1]])
        r = self.responses(np.concatenate([x for p in pieces for x in (p, pad)] + [pad]))
        # windows that begin in the padding belong to no text
        r[np.concatenate([np.arange(e - len(pad), e) for e in ends])] = -np.inf
        return np.maximum.reduceat(r[: ends[-1]], starts)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """One logit per text, from the places of its words."""
        pieces, owner = [], []
        best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        held = 0
        for i, places in enumerate(texts):
            for at in range(0, max(1, len(places)), PIECE):
                part = places[at : at + PIECE + max(WIDTHS) - 1]
                pieces.append(part if len(part) else np.full((1, 3), PLACES - 1, np.int32))
                owner.append(i)
                held += len(part)
                if held >= 4 * PIECE:
                    np.maximum.at(best, owner, self.largest(pieces))
                    pieces, owner, held = [], [], 0
        if pieces:
            np.maximum.at(best, owner, self.largest(pieces))
        return np.tanh(best + self.bias) @ self.weight + self.offset


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(sample: list[tuple[str, int]], epochs: int = 6, steps: int = 800, rate: float = 0.05, batch: int = 32, seed: int = 11) -> TextCnn:
    """Learn from texts and labels (0 or 1), for ``epochs`` rounds and at least ``steps`` steps; a
    fifth of the sample sets the thresholds instead.

    The embedding starts from how much more often a word occurs in one class (smoothed), which gives
    the largest responses a sense from the first step on. Without examples of both classes every
    text gets the share of label 1 (one half without any).
    """
    rng = np.random.default_rng(seed)
    model = TextCnn.start(rng)
    places = [text_places(t) for t, _ in sample]
    y = np.array([l for _, l in sample], np.float32)
    if not len(y) or y.min() == y.max():
        model.weight[:] = 0
        share = float(y.mean()) if len(y) else 0.5
        model.offset[:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    order = rng.permutation(len(y))
    held, learn = order[: len(y) // 5], order[len(y) // 5 :]
    seen = np.zeros((2, PLACES), np.float32)
    for i in learn:
        seen[int(y[i]), np.unique(places[i])] += 1
    ones = max(1.0, float(y[learn].sum()))
    zeros = max(1.0, len(learn) - ones)
    both = seen.sum(axis=0)
    odds = np.log((seen[1] + ones / len(learn)) / (seen[0] + zeros / len(learn)) * (zeros / ones))
    model.embedding[:, 0] = odds * both / (both + TRUST)
    # what hardly occurs is treated like what never does
    known = both >= LEAST_TEXTS
    known[-1] = False
    model.embedding[~known] = 0

    pad = np.full((max(WIDTHS) - 1, 3), PLACES - 1, np.int32)
    squares = [np.full_like(p, 1e-2) for p in (model.embedding, *model.filters, model.bias, model.weight, model.offset)]
    for _ in range(max(epochs, -(-steps * batch // max(1, len(learn))))):
        rng.shuffle(learn)
        for at in range(0, len(learn), batch):
            _step(model, squares, [np.concatenate([places[i], pad]) for i in learn[at : at + batch] if len(places[i])],
                  np.array([y[i] for i in learn[at : at + batch] if len(places[i])]), known, rate)
    _calibrate(model, [places[i] for i in held], y[held])
    return model


def _step(model: TextCnn, squares: list[np.ndarray], texts: list[np.ndarray], y: np.ndarray, known: np.ndarray, rate: float) -> None:
    """One step of Adagrad: errors reach only the windows with the largest responses, and only known
    places move."""
    if not texts:
        return
    flat = np.concatenate([*texts, texts[-1][-(max(WIDTHS) - 1) :]])
    r = model.responses(flat)
    ends = np.cumsum([len(t) for t in texts])
    at = np.array([s + r[s : e - max(WIDTHS) + 1].argmax(axis=0) for s, e in zip(np.concatenate([[0], ends[:-1]]), ends)])
    best = np.take_along_axis(r, at, axis=0)
    hidden = np.tanh(best + model.bias)
    error = (_sigmoid(hidden @ model.weight + model.offset) - y) / len(y)
    back = (error[:, None] * model.weight) * (1 - hidden**2)

    def move(k: int, value: np.ndarray, gradient: np.ndarray) -> None:
        squares[k] += gradient**2
        value -= rate * gradient / np.sqrt(squares[k])

    k = 1
    spots, pulls = [], []
    for i, f in enumerate(model.filters):
        cols = slice(i * FILTERS, (i + 1) * FILTERS)
        gradient = np.zeros_like(f)
        for j in range(len(f)):
            word = flat[at[:, cols] + j]
            x = model.embedding[word].sum(axis=2)
            gradient[j] = np.einsum("bfd,bf->df", x, back[:, cols])
            pull = back[:, cols, None] * f[j].T[None]
            for c in range(3):
                spots.append(word[:, :, c].reshape(-1))
                pulls.append(pull.reshape(-1, DIMENSIONS))
        move(k, f, gradient)
        k += 1
    move(k, model.bias, back.sum(axis=0))
    move(k + 1, model.weight, hidden.T @ error)
    move(k + 2, model.offset, np.array([error.sum()], np.float32))
    rows, inverse = np.unique(np.concatenate(spots), return_inverse=True)
    total = np.zeros((len(rows), DIMENSIONS), np.float32)
    np.add.at(total, inverse, np.concatenate(pulls))
    total[~known[rows]] = 0
    squares[0][rows] += total**2
    model.embedding[rows] -= rate * total / np.sqrt(squares[0][rows])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that splits best by F1: the middle between the neighbours of the best cut."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    cut = int(f1.argmax())
    below = p[cut + 1] if cut + 1 < len(p) else 0.0
    return float(np.clip((p[cut] + below) / 2, 0.02, 0.98))


def _calibrate(model: TextCnn, texts: list[np.ndarray], y: np.ndarray, least: int = 20) -> None:
    """A threshold per language of the text; languages with under ``least`` examples of label 1 take
    the threshold of all."""
    if not y.any():
        return
    p = np.concatenate([_sigmoid(model.logits(texts[i : i + 64])) for i in range(0, len(texts), 64)])
    table = _language_table()
    spoken = np.array([language(t, table) for t in texts])
    for i in (-1, *range(len(LANGUAGES))):
        own = spoken == i if i >= 0 else np.ones(len(y), bool)
        ones = y[own].sum()
        if i < 0 or ones >= least:
            t = best_threshold(p[own], y[own])
            # few examples move the threshold less
            model.thresholds[i if i >= 0 else slice(None)] = _sigmoid(np.log(t / (1 - t)) * ones / (ones + least))


def scores(model: TextCnn, texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1, moved so that every language's threshold lies at one half. The language
    is told from the text itself."""
    t = model.thresholds[[language(x, table) for x in texts]]
    return _sigmoid(model.logits(texts) - np.log(t / (1 - t)))


def _scored(rows, model: TextCnn, words: int = 200_000):
    """(key columns..., text) to (key columns..., score), many texts at once."""
    table = _language_table()
    held: list[tuple] = []
    size = 0
    for *key, text in rows:
        places = text_places(text)
        held.append((key, places))
        size += len(places)
        if size > words or len(held) >= 2000:
            yield from zip((k for k, _ in held), scores(model, [p for _, p in held], table).tolist())
            held, size = [], 0
    if held:
        yield from zip((k for k, _ in held), scores(model, [p for _, p in held], table).tolist())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES,
          id_col: str = "doc_id", text_col: str = "text") -> TextCnn:
    """Fit on a bounded sample (``training.labelled_sample``) that leaves out the held-out fold."""
    model = fit(training.labelled_sample(docs, labels, label, per_class, most_bytes, id_col, text_col))
    training.give_back()
    return model


def score_documents(docs: DataFrame, model: TextCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, 0.5 is the threshold of the text's language) of whole texts. Of a long
    text twelve bytes a word are held besides the text; all else goes piece by piece.

    Null and empty texts, and texts without words, get the score of the padding alone. Repeated rows
    and null ids are kept. Only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(rows):
        for (doc_id,), score in _scored(rows, shared.value):
            yield doc_id, score

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_rows(rows, ["doc_id", "text"], work, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: TextCnn, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns; texts stay in their task."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        import pyarrow as pa

        for batch in common.small(batches, 1024):
            got = [s for _, s in _scored(((t,) for t in batch.column(text_col).to_pylist()), shared.value)]
            yield batch.filter(pa.array([s < threshold for s in got], pa.bool_()))
        common.give_back()

    return common.bounded(docs).mapInArrow(keep, docs.schema)
