"""Personal data: fixed patterns, and a skip-chain conditional random field that carries what they
find to repeated and similar tokens of the same document. Trained in numpy."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm import common, training

KINDS = ("email", "ip", "card", "phone")
#: Documents of the training sample, and the longest (bytes) that is learned from.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 20_000
#: Hashed places of token features.
PLACES = 1 << 13
#: Score of a label that a token or hub cannot have, and the change of messages that counts as none.
NEVER, SETTLED = -1e6, 1e-4
#: Probability from which a token's label adds a span, and the precision on held-out matches up to
#: which that probability is raised for tokens that no match of the document ties to the kind.
SURE, PRECISION = 0.9, 0.99

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match cannot begin inside a run of digits, as the run's beginning was tried before
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile("[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&|"


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping within a kind; a match
    that fails its test is dropped without another try. Every pattern takes linear time."""
    if not text or not _HINT.search(text):
        return []
    finders = (_emails, _ips, _cards, _phones)
    return [(k, s, e) for k, find in enumerate(finders) for s, e in find(text)]


@dataclass
class Graph:
    """Tokens of one document that could be personal data: features, spans, neighbours in the text and
    the group of repeated or similar tokens that each belongs to (-1: none)."""

    spans: list[tuple[int, int]]
    feature: np.ndarray
    feature_at: np.ndarray
    chain: np.ndarray
    group: np.ndarray


def _shape(token: str) -> str:
    return re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]", "9", token)))


def document_graph(text: str) -> Graph | None:
    """Nodes are the tokens between blanks with a digit or an @; the others cannot be personal data.

    Neighbouring tokens are joined. Tokens with the same six or more digits, or with fewer digits and
    the same text, form a group, whose hub links any two of them over two edges; a token that recurs a
    thousand times has a thousand links, not a million.
    """
    if not _HINT.search(text):
        return None
    spans, features, at = [], [], []
    chain, keys = [], []
    before = ""
    last = -2
    for number, m in enumerate(_TOKEN.finditer(text)):
        token = m[0]
        if not _HINT.search(token):
            before = token
            continue
        core = token.strip(_EDGE)
        start = m.start() + token.find(core) if core else m.start()
        i = len(spans)
        spans.append((start, start + len(core)) if core else m.span())
        digits = "".join(c for c in token if "0" <= c <= "9")
        found = [f"shape {_shape(core)}", f"digits {len(digits)}", f"before {before.lower()}", f"plus {'+' in token} at {'@' in token}", "any"]
        features += [zlib.crc32(f.encode()) % PLACES for f in found]
        at += [i] * len(found)
        if number == last + 1:
            chain.append((i - 1, i))
        keys.append(digits if len(digits) >= 6 else core.lower())
        before, last = token, number
    if not spans:
        return None
    repeated = [key for key, k in Counter(keys).items() if k > 1 and len(key) > 1]
    number_of = {key: i for i, key in enumerate(repeated)}
    group = np.array([number_of.get(key, -1) for key in keys], np.int64)
    return Graph(spans, np.array(features, np.int64), np.array(at, np.int64), np.array(chain, np.int64).reshape(-1, 2), group)


def token_labels(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """Label of every token: 0, or 1 + the kind of the first pattern match it overlaps."""
    out = np.zeros(len(spans), np.int64)
    starts = np.array([s for s, _ in spans], np.int64)
    ends = np.array([e for _, e in spans], np.int64)
    for kind, start, end in reversed(base):
        out[np.searchsorted(ends, start, side="right") : np.searchsorted(starts, end, side="left")] = kind + 1
    return out


def _joined(graphs: list[Graph]):
    """Several documents as one graph without links between them: tokens, features, neighbours,
    groups and their number, document of every token."""
    sizes = [len(g.spans) for g in graphs]
    shift = np.concatenate([[0], np.cumsum(sizes)])
    groups = np.concatenate([[0], np.cumsum([g.group.max() + 1 for g in graphs])])
    cat = lambda xs: np.concatenate(xs)
    return (
        int(shift[-1]),
        cat([g.feature for g in graphs]),
        cat([g.feature_at + s for g, s in zip(graphs, shift)]),
        cat([g.chain + s for g, s in zip(graphs, shift)]),
        cat([np.where(g.group < 0, -1, g.group + s) for g, s in zip(graphs, groups)]),
        int(groups[-1]),
        np.repeat(np.arange(len(graphs)), sizes),
    )


class SkipChainCrf:
    """Log potentials of token features, of labels of neighbours and of labels of linked tokens."""

    def __init__(self):
        n = len(KINDS) + 1
        self.sure = SURE
        self.unary = np.zeros((PLACES, n))
        self.chain = np.zeros((n, n))
        self.skip = np.zeros((n, n))

    def node_scores(self, n: int, feature: np.ndarray, at: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros((n, self.unary.shape[1]))
        rows = self.unary[feature]
        np.add.at(out, at, rows if weight is None else rows * weight[:, None])
        return out

    def marginals(self, graphs: list[Graph], known: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of all tokens by loopy sum-product messages, damped, until those of every
        document have settled. ``known`` holds labels of tokens that are sure (-1: open).

        The hub of a group with sure members of some kind has their kinds, in their shares, however many
        open members there are."""
        n, feature, at, chain, group, n_groups, doc = _joined(graphs)
        member = np.flatnonzero(group >= 0)
        hub = n + group[member]
        scores = np.concatenate([self.node_scores(n, feature, at), np.zeros((n_groups, self.unary.shape[1]))])
        if known is not None:
            sure = np.flatnonzero(known >= 0)
            scores[sure] = NEVER
            scores[sure, known[sure]] = 0
            counts = _group_labels(group, n_groups, np.maximum(known, 0))[:, 1:]
            told = np.flatnonzero(counts.any(axis=1))
            scores[n + told] = NEVER
            scores[n + told, 1:] = np.where(counts[told] > 0, np.log(np.maximum(1, counts[told])), NEVER)
        ends = [(chain[:, 0], chain[:, 1]), (chain[:, 1], chain[:, 0]), (member, hub), (hub, member)]
        tables = [np.exp(t) for t in (self.chain, self.chain.T, self.skip, self.skip.T)]
        source, target = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
        kind = np.repeat(np.arange(4), [len(e[0]) for e in ends])
        place = np.arange(len(source))
        back = place + np.array([len(chain), -len(chain), len(member), -len(member)])[kind]
        of = doc[np.where(source < n, source, target)]
        sizes = np.bincount(doc, minlength=len(graphs))
        message = np.zeros((len(source), scores.shape[1]))
        live, rounds, step = place, 0, np.full(len(graphs), 0.5)
        while len(live):
            rounds += 1
            x = _received(scores, target[live], message[live])[source[live]] - message[back[live]]
            x = np.exp(x - x.max(axis=1, keepdims=True))
            new = np.empty_like(x)
            for k, table in enumerate(tables):
                these = kind[live] == k
                new[these] = np.log(x[these] @ table)
            new -= _log_sum(new, 1)[:, None]
            change = step[of[live]][:, None] * (new - message[live])
            message[live] += change
            moved = np.zeros(len(graphs))
            np.maximum.at(moved, of[live], np.abs(change).max(axis=1))
            # a document without loops settles within some rounds a token; one that swings takes smaller steps
            step[rounds % (200 + 4 * sizes) == 0] /= 2
            live = live[moved[of[live]] >= SETTLED]
        return _softmax(_received(scores, target, message)[:n])


def _received(scores: np.ndarray, target: np.ndarray, message: np.ndarray) -> np.ndarray:
    """Scores of all nodes plus the messages that reach them."""
    return scores + np.stack([np.bincount(target, message[:, k], len(scores)) for k in range(scores.shape[1])], axis=1)


def _group_labels(group: np.ndarray, n_groups: int, labels: np.ndarray) -> np.ndarray:
    """Members of every group by label."""
    width = len(KINDS) + 1
    inside = group >= 0
    return np.bincount(group[inside] * width + labels[inside], minlength=n_groups * width).reshape(n_groups, width)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], steps: int = 300, rate: float = 0.1, decay: float = 1e-3, seed: int = 9) -> SkipChainCrf:
    """Learn from what the fixed patterns find, and how sure the field must be of a token by itself:
    a field learned without every fifth text is held against the matches of those."""
    pairs = [(g, token_labels(g.spans, base_spans(t))) for t in texts if (g := document_graph(t)) is not None]
    model = _learned(pairs, steps, rate, decay, seed)
    held = pairs[::5]
    if len(pairs) > len(held):
        judge = _learned([p for i, p in enumerate(pairs) if i % 5], steps, rate, decay, seed)
        model.sure = _least_sure(judge.marginals([g for g, _ in held]), np.concatenate([y for _, y in held]))
    return model


def _least_sure(p: np.ndarray, y: np.ndarray) -> float:
    """The least probability, ``SURE`` at least, from which ``PRECISION`` of the labels other than 0 are
    right; above 1 if there is none."""
    best, sureness = p.argmax(axis=1), p.max(axis=1)
    found = np.flatnonzero((best > 0) & (sureness >= SURE))
    found = found[np.argsort(-sureness[found], kind="stable")]
    if not len(found):
        return SURE
    precise = np.cumsum(best[found] == y[found]) >= PRECISION * np.arange(1, len(found) + 1)
    if precise[-1]:
        return SURE
    last = np.flatnonzero(precise)
    return float(sureness[found[last[-1]]]) if len(last) else 2.0


def _learned(pairs: list[tuple[Graph, np.ndarray]], steps: int, rate: float, decay: float, seed: int) -> SkipChainCrf:
    """Learn by pseudo-likelihood: every token's label given its features, its neighbours' labels and
    the kind that most others of its group have, if any has one. A token's own features are left out
    for half the tokens of a step, so that the links learn to carry labels. Links favour equal labels
    from the start."""
    model = SkipChainCrf()
    model.skip += 4 * np.eye(len(KINDS) + 1)
    if not pairs:
        return model
    rng = np.random.default_rng(seed)
    n, feature, at, chain, group, n_groups, _ = _joined([g for g, _ in pairs])
    y = np.concatenate([labels for _, labels in pairs])
    member = np.flatnonzero(group >= 0)
    others = _group_labels(group, n_groups, y)[group[member]]
    others[np.arange(len(member)), y[member]] -= 1
    hub = np.where(others[:, 1:].any(axis=1), 1 + others[:, 1:].argmax(axis=1), 0)
    weights = [model.unary, model.chain, model.skip]
    squares = [np.full_like(w, 1e-6) for w in weights]
    start = [w.copy() for w in weights]
    for _ in range(steps):
        shown = (rng.random(n) < 0.5)[at].astype(float)
        scores = model.node_scores(n, feature, at, shown)
        np.add.at(scores, chain[:, 1], model.chain[y[chain[:, 0]]])
        np.add.at(scores, chain[:, 0], model.chain.T[y[chain[:, 1]]])
        scores[member] += model.skip[hub]
        error = _softmax(scores)
        error[np.arange(n), y] -= 1
        error /= n
        gradients = [np.zeros_like(w) for w in weights]
        np.add.at(gradients[0], feature, error[at] * shown[:, None])
        np.add.at(gradients[1], y[chain[:, 0]], error[chain[:, 1]])
        turned = np.zeros_like(gradients[1])
        np.add.at(turned, y[chain[:, 1]], error[chain[:, 0]])
        gradients[1] += turned.T
        np.add.at(gradients[2], hub, error[member])
        for w, g, s, w0 in zip(weights, gradients, squares, start):
            g += decay * (w - w0)
            s += g**2
            w -= rate * g / np.sqrt(s)
        model.skip[:] = (model.skip + model.skip.T) / 2
    return model


def tied(group: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For every token and label, whether a token of its group is known to have it."""
    counts = _group_labels(group, int(group.max()) + 1, known)
    out = np.zeros((len(group), len(KINDS) + 1), bool)
    out[group >= 0] = counts[group[group >= 0]] > 0
    return out


def added_spans(model: SkipChainCrf, texts: list[str], bases: list[list[tuple[int, int, int]]], sure: float = SURE) -> list[list[tuple[int, int, int]]]:
    """Spans of tokens that no pattern covers and that the field labels with at least ``sure``, or
    ``model.sure`` if that is more and no match of the document ties them to the kind. Every text with
    a candidate token is looked at. Tokens in pattern matches keep their labels. Neighbouring tokens of
    a kind form one span."""
    graphs = [document_graph(t) for t in texts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    live = [i for i, g in enumerate(graphs) if g is not None]
    if not live:
        return out
    known = [token_labels(graphs[i].spans, bases[i]) for i in live]
    clamped = np.concatenate([np.where(k > 0, k, -1) for k in known])
    p = model.marginals([graphs[i] for i in live], clamped)
    best, sureness = p.argmax(axis=1), p.max(axis=1)
    at = 0
    for i, labels in zip(live, known):
        g = graphs[i]
        joined = {b for a, b in g.chain.tolist()}
        reached = tied(g.group, labels)
        mine, how = best[at : at + len(labels)], sureness[at : at + len(labels)]
        least = np.where(reached[np.arange(len(labels)), mine], sure, max(sure, model.sure))
        new = np.where((labels == 0) & (how >= least), mine, 0).tolist()
        at += len(labels)
        for t, label in enumerate(new):
            if not label:
                continue
            start, end = g.spans[t]
            if t and t in joined and new[t - 1] == label:
                start = out[i].pop()[1]
            out[i].append((label - 1, start, end))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> SkipChainCrf:
    """Fit on ``most`` texts with a digit or an @, of at most ``most_bytes`` bytes, those whose id
    hashes lowest."""
    fits = F.octet_length(text_col).between(1, most_bytes) & F.col(text_col).rlike("[0-9@]")
    rows = docs.where(fits).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return fit([r.text for r in training.lowest_hashed(rows, "id", most).collect()])


def _found(rows, model: SkipChainCrf, together: int = 256, size: int = 4 << 20):
    """(key columns..., text) to (key columns, text, base spans, added spans), many texts at once."""
    held: list[tuple] = []
    weight = 0

    def finish():
        texts = [t for _, t, _ in held]
        for (key, text, base), more in zip(held, added_spans(model, texts, [b for _, _, b in held])):
            yield key, text, base, more

    for *key, text in rows:
        held.append((key, text or "", base_spans(text)))
        weight += len(text or "")
        if len(held) >= together or weight > size:
            yield from finish()
            held, weight = [], 0
    yield from finish()


def find_private_data(docs: DataFrame, model: SkipChainCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in whole texts, as code points, end exclusive: doc_id, and base and
    added, each an array of (kind, start, end) triples laid flat, kinds numbered as in ``KINDS``.

    Null and empty texts have none. Added spans do not depend on a pattern match in the document.
    Repeated rows and null ids are kept. Only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(rows):
        for (doc_id,), _, base, more in _found(rows, shared.value):
            yield doc_id, [x for s in base for x in s], [x for s in more for x in s]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_rows(rows, ["doc_id", "text"], work, f"doc_id {kind}, base array<long>, added array<long>")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, of the first's
    kind."""
    out, at, end = [], 0, 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= end:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end = max(end, stop)
    return "".join([*out, text[at:]])


def mask_private_data(docs: DataFrame, model: SkipChainCrf, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with personal data replaced by its kind, and ``length_col`` (if there is one)
    set to the new text's code points. All rows and columns stay; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def mask(batches):
        import pyarrow as pa

        for batch in common.small(batches, 1024):
            texts = batch.column(text_col).to_pylist()
            new = [masked(text, base + more) if base or more else text for _, text, base, more in _found(((t,) for t in texts), shared.value)]
            new = [None if old is None else n for old, n in zip(texts, new)]
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            columns[text_col] = pa.array(new, batch.schema.field(text_col).type)
            if length_col in columns:
                kind = batch.schema.field(length_col).type
                changed = [length if n is None or n == old else len(n) for n, old, length in zip(new, texts, columns[length_col].to_pylist())]
                columns[length_col] = pa.array(changed, kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)
        common.give_back()

    return common.bounded(docs).mapInArrow(mask, schema)
