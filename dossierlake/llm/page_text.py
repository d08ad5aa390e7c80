"""Main text of web pages: a bidirectional LSTM labels the leaf blocks of every page, in numpy."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm import common, training

#: Pages of the training sample, and the longest page (bytes) that is learned from.
SAMPLE_PAGES, SAMPLE_BYTES = 700, 30_000
#: Hashed places of tag-path words and of text words, and their dimensions.
PATH_PLACES, WORD_PLACES, PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 1 << 11, 1 << 12, 12, 8, 5, 12
#: Characters of a block whose words are held at a time.
PIECE = 1 << 16

#: Elements that end a block, elements without an end tag, elements whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text up to their end tag or the end of the page, and
#: those whose content is no page text where they have an end tag.
RAW_TAGS = ("script", "style", "noscript", "iframe")
HIDDEN_TAGS = ("template", "svg", "math")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|iframe)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?|<[!?][^>]*>?",
    re.S | re.I,
)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in HIDDEN_TAGS}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

#: Words of tag paths that say what a block is, for the labels to learn from.
MAIN_WORDS = frozenset("article main content post entry story body-text articlebody".split())
OTHER_WORDS = frozenset(
    "nav menu header footer aside sidebar form ad ads advert advertisement banner cookie consent notice notification comment comments "
    "reply share social related promo newsletter breadcrumb head title button select option dialog popup login search copyright sponsor".split()
)


def _path_words(tag: str, attributes: str) -> list[str]:
    words = [tag]
    if "=" in attributes:
        for found in _NAMES.findall(attributes):
            words += _WORD.findall("".join(found).lower())
    return words


def blocks(page: str | None) -> list[tuple[list[str], str, float]]:
    """Leaf blocks of a page in order: words of the tag path, text, and the share of it in links.

    Comments, scripts, styles and other content without text are skipped: raw text up to its end tag,
    or the end of the page without one; drawings and templates only where they have an end tag.
    Elements whose names merely begin like these are ordinary ones. Character references are
    decoded and white space becomes one space. An unclosed element ends with its parent, and a
    paragraph or list item also before the next block or item.
    """
    out: list[tuple[list[str], str, float]] = []
    stack: list[tuple[str, list[str]]] = []
    held: list[str] = []
    linked = 0
    in_link = 0

    def close() -> None:
        nonlocal held, linked
        text = " ".join("".join(held).split())
        if text:
            out.append(([w for _, words in stack for w in words], text, min(1.0, linked / len(text))))
        held, linked = [], 0

    def pop(to: int) -> None:
        nonlocal in_link
        in_link -= sum(1 for t, _ in stack[to:] if t == "a")
        del stack[to:]

    at = 0
    page = page or ""
    endless: set[str] = set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text = page[at : m.start()]
            text = html.unescape(text) if "&" in text else text
            held.append(text)
            linked += len(text) if in_link else 0
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in BLOCK_TAGS:
            close()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag in VOID_TAGS:
            continue
        if tag in HIDDEN_TAGS:
            # self-closed it is empty; with an end tag all up to it goes; else only the tag itself
            if not m[4].endswith("/") and tag not in endless:
                end = _END[tag].search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
            continue
        if tag in BLOCK_TAGS:
            for i in range(len(stack) - 1, -1, -1):
                open_tag = stack[i][0]
                if open_tag == "p" or (open_tag == tag == "li"):
                    pop(i)
                    break
                if open_tag in BLOCK_TAGS:
                    break
        if tag == "a":
            in_link += 1
        stack.append((tag, _path_words(tag, m[4])))
    if at < len(page):
        text = html.unescape(page[at:])
        held.append(text)
        linked += len(text) if in_link else 0
    close()
    return out


def weak_label(path: list[str]) -> int:
    """What the words of a path say: main text lies within a main element and outside all others."""
    return int(any(w in MAIN_WORDS for w in path) and not any(w in OTHER_WORDS for w in path))


def unnamed(found: list[tuple[list[str], str, float]]) -> list[bool]:
    """Labels where no page of the sample names its parts: all blocks that are not mostly links and
    whose path has no word of other parts."""
    return [share < 0.5 and not any(w in OTHER_WORDS for w in path) for path, _, share in found]


@dataclass
class Sequences:
    """Blocks of one page as numbers: places of path words and text words with their block, how often
    a text word's place occurs in the block, figures."""

    n: int
    path: np.ndarray
    path_at: np.ndarray
    word: np.ndarray
    word_at: np.ndarray
    count: np.ndarray
    figures: np.ndarray


def _word_counts(text: str) -> dict[int, int]:
    """Hashed places of all words of a block and how often each occurs. Long blocks are read in
    pieces that end at a blank, so what is held is bounded by the number of places."""
    counts: dict[int, int] = {}
    at = 0
    while at < len(text):
        end = text.find(" ", at + PIECE)
        end = len(text) if end < 0 else end
        for w, k in Counter(common.alnum_words(text[at:end])).items():
            place = zlib.crc32(w) % WORD_PLACES
            counts[place] = counts.get(place, 0) + k
        at = end
    return counts


def describe(found: list[tuple[list[str], str, float]]) -> Sequences:
    path, path_at, word, word_at, count = [], [], [], [], []
    figures = np.zeros((len(found), FIGURES), np.float32)
    for i, (words, text, share) in enumerate(found):
        path += [zlib.crc32(w.encode()) % PATH_PLACES for w in words]
        path_at += [i] * len(words)
        counts = _word_counts(text)
        word += counts.keys()
        word_at += [i] * len(counts)
        count += counts.values()
        figures[i] = (np.log1p(len(text)) / 8, share, i / len(found), (len(found) - i) / len(found), text[-1] in ".!?…")
    as_int = lambda x: np.array(x, np.int64)
    return Sequences(len(found), as_int(path), as_int(path_at), as_int(word), as_int(word_at), as_int(count), figures)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Embedded tag path, mean embedded words and figures of every block, an LSTM over the page in
    each direction, and a logistic output per block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)

        def draw(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        size = PATH_DIM + WORD_DIM + FIGURES
        self.path = rng.normal(0, 0.1, (PATH_PLACES, PATH_DIM)).astype(np.float32)
        self.word = rng.normal(0, 0.1, (WORD_PLACES, WORD_DIM)).astype(np.float32)
        self.cells = [[draw(size, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)] for _ in range(2)]
        self.out = [draw(2 * HIDDEN), np.zeros(1, np.float32)]
        self.trained = False

    def parameters(self) -> list[np.ndarray]:
        return [self.path, self.word, *self.cells[0], *self.cells[1], *self.out]

    def inputs(self, pages: list[Sequences]):
        """Padded input (pages, blocks, size), and where embeddings went."""
        longest = max(p.n for p in pages)
        x = np.zeros((len(pages), longest, PATH_DIM + WORD_DIM + FIGURES), np.float32)
        flat = x.reshape(len(pages) * longest, -1)
        path = np.concatenate([p.path for p in pages])
        path_at = np.concatenate([p.path_at + i * longest for i, p in enumerate(pages)])
        word = np.concatenate([p.word for p in pages])
        word_at = np.concatenate([p.word_at + i * longest for i, p in enumerate(pages)])
        count = np.concatenate([p.count for p in pages])
        share = (count / np.maximum(1, np.bincount(word_at, count, len(flat)))[word_at]).astype(np.float32)
        summed = np.zeros((len(flat), PATH_DIM), np.float32)
        np.add.at(summed, path_at, self.path[path])
        flat[:, :PATH_DIM] = summed
        for k in range(WORD_DIM):
            flat[:, PATH_DIM + k] = np.bincount(word_at, self.word[word, k] * share, len(flat))
        for i, p in enumerate(pages):
            x[i, : p.n, PATH_DIM + WORD_DIM :] = p.figures
        return x, (path, path_at, word, word_at, share)

    @staticmethod
    def turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Every sequence in reverse; padding stays at the end."""
        steps = np.arange(x.shape[1])[None, :]
        at = np.where(steps < sizes[:, None], sizes[:, None] - 1 - steps, steps)
        return np.take_along_axis(x, at[:, :, None], axis=1)

    def run(self, x: np.ndarray, cell: list[np.ndarray], keep: bool = False):
        wx, wh, b = cell
        gates = x @ wx + b
        h = c = np.zeros((len(x), HIDDEN), np.float32)
        out = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
        kept = []
        for t in range(x.shape[1]):
            a = gates[:, t] + h @ wh
            s = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep:
                kept.append((i, f, o, g, before, h_before, tc))
        return out, kept

    def logits(self, pages: list[Sequences]) -> list[np.ndarray]:
        sizes = np.array([p.n for p in pages])
        x, _ = self.inputs(pages)
        ahead, _ = self.run(x, self.cells[0])
        back, _ = self.run(self.turned(x, sizes), self.cells[1])
        z = np.concatenate([ahead, self.turned(back, sizes)], axis=2) @ self.out[0] + self.out[1]
        return [z[i, :n] for i, n in enumerate(sizes)]

    def gradients(self, pages: list[Sequences], labels: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([p.n for p in pages])
        x, (path, path_at, word, word_at, share) = self.inputs(pages)
        turned = self.turned(x, sizes)
        ahead, kept_a = self.run(x, self.cells[0], True)
        back, kept_b = self.run(turned, self.cells[1], True)
        both = np.concatenate([ahead, self.turned(back, sizes)], axis=2)
        error = np.zeros(x.shape[:2], np.float32)
        z = both @ self.out[0] + self.out[1]
        for i, y in enumerate(labels):
            error[i, : len(y)] = (_sigmoid(z[i, : len(y)]) - y) / sizes.sum()
        dboth = error[:, :, None] * self.out[0]
        dx_a, cell_a = self._back(x, kept_a, ahead, self.cells[0], dboth[:, :, :HIDDEN])
        dx_b, cell_b = self._back(turned, kept_b, back, self.cells[1], self.turned(dboth[:, :, HIDDEN:], sizes))
        dx = (dx_a + self.turned(dx_b, sizes)).reshape(-1, x.shape[2])
        dpath, dword = np.zeros_like(self.path), np.zeros_like(self.word)
        np.add.at(dpath, path, dx[path_at, :PATH_DIM])
        for k in range(WORD_DIM):
            dword[:, k] = np.bincount(word, dx[word_at, PATH_DIM + k] * share, WORD_PLACES)
        return [dpath, dword, *cell_a, *cell_b, np.einsum("pbh,pb->h", both, error), np.array([error.sum()], np.float32)]

    def _back(self, x, kept, out, cell, dout):
        wx, wh, _ = cell
        dgates = np.empty((len(x), x.shape[1], 4 * HIDDEN), np.float32)
        dh = np.zeros((len(x), HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        dwh = np.zeros_like(wh)
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, o, g, before, h_before, tc = kept[t]
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc**2)
            d = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dgates[:, t] = d
            dwh += h_before.T @ d
            dh = d @ wh.T
            dc = dc * f
        flat = dgates.reshape(-1, 4 * HIDDEN)
        return dgates @ wx.T, [x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)]


def _disguised(found: list[tuple[list[str], str, float]], rng) -> list[tuple[list[str], str, float]]:
    """The same page with other words for its parts, so that more of them are learned."""
    mains, others = sorted(MAIN_WORDS), sorted(OTHER_WORDS)
    new: dict[str, str] = {}

    def other(word: str) -> str:
        if word not in new:
            pool = mains if word in MAIN_WORDS else others if word in OTHER_WORDS else None
            new[word] = pool[rng.integers(len(pool))] if pool and rng.random() < 0.7 else word
        return new[word]

    return [([other(w) for w in path], text, share) for path, text, share in found]


def fit(sample: list[str], epochs: int = 8, steps: int = 250, batch: int = 24, rate: float = 0.01, seed: int = 3) -> BlockLabeller:
    """Learn from pages whose tag paths say what is main text (``weak_label``), each as it is and
    once more with its parts renamed. Where no page says so nothing is learned, and ``unnamed`` labels."""
    rng = np.random.default_rng(seed)
    model = BlockLabeller(seed)
    parsed = [b for b in map(blocks, sample) if b]
    parsed = [b for b in parsed if any(weak_label(p) for p, _, _ in b)]
    if not parsed:
        return model
    parsed += [_disguised(b, rng) for b in parsed]
    pages = [describe(b) for b in parsed]
    labels = [np.array([weak_label(p) for p, _, _ in b], np.float32) for b in parsed]
    by_size = np.argsort([p.n for p in pages], kind="stable")
    groups = [by_size[i : i + batch] for i in range(0, len(by_size), batch)]
    model.trained = True
    weights = model.parameters()
    first, second, done = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(max(epochs, -(-steps // len(groups)))):
        for k in rng.permutation(len(groups)):
            done += 1
            for j, gradient in enumerate(model.gradients([pages[i] for i in groups[k]], [labels[i] for i in groups[k]])):
                first[j] += 0.1 * (gradient - first[j])
                second[j] += 0.001 * (gradient**2 - second[j])
                weights[j] -= rate * (first[j] / (1 - 0.9**done)) / (np.sqrt(second[j] / (1 - 0.999**done)) + 1e-8)
    return model


def main_texts(model: BlockLabeller, pages: list[str | None], padded: int = 40_000) -> list[str]:
    """Main text of every page: the blocks labelled so, joined by line ends. Pages of like length
    are labelled together, up to ``padded`` blocks at a time."""
    parsed = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if parsed[i]), key=lambda i: len(parsed[i]))
    while order:
        size = max(1, min(len(order), padded // len(parsed[order[-1]])))
        chosen, order = order[-size:], order[:-size]
        labels = [z > 0 for z in model.logits([describe(parsed[i]) for i in chosen])] if model.trained else [unnamed(parsed[i]) for i in chosen]
        for i, mains in zip(chosen, labels):
            out[i] = "\n".join(text for (_, text, _), is_main in zip(parsed[i], mains) if is_main)
    return out


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = SAMPLE_PAGES, most_bytes: int = SAMPLE_BYTES) -> BlockLabeller:
    """Fit on ``most`` pages of at most ``most_bytes`` bytes, those whose id hashes lowest."""
    size = F.octet_length(html_col)
    rows = pages.where(size.between(1, most_bytes)).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    model = fit([r.html for r in training.lowest_hashed(rows, "id", most).collect()])
    training.give_back()
    return model


def extract_main_text(pages: DataFrame, model: BlockLabeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      together: int = 256) -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Null and empty html, and pages without main text, give an empty text. Where no page of the sample
    named its parts, the text is that of all blocks which ``unnamed`` keeps. Repeated rows, null ids and
    null urls are kept. Only the three named columns are read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema[id_col].dataType.simpleString()

    def work(rows):
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[2] or "")
            if len(held) >= together or size > 8 << 20:
                yield from finish(held)
                held, size = [], 0
        yield from finish(held)

    def finish(held):
        for (page_id, url, _), text in zip(held, main_texts(shared.value, [r[2] for r in held])):
            yield page_id, url, text, len(text)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return common.map_rows(rows, ["page_id", "url", "html"], work, f"page_id {kind}, url string, text string, n_chars long")
