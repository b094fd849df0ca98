"""Main text of web pages by a recurrent labeller of blocks.

A page becomes its sequence of blocks: the text between two block-level tags,
with the path of open elements. Each block is a vector: hashed elements, classes and ids
of its path, hashed words, and a few measures of the text. A bidirectional
LSTM (numpy, forward and backward pass over the page) reads the whole sequence, so a
block's label depends on all others; a logistic output says main text or not.

No page is labelled by hand. The network learns from pages of which the markup itself says so: blocks
inside an article or main element are main text, blocks inside navigation,
header, footer, aside, form, or an element with a class, id or role that is the name of an
advert, a notice, comments or a menu are not. A name that only has such a word as a part says
nothing by itself, nor does the name of an element around the page's main element or all its
articles; a header inside an article or main element belongs to it. While training, the telling elements are
hidden from a part of the pages, so that words, position and neighbours
must do. Elements that never hold main text (navigation, footer, forms and
so on, as the contract lists them) also bound the result: their blocks are never returned.

It is fitted on a bounded sample of pages and applied to every page, whole.

Defined cases: a null or empty page, or one without text, gives the empty
text. Unclosed and stray tags are tolerated as browsers do. A page of which
the network takes no block gives the empty text; without any page to learn from,
everything that is not ruled out is taken.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcella.llm.common import arrow_map, importable

#: Elements without text of their own, those that begin a block,
#: those without an end tag, those that a paragraph's start closes.
SKIPPED = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title")
BLOCKS = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_BLOCK = frozenset({"br"})
#: Elements, and whole names in class, id or role, that are never main text.
RULED_OUT = frozenset("nav header footer aside form menu dialog button".split())
OUT_NAMES = re.compile(
    r"(?:ad|ads|advert|advertisement|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs"
    r"|sidebar|side|footer|header|masthead|cookie|cookies|consent|notice|popup|modal|newsletter|subscribe|comment|comments|reply|replies"
    r"|disqus|share|social|related|login|signup|search)"
)
MAIN = frozenset(("article", "main"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    ruled_out: bool
    main: bool


def blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order; references decoded, white space collapsed and trimmed.

    What an advert, a button or the like holds inside a line is a block of its own, and the line goes on behind it.
    """
    # Of an open element: name, labels, ruled out as such, ruled out by a name, main and article elements inside.
    page, found, stack, parts, at, articles = page or "", [], [], [], 0, 0

    # Where a line is left for such an element: its place in the stack and the line so far.
    held = []

    def give(parts, stack):
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            path = tuple(label for e in stack for label in e[1])
            found.append((text, path, tuple(stack), any(e[0] in MAIN for e in stack)))

    def flush():
        for k, line in held:
            give(line, stack[:k])
        give(parts, stack)

    def close(k):
        while held and held[-1][0] >= k:
            give(parts, stack)
            depth, line = held.pop()
            del stack[depth:]
            parts.extend(line)
        del stack[k:]

    while at < len(page):
        tag = TOKEN.search(page, at)
        if tag is None:
            parts.append(page[at:])
            break
        parts.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in SKIPPED:
            if not tag[1] and not tag[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            if name in NOT_BLOCK:
                parts.append(" ")
                continue
            flush()
        if tag[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in MAIN and name not in BLOCKS:
                    break
        elif name not in VOID and not tag[3].rstrip().endswith("/"):
            if name in BLOCKS and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            while name == "p" and stack and any(e[0] == "p" for e in stack[-2:]):
                close(len(stack) - 1)
            values = [x for m in NAMES.finditer(tag[3]) for x in (m[1] or m[2] or m[3] or "").lower().split()]
            own = name == "header" and any(e[0] in MAIN for e in stack)
            named = not own and name not in ("html", "body", "main") and any(OUT_NAMES.fullmatch(v) for v in values)
            articles += name == "article"
            if name in MAIN:
                for e in stack:
                    e[4 if name == "main" else 5] += 1
            ruled = name in RULED_OUT and not own
            if name not in BLOCKS and (ruled or named):
                held.append((len(stack), parts[:]))
                parts.clear()
            stack.append([name, [name, *(f"{name}.{v}" for v in values)], ruled, named, 0, 0])
    flush()

    def out(e):
        return e[2] or e[3] and not e[4] and not 0 < e[5] == articles

    return [Block(text, path, any(map(out, elements)), main) for text, path, elements, main in found]


PATH_SIZE, WORD_SIZE, MEASURES = 24, 24, 8
INPUT = PATH_SIZE + WORD_SIZE + MEASURES
HIDDEN = 16
#: Pages that the network is fitted on, and passes over them.
SAMPLE_PAGES = 300
#: Longer pages are not learnt from, so that the sample has a bounded size.
SAMPLE_CHARS = 100_000
EPOCHS = 8
BATCH = 32
RATE = 0.02


def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def vectors(page: list[Block], hide: bool = False) -> np.ndarray:
    """One row per block. ``hide`` leaves out the elements that tell the label."""
    x = np.zeros((len(page), INPUT), np.float32)
    for i, block in enumerate(page):
        for label in block.path:
            tag = label.partition(".")[0]
            if not (hide and (tag in MAIN or tag in RULED_OUT or "." in label)):
                x[i, _slot(label, PATH_SIZE)] = 1
        # All words count; in a long block each of them less.
        words = block.text.split(" ")
        weight = min(0.25, 8 / len(words))
        for word, times in Counter(words).items():
            x[i, PATH_SIZE + _slot(word.lower(), WORD_SIZE)] += weight * times
        n = len(block.text)
        letters = sum(map(str.isalpha, block.text))
        own = (
            min(1.0, np.log1p(n) / 8),
            min(1.0, np.log1p(len(words)) / 6),
            letters / n,
            block.text[0].isupper(),
            block.text[-1] in ".!?…\"'»”",
            any(c in block.text for c in "|»©·"),
            i / len(page),
            min(1.0, len(page) / 100),
        )
        x[i, PATH_SIZE + WORD_SIZE :] = own
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights: for each direction input and recurrent ones of four gates; then the output's."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls) -> Network:
        draw = np.random.Generator(np.random.PCG64(3))
        size = INPUT + HIDDEN
        w = {}
        for side in "fb":
            w[f"w{side}"] = (draw.standard_normal((size, 4 * HIDDEN)) / np.sqrt(size)).astype(np.float32)
            w[f"c{side}"] = np.zeros(4 * HIDDEN, np.float32)
            w[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        w["wo"] = (draw.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        w["co"] = np.zeros(1, np.float32)
        return cls(w)

    def _read(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction; x is time by page by input."""
        steps, pages, _ = x.shape
        w, bias = self.weights[f"w{side}"], self.weights[f"c{side}"]
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            joined = np.hstack([x[t], h])
            gates = joined @ w + bias
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep is not None:
                keep.append((t, joined, i, f, o, g, c, squashed, m))
            c = np.where(m, new, c)
            h = np.where(m, o * squashed, h)
            out[t] = h
        return out

    def margins(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        tapes = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        both = np.concatenate([self._read(x, mask, side, tapes[side]) for side in "fb"], axis=2)
        if keep is not None:
            keep.update(both=both, **tapes)
        return both @ self.weights["wo"] + self.weights["co"]

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by going back through time."""
        keep: dict = {}
        z = self.margins(x, mask, keep)
        error = np.where(mask, _sigmoid(z) - y, 0).astype(np.float32) / max(1, mask.sum())
        grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
        grads["wo"] = np.einsum("tp,tph->h", error, keep["both"])
        grads["co"] = np.array([error.sum()], np.float32)
        for k, side in enumerate("fb"):
            out = self.weights["wo"][k * HIDDEN : (k + 1) * HIDDEN]
            w, gw, gc = self.weights[f"w{side}"], grads[f"w{side}"], grads[f"c{side}"]
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, joined, i, f, o, g, c, squashed, m in reversed(keep[side]):
                dh = dh + error[t][:, None] * out
                here, cell = np.where(m, dh, 0), np.where(m, dc, 0)
                cell = cell + here * o * (1 - squashed**2)
                gates = np.hstack([cell * g * i * (1 - i), cell * c * f * (1 - f), here * squashed * o * (1 - o), cell * i * (1 - g**2)])
                gw += joined.T @ gates
                gc += gates.sum(0)
                dh = np.where(m, (gates @ w.T)[:, INPUT:], dh)
                dc = np.where(m, cell * f, dc)
        return grads


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for k, own in enumerate(pages):
        x[: len(own), k], mask[: len(own), k] = own, True
    return x, mask


def train(pages: list[list[Block]]) -> Network:
    """Fit the network on pages whose markup tells the labels."""
    network, draw = Network.fresh(), np.random.Generator(np.random.PCG64(4))
    rows = [(vectors(p, hide), np.array([b.main and not b.ruled_out for b in p], np.float32)) for p in pages for hide in (False, True)]
    rows.sort(key=lambda r: len(r[0]))  # batches of like lengths
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    step = 0
    for _ in range(EPOCHS):
        for a in draw.permutation(range(0, len(rows), BATCH)):
            part = rows[a : a + BATCH]
            x, mask = _padded([r[0] for r in part])
            y, _ = np.zeros(mask.shape, np.float32), None
            for k, r in enumerate(part):
                y[: len(r[1]), k] = r[1]
            step += 1
            for name, g in network.gradients(x, y, mask).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                rate = RATE / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
                network.weights[name] = network.weights[name] - (rate * first[name] / (np.sqrt(second[name]) + 1e-7)).astype(np.float32)
    return network


def label(network: Network | None, pages: list[list[Block]]) -> list[list[bool]]:
    """Whether each block is main text; pages of like lengths are read together."""
    out: list[list[bool]] = [[not b.ruled_out for b in p] for p in pages]
    if network is None:
        return out
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    a = 0
    while a < len(order):
        # At most about 20,000 blocks at once, padding included.
        b = a + 1
        while b < len(order) and (b - a + 1) * len(pages[order[b]]) <= 20_000:
            b += 1
        x, mask = _padded([vectors(pages[k]) for k in order[a:b]])
        z = network.margins(x, mask) > 0
        for k, n in enumerate(order[a:b]):
            out[n] = [keep and not block.ruled_out for keep, block in zip(z[: len(pages[n]), k].tolist(), pages[n])]
        a = b
    return out


def fit(pages: DataFrame) -> Network | None:
    """A network from pages that have both kinds of blocks, chosen by a hash of their text."""
    usable = pages.where(F.length("html") <= SAMPLE_CHARS)
    total = usable.count()
    share = F.pmod(F.xxhash64("html", F.lit(17)), F.lit(1_000_003)) / 1_000_003
    chosen = usable.where(share < (SAMPLE_PAGES / total if total > SAMPLE_PAGES else 2.0))
    told = []
    # Copies share the hash, so they are chosen together: one of them is enough, and about SAMPLE_PAGES are collected.
    for r in chosen.select("html").distinct().orderBy(F.xxhash64("html"), "html").collect():
        own = blocks(r["html"])
        if any(b.main and not b.ruled_out for b in own) and any(not b.main or b.ruled_out for b in own):
            told.append(own)
    return train(told) if told else None


def extract_text(pages: DataFrame, output: str = "text") -> DataFrame:
    """All columns but html, and the main text; a column of that name is replaced."""
    spark = importable(pages.sparkSession)
    network = spark.sparkContext.broadcast(fit(pages))
    kept = [c for c in pages.columns if c.lower() not in ("html", output.lower())]
    own = pages.select(*kept, "html")

    def run(batch):
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            found = [blocks(h.as_py()) for h in part.column(len(kept))]
            labels = label(network.value, found)
            texts = ["\n".join(b.text for b, keep in zip(p, ks) if keep) for p, ks in zip(found, labels)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*kept, output])

    return arrow_map(own, T.StructType([*own.schema.fields[:-1], T.StructField(output, T.StringType())]), run)
