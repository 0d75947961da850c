"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the texts between block-level tags. Each block has hashed vectors of
its tag path (tags, classes and ids of the elements around all of its text) and of its words, and a few
figures. A bidirectional LSTM in numpy reads a page's blocks in order and labels every one with the
whole page as context; the blocks it keeps make the text. The model is trained here, on made-up pages.
Time grows with a page's length, however it nests; a page of more than WINDOW blocks is read in windows.

Results for odd input: null or empty html, and pages without a main block, give an empty text;
broken or cut-off markup is read as far as it goes; repeated rows and null ids are extracted each; other
columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.llm.common import column, slices, utf8
from heftgraph.llm.html_pages import MARK, Maker
from heftgraph.llm.words import hash_words

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: HTML elements by how they are laid out.
BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown, or is a form's.
HIDDEN = set("script style noscript template head title iframe textarea".split())
RAW = set("script style textarea title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

PATH, WORD, FIGURES, HIDDEN_UNITS = 512, 16, 8, 24
WIDTH = PATH + WORD + FIGURES
#: Blocks that are labelled at once; a page of more is read in windows.
WINDOW = 8192


class Element:
    """An open element: what it and those around it say, as bits of the path vector."""

    __slots__ = ("name", "bits", "last", "names")

    def __init__(self, name: str, own: list[str], around: Element | None):
        self.name = name
        self.bits, self.names = (around.bits, around.names + len(own)) if around else (0, len(own))
        for n in own:
            h = zlib.crc32(n.encode())
            self.bits |= 1 << h % PATH | 1 << (h >> 12) % PATH
        self.last = 1 << (h >> 20) % PATH

    def path(self) -> tuple[int, int]:
        return self.bits | self.last, self.names


class Open:
    """The stack of open elements, with the places of each name and of the block elements."""

    def __init__(self):
        self.stack: list[Element] = []
        self.blocks: list[int] = []
        self.hidden = 0
        self._at: dict[str, list[int]] = {}

    def last(self, name: str) -> int | None:
        at = self._at.get(name)
        return at[-1] if at else None

    def push(self, name: str, own: list[str]) -> None:
        self._at.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.hidden += name in HIDDEN
        self.stack.append(Element(name, own, self.stack[-1] if self.stack else None))

    def pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            name = self.stack.pop().name
            self._at[name].pop()
            if name in BLOCK:
                self.blocks.pop()
            self.hidden -= name in HIDDEN


def _said(name: str, attrs: str) -> list[str]:
    """The name of an element and the words of its classes and ids."""
    if not attrs:
        return [name]
    return [name, *[f"{name[0]}.{w}" if len(w) < 2 else w for v in _ATTRS.findall(attrs) for w in re.split(r"[^a-z0-9]+", "".join(v).lower()) if w]]


def blocks(html: str) -> list[tuple[str, tuple[int, int], int]]:
    """(text, path, characters in links) of every leaf block with text, in page order.

    The path, (bits, number of names), is that of the innermost element around all of the text.
    """
    out: list[tuple[str, tuple[int, int], int]] = []
    now = Open()
    text: list[str] = []
    linked, at, n = 0, 0, len(html)
    around: Element | None = None
    depth = low = 0  # of around, and the lowest since

    def flush() -> None:
        nonlocal linked, around
        if text:
            t = " ".join(html_lib.unescape("".join(text)).split())
            if t:
                out.append((t, around.path() if around else (0, 0), min(linked, len(t))))
            text.clear()
        linked, around = 0, None

    def pop(to: int) -> None:
        nonlocal low
        now.pop(to)
        low = min(low, to)

    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if not now.hidden and (piece[0] != "<" or len(piece) == 1):
                if piece.strip():
                    if around is None or low < depth:
                        depth = min(low, depth) if around else len(now.stack)
                        low, around = depth, now.stack[depth - 1] if depth else None
                    linked += len(piece.strip()) if now.last("a") is not None else 0
                text.append(piece)
            continue
        name = name.lower()
        is_block = name in BLOCK
        if m[1]:
            if is_block:
                flush()
            to = now.last(name)
            if to is not None:
                pop(to)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                text.append(" ")
            continue
        if is_block:
            flush()
            p = now.last("p")
            if p is not None:
                pop(p)
            if now.blocks and now.stack[now.blocks[-1]].name in CLOSES.get(name, ()):
                pop(now.blocks[-1])
        attrs = m[3]
        if attrs.endswith("/") and not is_block and name not in RAW:
            continue
        now.push(name, _said(name, attrs))
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            pop(len(now.stack) - 1)
    flush()
    return out


def vectors(page_blocks: list[list[tuple[str, tuple[int, int], int]]], places: np.ndarray | None = None) -> np.ndarray:
    """The feature rows of the blocks of many pages, one after the other; places: of the blocks in their pages, from 0 to 1."""
    flat = [b for page in page_blocks for b in page]
    x = np.zeros((len(flat), WIDTH), np.float32)
    if not flat:
        return x
    data, offsets = utf8(pa.array([b[0] for b in flat], pa.large_string()))
    words, of = hash_words(data, offsets)
    count = np.bincount(of, minlength=len(flat))
    bins = np.bincount(of * WORD + (words >> np.uint64(60)).astype(np.int64), minlength=len(flat) * WORD).reshape(-1, WORD)
    x[:, PATH : PATH + WORD] = bins / np.maximum(count, 1)[:, None]
    chars = np.array([len(b[0]) for b in flat], float)
    if places is None:
        places = np.concatenate([np.arange(len(p)) / max(len(p), 1) for p in page_blocks])
    x[:, PATH + WORD :] = np.stack([np.log1p(chars) / 8, np.log1p(count) / 6, np.array([b[2] for b in flat]) / np.maximum(chars, 1), np.array([b[0][-1] in ".!?" for b in flat]), places, np.minimum([b[1][1] for b in flat], 64) / 16, np.array(["\xa9" in b[0] for b in flat]), np.ones(len(flat))], axis=1)
    raw = np.frombuffer(b"".join(b[1][0].to_bytes(PATH // 8, "little") for b in flat), np.uint8).reshape(len(flat), -1)
    x[:, :PATH] = np.unpackbits(raw, axis=1, bitorder="little")
    return x


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * a)


class Labeller:
    """Bidirectional LSTM with a logistic output over both hidden states and the input."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        h = HIDDEN_UNITS
        self.p = {}
        for d in "fb":
            self.p[d + "x"] = (r.standard_normal((WIDTH, 4 * h)) * 0.08).astype(np.float32)
            self.p[d + "h"] = (r.standard_normal((h, 4 * h)) * 0.15).astype(np.float32)
            self.p[d + "c"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.p["o"] = (r.standard_normal(2 * h + WIDTH) * 0.05).astype(np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """Hidden states over time (T x B x H); for training also what the way back needs."""
        t_max, b = mask.shape
        h = HIDDEN_UNITS
        z = (x.reshape(-1, WIDTH) @ self.p[d + "x"] + self.p[d + "c"]).reshape(t_max, b, 4 * h)
        hs, trail = np.zeros((t_max, b, h), np.float32), []
        ht, ct = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            a = z[t] + ht @ self.p[d + "h"]
            gates, g = _sigmoid(a[:, : 3 * h]), np.tanh(a[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            m = mask[t][:, None]
            c_new = (f * ct + i * g) * m
            tc = np.tanh(c_new)
            h_new = o * tc * m
            if keep:
                trail.append((t, i, f, o, g, ct, tc, ht))
            ht, ct = h_new, c_new
            hs[t] = ht
        return hs, trail

    def long_scores(self, page: list[tuple[str, tuple[int, int], int]]) -> np.ndarray:
        """Scores of one page's blocks in windows; both directions step together, each from its own end."""
        h, n = HIDDEN_UNITS, len(page)
        out = np.zeros(n, np.float32)
        halved = np.concatenate([np.full(3 * h, 0.5, np.float32), np.ones(h, np.float32)])  # tanh makes all four gates
        wh = np.stack([self.p["fh"], self.p["bh"]]) * halved
        state, cell = np.zeros((2, 1, h), np.float32), np.zeros((2, h), np.float32)
        for lo in range(0, n, WINDOW):
            hi = min(lo + WINDOW, n)
            x = [vectors([page[a:b]], np.arange(a, b) / n) for a, b in ((lo, hi), (n - hi, n - lo))]
            x[1] = x[1][::-1]
            z = np.stack([(own @ self.p[d + "x"] + self.p[d + "c"]) * halved for d, own in zip("fb", x, strict=True)], axis=1)
            seen = np.empty((hi - lo, 2, h), np.float32)
            for t in range(hi - lo):
                a = np.tanh(z[t] + (state @ wh)[:, 0])
                gates = a[:, : 3 * h] * 0.5 + 0.5
                cell = gates[:, h : 2 * h] * cell + gates[:, :h] * a[:, 3 * h :]
                seen[t] = gates[:, 2 * h :] * np.tanh(cell)
                state[:, 0] = seen[t]
            out[lo:hi] += seen[:, 0] @ self.p["o"][:h] + x[0] @ self.p["o"][2 * h :]
            out[n - hi : n - lo] += (seen[:, 1] @ self.p["o"][h : 2 * h])[::-1]
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _ = self._run("f", x, mask, False)
        b, _ = self._run("b", x, mask, False)
        return np.concatenate([f, b, x], axis=2) @ self.p["o"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h = HIDDEN_UNITS
        f, ft = self._run("f", x, mask, True)
        b, bt = self._run("b", x, mask, True)
        seen = np.concatenate([f, b, x], axis=2)
        d_out = (_sigmoid(seen @ self.p["o"]) - y) * mask / max(mask.sum(), 1)
        g = {"o": np.tensordot(d_out, seen, axes=([0, 1], [0, 1]))}
        for d, trail, at in (("f", ft, 0), ("b", bt, h)):
            own = d_out[:, :, None] * self.p["o"][at : at + h]
            dh_next = np.zeros(own.shape[1:], np.float32)
            dc_next = np.zeros_like(dh_next)
            dz = np.zeros((*mask.shape, 4 * h), np.float32)
            dwh = np.zeros_like(self.p[d + "h"])
            for t, i, fg, o, gg, c_prev, tc, h_prev in reversed(trail):
                m = mask[t][:, None]
                dh = (own[t] + dh_next) * m
                dc = dh * o * (1 - tc**2) + dc_next * m
                da = np.concatenate([dc * gg * i * (1 - i), dc * c_prev * fg * (1 - fg), dh * tc * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
                dz[t] = da
                dwh += h_prev.T @ da
                dh_next, dc_next = da @ self.p[d + "h"].T, dc * fg
            g[d + "h"] = dwh
            g[d + "x"] = x.reshape(-1, WIDTH).T @ dz.reshape(-1, 4 * h)
            g[d + "c"] = dz.sum(axis=(0, 1))
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float = 0.01, batch: int = 32) -> None:
        """Adam over batches of pages of similar length."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        r, step = np.random.default_rng(5), 0
        for epoch in range(epochs):
            for j in r.permutation(len(groups)).tolist():
                x, mask = padded([pages[i][0] for i in groups[j]])
                y = np.zeros(mask.shape, np.float32)
                for k, i in enumerate(groups[j]):
                    y[: len(pages[i][1]), k] = pages[i][1]
                step += 1
                now = rate * (0.5 if epoch > epochs * 0.6 else 1)
                for k, gk in self.gradients(x, mask, y).items():
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v2[k] = 0.99 * v2[k] + 0.01 * gk * gk
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in pages)
    x, mask = np.zeros((t, len(pages), WIDTH), np.float32), np.zeros((t, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


def made_up(seed: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature rows and labels of n made-up pages."""
    maker, out = Maker(seed), []
    for _ in range(n):
        page = blocks(maker.page())
        y = np.array([MARK in b[0] for b in page], np.float32)
        clean = [(b[0].replace(MARK, "") or "-", b[1], b[2]) for b in page]
        if clean:
            out.append((vectors([clean]), y))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = 1300, epochs: int = 14) -> Labeller:
    model = Labeller()
    model.fit(made_up(11, pages), epochs)
    return model


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    """The main text of every page; pages are labelled together while padding stays small."""
    cut = [blocks(p) for p in pages]
    out = [""] * len(pages)

    def put(i: int, scores: np.ndarray) -> None:
        out[i] = "\n".join(b[0] for b, good in zip(cut[i], scores > 0, strict=True) if good)

    order = [i for i in sorted(range(len(cut)), key=lambda i: len(cut[i])) if cut[i]]
    while order:
        if len(cut[order[-1]]) > WINDOW:
            i = order.pop()
            put(i, model.long_scores(cut[i]))
            continue
        take, longest = [], 0
        while order and max(longest, len(cut[order[-1]])) * (len(take) + 1) <= WINDOW:
            take.append(order.pop())
            longest = max(longest, len(cut[take[-1]]))
        x = vectors([cut[i] for i in take])
        at = np.cumsum([0] + [len(cut[i]) for i in take])
        s = model.scores(*padded([x[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]))
        for k, i in enumerate(take):
            put(i, s[: len(cut[i]), k])
    return out


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast((model or trained()).p)
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches):
        own = Labeller()
        own.p = sent.value
        for batch in batches:
            for part in slices(batch, "html"):
                texts = main_texts(column(part, "html").to_pylist(), own)
                yield pa.RecordBatch.from_arrays([column(part, "page_id"), column(part, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, schema)
