"""HTML extraction by a recurrent block labeller.

A page becomes its sequence of text blocks, the leaves of its block elements. Each block is described by its tag path
(tags, class, id and role words of all open elements, hashed, nearer ones weighing more), its words (all of them,
hashed), and a few measures such as its length and share of link text. A bidirectional LSTM, in numpy, reads the whole
sequence and labels every block as main text or not, so a block is judged by all that stands before and after it. It is
trained here by backpropagation through time, in one task, on generated pages of many layouts, whose labels are known by
construction; no page of the input is needed for it. Some of these pages have names that tell what a part is, others names that
tell nothing or none, some have elements made for menus and articles, others only div, table cells or line breaks. Of an
element's names only those that training knows count. Blocks labelled as main text are joined by one space.

Scripts, styles, templates, controls of forms, titles and the text of iframes yield no blocks; comments and markup never
do. Raw text (scripts, styles, titles and the like) ends at its own end tag only; other such elements stand among the open
ones, and what is in them goes when they close. One that its parents, its like or the end of the page have to close loses
only what stands before the first block element in it. Drawings, media, objects and what stands in for scripts become
blocks of their own, known by their element, for the labeller to judge; formulas are part of their block's text.
Character references are decoded, also those that lack their semicolon where HTML allows it; any Unicode white space
counts as white space.

A page is read in time in proportion to its length whatever its markup: tags, quotes and comments that never end are
found to do so once, elements are looked up by name, and a path is one node that knows its parent.

Defined cases: null and empty html give an empty text; broken markup never fails: what doesn't parse as a tag is text,
unclosed elements end with their parents; pages are read whole, however long or deep; repeated rows come out once each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.commits import CommitLog, Conflict
from contextloom.llm.common import ship
from contextloom.storage import root_dir

# Elements of HTML by their kind.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe head".split())
MUTED = frozenset("template select button datalist".split())
ALONE = frozenset("button select".split())  # never inside their like
JUDGED = frozenset("noscript svg object audio video canvas".split())  # drawn, played, or shown in place of something
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body table ul ol dl article section div main aside nav header footer form td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

LOOSE = frozenset("div ul ol dl".split())  # scopes that end with what they stand in
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")

PATH, WORDS, MEASURES, HIDDEN = 384, 128, 8, 24
NEARER = 0.85
WORD_WEIGHT, FEW_WORDS = 0.3, 6.0  # the words of a short text tell less
WORD_DECAY = 1.5  # of the words' weights, in steps of the learning rate: words are many, pages to learn from few
UNREAD = 0.4  # share of the pages that are learned from without their words
PAGES, EPOCHS = 8000, 12  # generated pages to learn from, and how often
MAX_NODES = 20_000
STEPS = 50_000  # blocks that are read at a time, with padding


class Node:
    """A tag path: its last element's key and the path before. Like paths are one node, on all pages of a worker."""

    __slots__ = ("parent", "key", "children", "gates", "vector")

    def __init__(self, parent: Node | None, key: str):
        self.parent, self.key = parent, key
        self.children: dict[str, Node] = {}
        self.gates: tuple[object, np.ndarray] | None = None
        self.vector: np.ndarray | None = None

    def child(self, key: str) -> Node:
        if key not in self.children:
            Paths.nodes += 1
            self.children[key] = Node(self, key)
        return self.children[key]


class Paths:
    """The paths known so far; they start anew between pages when there are many."""

    root, nodes = Node(None, ""), 0

    @classmethod
    def start(cls) -> Node:
        if cls.nodes > MAX_NODES:
            cls.root, cls.nodes = Node(None, ""), 0
        return cls.root


@dataclass
class Block:
    path: Node
    text: str
    linked: int  # characters of link text


@functools.lru_cache(maxsize=20_000)
def element_key(tag: str, attributes: str) -> str:
    """Tag and the words of class, id and role: what the labeller knows of an element."""
    words: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "")
        words += WORD.findall(value.lower())
    return " ".join([tag, *dict.fromkeys(w for w in words if len(w) > 1)])


class Scanner:
    """Tags and comments of a page, each found in time in proportion to what it spans."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.last_body: int | None = None

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) from ``at`` on; comments and declarations have no name."""
        page = self.page
        while (lt := page.find("<", at)) >= 0:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                return lt, len(page) if end < 0 else end + 3, False, "", ""
            if self.last[">"] < lt:  # no tag ends any more
                lt = page.find("<!--", lt)
                return (lt, len(page), False, "", "") if lt >= 0 else None
            if page.startswith(("<!", "<?"), lt):
                return lt, page.find(">", lt) + 1, False, "", ""
            closing = page.startswith("</", lt)
            if m := NAME.match(page, lt + 1 + closing):
                end = self.tag_end(m.end())
                return lt, end + 1, closing, m[0].lower(), page[m.end() : end]
            at = lt + 1
        return None

    def tag_end(self, at: int) -> int:
        """The first > outside quotes; if quotes don't pair up, the first of all."""
        i = at
        while (i := PLAIN.match(self.page, i).end()) < len(self.page):  # type: ignore[union-attr]
            c = self.page[i]
            if c == ">":
                return i
            if self.last[c] <= i:
                break
            i = self.page.find(c, i + 1) + 1
        return self.page.find(">", at)

    def raw_end(self, name: str, at: int) -> int:
        """Where the text of a raw element ends, its end tag included; the end of the page if there is none."""
        end = re.compile(rf"</{name}\s*>" if name != "head" else r"</head\s*>|(?=<body)", re.I).search(self.page, at)
        return end.end() if end else len(self.page)

    def body_after(self, at: int) -> bool:
        if self.last_body is None:
            self.last_body = max((m.start() for m in re.finditer("<body", self.page, re.I)), default=-1)
        return self.last_body >= at


class Reader:
    """Reads a page into blocks. Open elements are found by name, so no step looks through all of them."""

    def __init__(self, page: str):
        self.scan = Scanner(page)
        self.out: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.tags: list[str] = []  # open elements
        self.paths: list[Node] = [Paths.start()]  # and the path down to each
        self.places: dict[str, list[int]] = {}  # by name
        self.blocks: list[int] = []  # places of block elements
        self.scopes: list[int] = []
        self.hard: list[int] = []  # of scopes that aren't loose
        #: Of each muted element: its place, and blocks, parts and linked as they were, kept once it holds a block element.
        self.muted: list[tuple[int, tuple[int, list[str], int] | None]] = []
        self.judged: list[list] = []  # place of each judged element and its first block, once there is text
        self.marks: list[tuple[int, int, str]] = []  # blocks of judged elements that have ended

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.out.append(Block(self.paths[-1], text, self.linked))
            self.parts.clear()
        self.linked = 0

    def silent(self) -> bool:
        return bool(self.muted) and self.muted[-1][1] is None

    def add(self, text: str) -> None:
        if self.silent():
            return
        if self.judged and self.judged[-1][1] is None and text.strip():
            self.flush()
            for entry in reversed(self.judged):
                if entry[1] is not None:
                    break
                entry[1] = len(self.out)
        self.parts.append(text)
        if self.places.get("a"):
            self.linked += len(text)

    def push(self, name: str, path: Node) -> None:
        k = len(self.tags)
        self.tags.append(name)
        self.paths.append(path)
        self.places.setdefault(name, []).append(k)
        if name in BLOCKS:
            self.blocks.append(k)
        if name in SCOPES:
            self.scopes.append(k)
            if name not in LOOSE:
                self.hard.append(k)

    def leave(self, k: int) -> None:
        """The element at ``k`` ends, and all in it."""
        if self.blocks and self.blocks[-1] >= k:
            self.flush()
        spaced = False
        while self.muted and self.muted[-1][0] >= k:
            spaced |= self.tags[self.muted.pop()[0]] in ALONE
        while self.judged and self.judged[-1][0] >= k:
            self.judged.pop()
        for name in self.tags[k:]:
            self.places[name].pop()
        for places in (self.blocks, self.scopes, self.hard):
            while places and places[-1] >= k:
                places.pop()
        del self.tags[k:], self.paths[k + 1 :]
        if spaced:
            self.add(" ")

    def unmute(self, k: int) -> None:
        """The muted element at ``k`` ends by its own end tag: nothing of it stays."""
        before = next(state for at, state in reversed(self.muted) if at == k)
        spaced = self.tags[k] in ALONE
        self.leave(k)
        if before:
            n = before[0]
            del self.out[n:]
            self.parts[:], self.linked = before[1], before[2]
            while self.marks and self.marks[-1][0] >= n:
                self.marks.pop()
            if self.marks and self.marks[-1][1] > n:
                self.marks[-1] = (self.marks[-1][0], n, self.marks[-1][2])
            if spaced:
                self.add(" ")

    def judge(self, k: int) -> None:
        """The judged element at ``k`` ends by its own end tag: its blocks are known by it."""
        name, start = self.tags[k], next(first for at, first in reversed(self.judged) if at == k)
        if start is not None:
            self.flush()
        self.leave(k)
        if start is not None:
            while self.marks and self.marks[-1][0] >= start:
                self.marks.pop()
            self.marks.append((start, len(self.out), name))

    def begin(self) -> None:
        """A block element begins: muted elements that are open may never end, so from here on their text is kept for now."""
        if self.silent():
            self.parts[:] = ["".join(self.parts)]  # one piece, so that keeping it is cheap
            state = (len(self.out), list(self.parts), self.linked)
            for i in range(len(self.muted) - 1, -1, -1):
                if self.muted[i][1] is not None:
                    break
                self.muted[i] = (self.muted[i][0], state)

    def close(self, name: str) -> None:
        if at := self.places.get(name):
            barrier = () if name in BLOCKS else self.hard if name in MUTED or name in JUDGED else self.scopes
            if not barrier or barrier[-1] <= at[-1]:
                (self.unmute if name in MUTED else self.judge if name in JUDGED else self.leave)(at[-1])
        if name in BLOCKS and not self.silent():
            self.flush()

    def close_before(self, name: str) -> None:
        """Elements that a block element of this name ends, up to the nearest scope: paragraphs, and its like in lists and tables."""
        closes = ("p", *CLOSED_BY.get(name, ()))
        while True:
            stop = max(self.scopes[-1] if self.scopes else -1, self.muted[-1][0] if self.muted else -1)
            k = max((at[-1] for c in closes if (at := self.places.get(c))), default=-1)
            if k < 0 or (k < stop) or (k == stop and self.tags[k] not in closes):
                return
            self.leave(k)
            if name not in CLOSED_BY:
                return

    def open(self, name: str, attributes: str) -> None:
        if name in MUTED or name in JUDGED:
            if attributes.endswith("/"):
                return  # closed at once
            if name in MUTED:
                if name in ALONE and (at := self.places.get(name)):
                    self.leave(at[-1])
                self.muted.append((len(self.tags), None))
            else:
                self.judged.append([len(self.tags), None])
            return self.push(name, self.paths[-1])
        if name == "br":
            self.add(" ")
        if name in VOID:
            if name == "hr" and not self.silent():
                self.flush()
            return None
        path = self.paths[-1]
        if name in BLOCKS:
            self.begin()
            self.flush()
            self.close_before(name)
            path = self.paths[-1].child(element_key(name, attributes))
        return self.push(name, path)

    def read(self) -> list[Block]:
        page, at = self.scan.page, 0
        while found := self.scan.next(at):
            start, end, closing, name, attributes = found
            if start > at:
                self.add(page[at:start])
            at = end
            if not name:
                continue
            if closing:
                self.close(name)
            elif name in RAW and not attributes.endswith("/"):
                if name != "head" or self.scan.body_after(at):
                    at = self.scan.raw_end(name, at)
                    if name == "textarea":
                        self.add(" ")
            else:
                self.open(name, attributes)
        if at < len(page):
            self.add(page[at:])
        self.flush()
        for start, end, name in self.marks:
            for b in self.out[start:end]:
                b.path = b.path.child(name)
        return self.out


def blocks_of(page: str | None) -> list[Block]:
    return Reader(page or "").read()


def slot(word: str, of: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % of, 1.0 if h >> 31 else -1.0


@functools.lru_cache(maxsize=20_000)
def key_vector(key: str) -> np.ndarray:
    """An element's tag and those of its names that training has shown; others would only meet known ones by chance."""
    v = np.zeros(PATH, np.float32)
    for i, word in enumerate(key.split()):
        if i == 0 or word in known_names():
            k, sign = slot(("<" if i == 0 else ".") + word, PATH)
            v[k] += sign
    return v


@functools.cache
def known_names() -> frozenset[str]:
    names = [*MAIN_NAMES, *WRAPPERS, *COMMENT_NAMES, *(n for group in OTHER_NAMES.values() for n in group)]
    return frozenset(w for n in names for w in element_key("div", f'class="{n}"').split()[1:])


def path_vector(path: Node) -> np.ndarray:
    """The keys of a path, nearer ones weighing more: that of the path before, weakened, and the last key's."""
    chain = []
    while path.vector is None and path.parent is not None:
        chain.append(path)
        path = path.parent
    v = np.zeros(PATH, np.float32) if path.vector is None else path.vector
    for node in reversed(chain):
        v = node.vector = NEARER * v + key_vector(node.key)
    return v


class WordSlots(dict):
    """Word -> its bucket, those of negative sign behind the others."""

    def __missing__(self, word: str) -> int:
        k, sign = slot(word, WORDS)
        value = k if sign > 0 else WORDS + k
        if len(word) <= 64:
            if len(self) > 150_000:
                self.clear()
            self[word] = value
        return value


SLOTS = WordSlots()


def measures(blocks: list[Block], first: int = 0, of: int | None = None) -> np.ndarray:
    """Words, all of them, and measures of each block; the first one is number ``first`` of the page's ``of``."""
    of = of or len(blocks)
    x = np.zeros((len(blocks), WORDS + MEASURES), np.float32)
    for i, b in enumerate(blocks):
        words = b.text.lower().split(" ")
        found = np.bincount(np.fromiter(map(SLOTS.__getitem__, words), np.int64, len(words)), minlength=2 * WORDS)
        v = (found[:WORDS] - found[WORDS:]).astype(np.float32)
        x[i, :WORDS] = v * (WORD_WEIGHT / (FEW_WORDS + float(np.sqrt(v @ v))))
        n = len(b.text)
        ends = sum(map(b.text.count, ".!?"))
        x[i, WORDS:] = (
            np.log1p(len(words)) / 4, min(1.0, b.linked / n), min(1.0, 10 * ends / len(words)), float("©" in b.text or "copyright" in words), (first + i) / of,
            float(first + i == 0), float(first + i == of - 1), float(b.path.key.split(" ")[0] in HEADINGS),
        )
    return x


# ---- the network ----
def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output for each block; both directions share no weights."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        inputs, h = PATH + WORDS + MEASURES, HIDDEN
        self.p: dict[str, np.ndarray] = {"out": r.normal(0, 0.2, (2 * h, 1)), "out_b": np.zeros(1)}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 0.15, (inputs, 4 * h))
            self.p[f"h{d}"] = r.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p[f"b{d}"] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def sweep(self, d: str, z: np.ndarray, mask: np.ndarray, tape: list | None = None, state: list | None = None) -> np.ndarray:
        """Hidden states of one direction; z: time x pages x gates, the inputs' share; mask: time x pages.

        ``state`` (hidden and cell) is where the sweep starts, and is left as it ends.
        """
        steps, n, _ = z.shape
        h, c = state or [np.zeros((n, HIDDEN), np.float32)] * 2
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[t] + h @ self.p[f"h{d}"]
            s = sigmoid(g[:, : 3 * HIDDEN])
            i, f, o = (s[:, k * HIDDEN : (k + 1) * HIDDEN] for k in (0, 1, 2))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c1 = (f * c + i * u) * m
            tc = np.tanh(c1)
            h1 = o * tc * m
            if tape is not None:
                tape.append((t, h, c, i, f, o, u, tc, m))
            h, c = h1, c1
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def back(self, d: str, dh_out: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the gates (as z) and of the recurrent weights."""
        steps, n, _ = dh_out.shape
        dz = np.zeros((steps, n, 4 * HIDDEN), np.float32)
        dw = np.zeros_like(self.p[f"h{d}"])
        dh = dc = np.zeros((n, HIDDEN), np.float32)
        for t, h, c, i, f, o, u, tc, m in reversed(tape):
            dh = (dh + dh_out[t]) * m
            dc = (dc + dh * o * (1 - tc * tc)) * m
            g = np.concatenate((dc * u * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)), 1)
            dz[t] = g
            dw += h.T @ g
            dh, dc = g @ self.p[f"h{d}"].T, dc * f
        return dz, dw

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 5, size: int = 48, rate: float = 0.012, seed: int = 5) -> None:
        """Adam on the log loss of all blocks; ``pages`` are (inputs, labels)."""
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = sorted(r.permutation(len(pages)).tolist(), key=lambda k: len(pages[k][1]) // 8)
            groups = [order[k : k + size] for k in range(0, len(order), size)]
            for k in r.permutation(len(groups)):
                step += 1
                grads = self.gradients([pages[j] for j in groups[k]])
                for name, g in grads.items():
                    np.clip(g, -1, 1, out=g)
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.999 * m2[name] + 0.001 * g * g
                    speed = rate * (0.5 ** (epoch * 4 / epochs)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    if name[0] == "x":
                        self.p[name][PATH : PATH + WORDS] *= np.float32(1 - speed * WORD_DECAY)
                    self.p[name] -= (speed * m1[name] / (np.sqrt(m2[name]) + 1e-7)).astype(np.float32)

    def gradients(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
        steps = max(len(y) for _, y in pages)
        x = np.zeros((steps, len(pages), PATH + WORDS + MEASURES), np.float32)
        y, mask = np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32)
        for k, (px, py) in enumerate(pages):
            x[: len(py), k], y[: len(py), k], mask[: len(py), k] = px, py, 1
        tapes: dict[str, list] = {"f": [], "b": []}
        hidden = np.concatenate([self.sweep(d, x @ self.p[f"x{d}"] + self.p[f"b{d}"], mask, tapes[d]) for d in "fb"], 2)
        p = sigmoid((hidden @ self.p["out"])[:, :, 0] + self.p["out_b"][0])
        e = (p - y) * mask / mask.sum()
        grads = {"out": np.tensordot(hidden, e, ((0, 1), (0, 1)))[:, None], "out_b": np.array([e.sum()], np.float32)}
        dh = e[:, :, None] * self.p["out"][:, 0]
        for k, d in enumerate("fb"):
            dz, dw = self.back(d, dh[:, :, k * HIDDEN : (k + 1) * HIDDEN], tapes[d])
            grads |= {f"x{d}": np.tensordot(x, dz, ((0, 1), (0, 1))), f"h{d}": dw, f"b{d}": dz.sum((0, 1))}
        return grads

    def path_gates(self, path: Node) -> np.ndarray:
        """A path's share of both directions' gates; kept with the path, as pages of a site have few."""
        chain = []
        while path.parent is not None and (path.gates is None or path.gates[0] is not self):
            chain.append(path)
            path = path.parent
        v = path.gates[1] if path.parent is not None and path.gates else np.zeros(8 * HIDDEN, np.float32)
        for node in reversed(chain):
            if node.key not in self.key_gates:
                if len(self.key_gates) > MAX_NODES:
                    self.key_gates.clear()
                self.key_gates[node.key] = key_vector(node.key) @ self.both[:PATH]
            v = NEARER * v + self.key_gates[node.key]
            node.gates = (self, v)
        return v

    @functools.cached_property
    def key_gates(self) -> dict[str, np.ndarray]:
        return {}

    @functools.cached_property
    def both(self) -> np.ndarray:
        """The inputs' weights of both directions."""
        return np.concatenate([self.p[f"x{d}"] for d in "fb"], 1)

    def gates(self, pages: list[list[Block]], start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The inputs' share of the gates, and the mask, for blocks ``start`` to ``end`` of each page."""
        z = np.zeros((end - start, len(pages), 8 * HIDDEN), np.float32)
        mask = np.zeros((end - start, len(pages)), np.float32)
        bias = np.concatenate([self.p[f"b{d}"] for d in "fb"])
        for k, page in enumerate(pages):
            some = page[start:end]
            if some:
                z[: len(some), k] = measures(some, start, len(page)) @ self.both[PATH:] + bias
                z[: len(some), k] += np.stack([self.path_gates(b.path) for b in some])
                mask[: len(some), k] = 1
        return z, mask

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """The probability of being main text of every block.

        Pages of like length are read side by side, at most 128 and ``STEPS`` blocks with padding; a longer page by
        itself, in stretches of ``STEPS`` that pass on their state.
        """
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and end - start < 128 and (end - start + 1) * len(pages[order[end]]) <= STEPS:
                end += 1
            some = [pages[k] for k in order[start:end]]
            steps = len(some[-1])
            h = np.zeros((steps, len(some), 2 * HIDDEN), np.float32)
            stretches = [(t, min(t + STEPS, steps)) for t in range(0, steps, STEPS)]
            held = self.gates(some, 0, steps) if len(stretches) == 1 else None
            for k, d in enumerate("fb"):
                state = [np.zeros((len(some), HIDDEN), np.float32)] * 2
                for t, upto in stretches if d == "f" else reversed(stretches):
                    z, mask = held or self.gates(some, t, upto)
                    h[t:upto, :, k * HIDDEN : (k + 1) * HIDDEN] = self.sweep(d, z[:, :, k * 4 * HIDDEN : (k + 1) * 4 * HIDDEN], mask, None, state)
            p = sigmoid((h @ self.p["out"])[:, :, 0] + self.p["out_b"][0])
            for i, k in enumerate(order[start:end]):
                out[k] = p[: len(pages[k]), i]
            start = end
        return out


# ---- generated pages ----
# Names that sites give to the parts of a page.
MAIN_NAMES = "content post-content article-body entry-content story post entry main-content article text body-text page-content post-body articleBody".split()
OTHER_NAMES = {
    "nav": "nav navigation menu navbar main-nav topnav breadcrumb breadcrumbs pagination tabs toc".split(),
    "header": "header site-header masthead topbar page-header banner branding logo".split(),
    "footer": "footer site-footer page-footer copyright legal bottom colophon".split(),
    "aside": "sidebar side-bar widget related related-posts recommended popular trending more-stories rail".split(),
    "notice": "notice cookie cookie-banner consent alert gdpr message popup modal newsletter subscribe signup paywall".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsbox".split(),
    "comments": "comments comment-list reader-comments responses disqus discussion comment-thread".split(),
    "form": "search search-form login contact subscribe-form feedback".split(),
    "share": "share social social-share sharing follow byline meta post-meta tags author-box".split(),
}
CUES = {
    "nav": "home about contact products services blog news archive next previous menu more".split(),
    "footer": "© copyright rights reserved privacy policy terms imprint contact".split(),
    "notice": "use cookies accept policy subscribe newsletter sign site agree".split(),
    "ad": "buy now sale offer sponsored best price shop free click".split(),
    "comments": "reply says ago comment posted thanks great agree".split(),
    "share": "share tweet author posted tags follow like".split(),
    "fallback": "browser support please enable javascript view video audio content".split(),
}


COMMENT_NAMES, WRAPPERS = ["comment", "comment-body", "reply"], ["wrapper", "page", "container", "layout", "site", "wrap"]
# Beginnings of names that kits of styles give to elements.
KIT = "mt mb px py p m w h text bg flex grid col row gap border rounded font leading max min items justify".split()
ALL_CUES = sorted({w for words in CUES.values() for w in words if w.isalpha()})


class Pages:
    """Random pages with the truth about each text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.naming, self.tagged = "known", True
        letters = "etaoinshrdluéüçñcmfpgwyb"
        self.vocabulary = ["".join(self.r.choices(letters, k=self.r.randint(2, 8))) for _ in range(20_000)]

    def pick(self, items: list[str]) -> str:
        return self.r.choice(items)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, low: int, high: int, cues: list[str] | None = None) -> str:
        out = self.r.choices(self.vocabulary, k=self.r.randint(low, high))
        if cues:
            out = [self.pick(cues) if self.chance(0.4) else w for w in out]
        elif self.chance(0.5):  # cue words are words of any text, too
            out = [self.pick(ALL_CUES) if self.chance(0.1) else w for w in out]
        text = " ".join(out)
        if self.chance(0.08):
            text = "*** ".join(out)
        return (text.capitalize() + "." if high > 6 else text) if text else text

    def odd_name(self) -> str:
        """A name that tells nothing: a tool's, a module's, some of a kit's, or any words."""
        letters, form = "abcdefghijklmnopqrstuvwxyz", self.r.randrange(5)
        some = lambda k, of=letters: "".join(self.r.choices(of, k=k))
        if form == 0:
            return self.pick(["css-", "sc-", "jsx-", "_", "e1", ""]) + some(self.r.randint(4, 8), letters + "0123456789")
        if form == 1:
            return f"{some(self.r.randint(2, 6))}-{some(self.r.randint(2, 6))}"
        if form == 2:
            return f"{some(5).capitalize()}_{some(4)}__{some(5, letters + '0123456789')}"
        if form == 3:
            return " ".join(f"{self.pick(KIT)}-{self.pick(['1', '2', '4', '8', 'full', 'sm', 'lg', 'auto'])}" for _ in range(self.r.randint(1, 4)))
        return " ".join(self.r.choices(self.vocabulary, k=self.r.randint(1, 2)))

    def element(self, tag: str, inner: str, names: list[str] | None = None) -> str:
        attributes = ""
        if self.naming == "odd" and self.chance(0.8 if names else 0.5):
            attributes = f' {self.pick(["class", "class", "class", "id"])}="{self.odd_name()}"'
        elif names and self.naming == "known":
            attributes = f' {self.pick(["class", "class", "id"])}="{self.pick(names)}"'
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def links(self, low: int, high: int, cues: list[str] | None) -> str:
        items = [f'<a href="/x">{self.words(1, 3, cues)}</a>' for _ in range(self.r.randint(low, high))]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>"
        return " ".join(items)

    def other(self, kind: str) -> str:
        """A part that isn't main text."""
        names, cues = OTHER_NAMES[kind], CUES.get(kind)
        if not self.tagged or self.naming != "known" and kind in ("notice", "ad", "comments", "share"):
            return self.untold(kind, cues)
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        plain = self.naming == "known" and (tag == "div" or self.chance(0.4))
        if kind == "comments":
            tag = self.pick(["section", "div", "aside", "ol"])
            inner = self.element("h3", self.words(1, 3, cues)) * self.chance(0.7)
            item = "li" if tag == "ol" else self.pick(["div", "p", "article"])
            inner += "".join(self.element(item, self.words(3, 60, cues), COMMENT_NAMES) for _ in range(self.r.randint(1, 4)))
            return self.element(tag, inner, names)
        if kind == "form":
            inner = self.element("label", self.words(1, 3)) + "<input name=q>" + self.element("p", self.words(2, 12)) * self.chance(0.4) + "<button>ok</button>"
            return self.element(tag, inner, names if self.chance(0.6) else None)
        if kind == "nav" or (kind in ("header", "footer", "aside") and self.chance(0.5)):
            inner = self.links(2, 9, cues)
        elif kind in ("aside", "footer", "ad", "notice") and self.chance(0.5):
            inner = self.words(2, 40, cues) if self.chance(0.5) else self.element("p", self.words(3, 60, cues))
        else:
            inner = self.element(self.pick(["p", "span", "div"]), self.words(1, 15, cues))
        if kind == "footer" and self.chance(0.6):
            inner = f"&copy; {self.words(1, 3)} &middot; {self.words(2, 14)}" if self.chance(0.6) else inner + " © 2024"
        if kind in ("aside", "share", "ad") and self.chance(0.4):
            inner = self.element(self.pick(["h2", "h3", "h4"]), self.words(1, 4)) + inner
        if plain:
            return self.element(self.pick(["div", "div", "section"]) if tag == "div" or self.chance(0.5) else tag, inner, names)
        return self.element(tag, inner)

    def untold(self, kind: str, cues: list[str] | None) -> str:
        """A part that neither its element nor a name gives away: only its links, words, length and place do."""
        tag = self.pick(["div", "div", "section", "span", "p"]) if kind in ("footer", "ad", "header", "comments") else "div"
        if kind == "form":
            inner = "<input name=q><button>ok</button>"
        elif kind in ("footer", "notice", "ad", "comments"):
            text = self.words(2, 14, cues) if kind != "notice" else " ".join(self.r.choices(CUES["notice"], k=self.r.randint(3, 12)))
            inner = f"&copy; {self.r.randint(1995, 2026)} {text}" if kind == "footer" else f'<a href="/z">{text}</a>' if kind == "ad" else f'{text} <a href="/ok">{self.words(1, 2, cues)}</a>' if kind == "notice" else self.links(1, 3, cues)
        elif kind == "header":
            inner = f'<a href="/">{self.words(1, 3)}</a>' if self.chance(0.6) else self.links(2, 6, CUES["nav"])
        else:
            inner = self.links(2, 9, cues)
            if kind == "aside" and self.chance(0.6):
                inner = self.element(self.pick(["h3", "h4", "div"]), self.words(1, 3, CUES["nav"])) + inner
        if kind == "footer":
            if self.chance(0.3):
                inner = f"Copyright {self.r.randint(1995, 2026)} {self.words(1, 4)}"
            if self.chance(0.4):  # no element of its own
                return self.pick(["<hr>", ""]) + self.element(self.pick(["small", "font", "center"]), inner)
        for _ in range(self.r.choice([0, 0, 1, 2])):
            inner = self.element("div", inner)
        return self.element(tag, inner, OTHER_NAMES[kind])

    def fallback(self) -> str:
        """What is shown in place of a script or of media."""
        tag = self.pick(["noscript", "noscript", "video", "audio", "object", "canvas"])
        inner = self.words(3, 14, CUES["fallback"])
        return self.element(tag, self.element("p", inner) if self.chance(0.3) else inner)

    def broken(self) -> str:
        """Paragraphs told apart by line breaks only, which make up one block."""
        return self.pick(["<br>", "<br><br>", "<br/>\n<br/>"]).join(self.words(4, 90) for _ in range(self.r.randint(2, 8)))

    def body(self) -> str:
        """The blocks of main text, with markers around what is to be found."""
        if self.chance(0.05):
            return self.element("h1", "\x01" + self.words(2, 12)) * self.chance(0.7) + self.element("div", "\x01" + self.broken())
        out = []
        if self.chance(0.8):
            out.append(("h1", self.words(2, 12)))
        plain = self.chance(0.4)  # nothing but paragraphs
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 14, 14, 25])):
            kind = "p" if plain else self.pick(["p", "p", "p", "p", "p", "h2", "li", "blockquote", "pre", "div", "figcaption", "td"])
            short = self.chance(0.3 if self.tagged else 0.1)
            text = self.words(1, 6) if short else self.words(4, 90)
            out.append((kind, text.capitalize() + "." if short and self.chance(0.6) else text))
        parts, crossed = [], self.pick([0.0, 0.0, 0.15, 0.3])
        for kind, text in out:
            if kind == "li":
                parts.append("<ul>" + "".join(f"<li>\x01{self.words(1, 14)}</li>" for _ in range(self.r.randint(1, 4))) + "</ul>")
            elif kind == "td":
                parts.append("<table><tr>" + "".join(f"<td>\x01{self.words(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            elif kind == "p" and self.chance(0.15):
                parts.append(f"<p><b>\x01{text}<br>")  # unclosed
            elif kind == "p" and self.chance(0.05):
                parts.append(f"<p>\x01{text} {self.fallback()} \x01{self.words(2, 20)}</p>" if self.chance(0.5) else f"<p>\x01{text} <math><mi>{self.words(1, 1)}</mi><mo>=</mo><mn>2</mn></math></p>")
            elif kind == "figcaption" and self.chance(0.3):
                parts.append(f"<figure><svg viewBox='0 0 1 1'><text x=1>\x01{self.words(1, 4)}</text></svg><figcaption>\x01{text}</figcaption></figure>")
            elif kind in ("p", "div") and self.chance(0.06):
                parts.append(self.element("div", "\x01" + self.broken()))
            elif self.naming == "odd" or not self.tagged:
                tag = "div" if kind == "p" and self.chance(0.3) else kind
                inner = f"\x01{text}"
                parts.append(self.element(tag, self.element("span", inner) if self.chance(0.15) else inner, MAIN_NAMES))
            else:
                if self.chance(0.2) and " " in text:
                    head, _, tail = text.partition(" ")
                    text = f'{head} <a href="/y">{tail[:20]}</a>{tail[20:]}'
                parts.append(f"<{kind}>\x01{text}</{kind}>")
            if self.chance(crossed):
                parts.append(self.other(self.pick(["ad", "aside", "aside", "share", "form", "notice" if self.naming == "known" and self.tagged else "ad"])))
            if self.chance(0.04):
                parts.append(self.fallback())
        return "".join(parts)

    def page(self) -> str:
        """A page whose names and elements tell its parts apart, or one of them does, or neither."""
        self.naming = self.r.choices(["known", "odd", "none"], [7, 2, 1])[0]
        self.tagged = self.chance(0.92 if self.naming == "known" else 0.6)
        kinds = list(OTHER_NAMES)
        dense, denser = (self.pick([0.0, 0.15, 0.3, 0.45, 0.7]) for _ in range(2))  # pages have few parts or many, before and after
        before = [self.other(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if self.chance(max(dense, 0.6 * (k == "nav")))]
        told = self.naming == "known" and self.tagged
        after = [self.other(k) for k in ("share", "comments", "aside", "ad", "notice" if told else "ad", "form", "footer") if self.chance(max(denser, 0.6 * (k == "footer")))]
        body = self.body()
        if self.chance(denser / 2):
            body += self.other(self.pick(["share", "comments", "aside", "ad"]))
        if self.chance(0.2):
            before.append(self.other(self.pick(kinds)))
        if self.chance(0.1):
            before.append(self.fallback())
        self.r.shuffle(before)
        inside = self.cells(before, body, after) if self.chance(0.08) else "".join([*before, self.main(body), *after])
        for _ in range(self.r.choice([0, 0, 0, 1, 1, 2])):
            inside = self.element("div", inside, WRAPPERS)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{inside}</body></html>"

    def main(self, body: str) -> str:
        if not self.tagged:
            for _ in range(self.r.randint(0, 3)):
                body = self.element(self.pick(["div", "div", "section"]), body, MAIN_NAMES)
            return body
        form = self.r.choice([0, 1, 2, 3] if self.naming == "known" else [0, 1, 3])
        if form == 0:
            return self.element("article", body)
        if form == 1:
            return self.element("main", self.element("article", body) if self.chance(0.5) else body)
        if form == 2:
            return self.element(self.pick(["div", "section", "article"]), body, MAIN_NAMES)
        return self.element("article", self.element("div", body, MAIN_NAMES))

    def cells(self, before: list[str], body: str, after: list[str]) -> str:
        """The parts as cells of a table, as old pages have them; some are the cell's own text."""
        if self.chance(0.6):
            after = [*after, self.pick(["<font size=1>{}</font>", "<small>{}</small>", "{}"]).format(f"{self.pick(['&copy;', 'Copyright'])} {self.r.randint(1995, 2026)} {self.words(1, 8)}")]
        if self.chance(0.4):
            before = [self.pick(["<b>{}</b>", '<a href="/">{}</a>']).format(self.words(1, 3)), *before]
        cell = lambda inner: self.element("td", inner) if inner else ""
        rows = self.r.randrange(3)
        if rows == 0:
            return "<table><tr>" + cell("".join(before)) + cell(body) + cell("".join(after)) + "</tr></table>"
        row = lambda inner: f"<tr>{cell(inner)}</tr>" if inner else ""
        if rows == 1:
            return "<table>" + row("".join(before)) + row(body) + row("".join(after)) + "</table>"
        side = self.element("td", self.links(3, 9, CUES["nav"]))
        return "<table>" + row("".join(before)) + f"<tr>{side}{cell(body)}</tr>" + row("".join(after)) + "</table>"


def inputs_of(blocks: list[Block]) -> np.ndarray:
    return np.concatenate((np.stack([path_vector(b.path) for b in blocks]), measures(blocks)), 1)


def generated(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks and labels of ``n`` random pages; a marker in front of a text says that it is main text."""
    made = Pages(seed)
    out = []
    for _ in range(n):
        blocks = blocks_of(made.page())
        y = np.array([b.text.startswith("\x01") for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace("\x01", "").strip()
        if blocks:
            out.append((blocks, y))
    return out


@functools.lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """The labeller, fitted in this process; the same at every call."""
    net, chance = Labeller(seed), random.Random(seed)
    examples = []
    for blocks, y in generated(pages, seed):
        x = inputs_of(blocks)
        if chance.random() < UNREAD:  # so that the layout is learned, too, and words of other languages don't mislead
            x[:, PATH : PATH + WORDS] = 0
        examples.append((x, y))
    net.train(examples, epochs=epochs, seed=seed)
    return net


def trained_in_task(spark: SparkSession, pages: int = PAGES, epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """The same, fitted in one task: Spark gives it one thread, with which small matrices are multiplied fastest."""
    ship(spark)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                p = trained(pages, epochs, seed).p
                shapes = [",".join(map(str, v.shape)) for v in p.values()]
                yield pa.record_batch({"name": list(p), "shape": shapes, "weights": pa.array([v.tobytes() for v in p.values()], pa.binary())})

    return with_weights(spark.range(0, 1, 1, 1).mapInArrow(fit, NET).collect(), seed)  # some 600 KB


NET = "name string, shape string, weights binary"


def kept(spark: SparkSession, pages: int = PAGES, epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """The same, trained once for all applications that share ``spark.checkpoint.dir`` and have this code.

    Its weights hang on nothing but this module and the parameters, whose digest names the folder where they are kept.
    """
    digest = hashlib.sha256(Path(__file__).read_bytes() + repr((pages, epochs, seed)).encode()).hexdigest()[:24]
    log = CommitLog(spark, f"{root_dir(spark)}/loom-models/html-{digest}")
    state = log.latest()
    if not state.number:
        p = trained_in_task(spark, pages, epochs, seed).p
        rows = [(k, ",".join(map(str, v.shape)), bytearray(v.astype(np.float32).tobytes())) for k, v in p.items()]
        name = log.write(spark.createDataFrame(rows, NET).coalesce(1))
        with contextlib.suppress(Conflict):  # another application trained it meanwhile
            log.commit(state, ((name, 1),), {})
        state = log.latest()
    return with_weights(log.rows(state, NET).collect(), seed)


def with_weights(rows: list, seed: int) -> Labeller:
    net = Labeller(seed)
    net.p = {r["name"]: np.frombuffer(bytes(r["weights"]), np.float32).reshape([int(x) for x in r["shape"].split(",")]).copy() for r in rows}
    return net


def extract(net: Labeller, pages: list[str | None], least: float = 0.5) -> list[str]:
    blocks = [blocks_of(p) for p in pages]
    return [" ".join(b.text for b, p in zip(bs, ps.tolist(), strict=True) if p >= least) for bs, ps in zip(blocks, net.label(blocks), strict=True)]


def main_texts(pages: DataFrame, net: Labeller | None = None, html_column: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    net = net or kept(pages.sparkSession)
    weights = net.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.p = weights
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.slice(start, 512)
                texts = extract(own, batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_column).cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
