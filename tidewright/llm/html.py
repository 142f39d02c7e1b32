"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page (operator 8).

A page is cut into leaf blocks: runs of text that no block-level tag interrupts. A block's features are its ancestor
tags, the words of their classes and ids, and the shape of its text. The field has two labels, article and other, with
weights for features and for label transitions; it is trained by stochastic gradient ascent of the likelihood, by
forward-backward sums, on labelled pages, and decoded by Viterbi. The labelled pages are drawn by rule from common page
layouts (``labelled_pages``), so training needs no data file and is the same everywhere.

Null and empty pages give an empty text; so does a page without an article block. Broken markup is read as far as it
makes sense: open tags end with their parents or the page. Repeated rows give equal rows. Extra columns are kept; a
column named like a result is replaced by it.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.columns import with_arrow_columns

# Element names of HTML by role (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul button label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content HTML defines as raw text; noscript is one for readers that run scripts.
RAW = frozenset("script style textarea noscript iframe xmp noembed noframes title".split())
#: Elements that a start tag of the key ends, if they are the innermost of their kind.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
#: Elements whose start tag ends an open paragraph.
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "button", "label", "option", "legend"}
#: Walls that an implied end does not cross.
SCOPE = frozenset("table ul ol dl td th article section div body html aside nav main header footer form".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A leaf block: its text, the elements around it as (tag, words of its class and id), and its characters in links."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, white space made single and character references decoded."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    pieces: list[str] = []
    linked = at = depth = 0

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, tuple(stack), linked))
            pieces.clear()
        linked = 0

    def pop(k: int) -> None:
        nonlocal depth
        if any(name in BLOCK for name, _ in stack[k:]):
            close()
        depth -= sum(name == "a" for name, _ in stack[k:])
        del stack[k:]

    def end_open(names: set[str], walls: frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                if stack[k][0] in ("td", "th") and names > {"td", "th"}:
                    pop(k)
                    return end_open(names, walls)
                return pop(k)
            if stack[k][0] in walls:
                return None
        return None

    while m := _TOKEN.match(page, at):
        at = m.end()
        text = m["text"] if m["text"] is not None else m["cdata"]
        if text is not None:
            text = entities.unescape(text) if m["text"] else text
            pieces.append(text)
            if depth:
                linked += len(text)
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            else:
                if name in BLOCK:
                    close()
            continue
        if name in RAW and not m["attrs"].endswith("/"):
            found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if found or name != "noscript":
                at = found.end() if found else len(page)
                continue
        if name == "br":
            pieces.append(" ")
        if name in BLOCK:
            if name in ENDS_P:
                end_open({"p"}, SCOPE)
            if name in ENDS:
                end_open(ENDS[name], SCOPE - ENDS[name])
            close()
        if name not in VOID and not (m["attrs"].endswith("/") and name not in BLOCK and name != "a"):
            words = tuple(w for v in _NAMES.findall(m["attrs"]) for w in _WORD.findall(v.lower()))
            stack.append((name, words))
            depth += name == "a"
    close()
    return out


def _size_step(n: int) -> int:
    return n.bit_length()


@lru_cache(maxsize=4096)
def _path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str, ...]:
    out = {f"in={name}" for name, _ in path if name in BLOCK}
    out |= {f"named={w}" for _, words in path for w in words}
    inner = next((name for name, _ in reversed(path) if name in BLOCK), "none")
    return (*sorted(out), f"leaf={inner}")


def features(block: Block) -> list[str]:
    """The names of a block's features."""
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    out = ["always", *_path_features(block.path), f"words={min(7, _size_step(words))}", f"linked={min(4, 4 * block.linked // max(1, n))}"]
    if text[-1] in ".!?…。”\"'»":
        out.append("sentence")
    if "©" in text:
        out.append("copyright")
    if "|" in text or "·" in text or "»" in text:
        out.append("bars")
    return out


@dataclass
class Field:
    """Weights of a linear-chain field of two labels: by feature, by transition from and to, and for the first block."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    step: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    first: tuple[float, float] = (0.0, 0.0)

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi); 1 is the article. Ties go to other."""
        zero = (0.0, 0.0)
        (s00, s01), (s10, s11) = self.step
        a, b = self.first
        back: list[tuple[int, int]] = []
        for k, names in enumerate(blocks):
            x = y = 0.0
            for name in names:
                w = self.weights.get(name, zero)
                x += w[0]
                y += w[1]
            if k:
                from0, from1 = a + s00 >= b + s10, a + s01 >= b + s11
                back.append((0 if from0 else 1, 0 if from1 else 1))
                a, b = (a + s00 if from0 else b + s10), (a + s01 if from1 else b + s11)
            a, b = a + x, b + y
        label = int(b > a)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1] if blocks else []


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 14, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Field:
    """Learn the field's weights by stochastic gradient ascent with per-weight steps (AdaGrad)."""
    index: dict[str, int] = {}
    coded = []
    for blocks, labels in pages:
        if blocks:
            ids = [[index.setdefault(f, len(index)) for f in names] for names in blocks]
            flat = np.array([i for b in ids for i in b])
            owner = np.repeat(np.arange(len(ids)), [len(b) for b in ids])
            coded.append((flat, owner, np.array(labels)))
    w, wg = np.zeros((len(index), 2)), np.full((len(index), 2), 1e-2)
    t, tg = np.zeros((3, 2)), np.full((3, 2), 1e-2)
    rng = np.random.default_rng(seed)

    def log_sum(x: np.ndarray) -> np.ndarray:
        high = x.max(0)
        return high + np.log(np.exp(x - high).sum(0))

    for _ in range(epochs):
        for k in rng.permutation(len(coded)):
            flat, owner, label = coded[k]
            n = len(label)
            score = np.stack([np.bincount(owner, w[flat, c], n) for c in (0, 1)], 1)
            ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
            ahead[0] = score[0] + t[2]
            for i in range(1, n):
                ahead[i] = score[i] + log_sum(ahead[i - 1][:, None] + t[:2])
            for i in range(n - 2, -1, -1):
                behind[i] = log_sum((t[:2] + (score[i + 1] + behind[i + 1])[None, :]).T)
            total = log_sum(ahead[-1])
            error = -np.exp(ahead + behind - total)
            error[np.arange(n), label] += 1
            gw = np.zeros_like(w)
            np.add.at(gw, flat, error[owner])
            gt = np.zeros((3, 2))
            gt[2] = error[0]
            if n > 1:
                pair = np.exp(ahead[:-1, :, None] + t[None, :2] + (score[1:] + behind[1:])[:, None, :] - total)
                gt[:2] = -pair.sum(0)
                np.add.at(gt, (label[:-1], label[1:]), 1)
            for x, g, held in ((w, gw - decay * w, wg), (t, gt, tg)):
                held += g * g
                x += rate * g / np.sqrt(held)
    names = sorted(index, key=index.get)
    pairs = [tuple(map(float, r)) for r in t]
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for i, f in enumerate(names)}, (pairs[0], pairs[1]), pairs[2])


# Class and id names by which page layouts commonly mark their parts (fixed values).
NAMES = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs topnav links toc pagination pager",
    "header": "header masthead banner top topbar branding logo",
    "footer": "footer bottom colophon copyright legal foot",
    "aside": "sidebar aside related widget rail recommended trending popular side",
    "ad": "ad ads advert advertisement sponsored promo promotion sponsor adsense banner",
    "notice": "cookie cookies consent notice gdpr alert popup modal subscribe newsletter paywall disclaimer warning notification",
    "form": "form search login signup contact",
    "comments": "comments comment discussion disqus replies responses reply thread",
    "share": "share social sharing follow tags tag meta",
    "article": "article content post entry story main text body",
}


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of random common layouts with the label of every leaf block: 1 in the article, else 0."""
    rnd = random.Random(seed)
    names = {k: v.split() for k, v in NAMES.items()}

    def text(low: int, high: int) -> str:
        words = ["".join(rnd.choice("aeiouthnsrlcdmäé") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(low, high))]
        return " ".join(words).capitalize()

    def sentence() -> str:
        return text(*rnd.choice([(1, 2), (3, 12), (10, 60), (40, 160)])) + rnd.choice([".", ".", ".", "!", "?", ""])

    def tag(kind: str, semantic: str) -> tuple[str, str]:
        name = semantic if rnd.random() < 0.55 else rnd.choice(["div", "div", "section"])
        known = f' {rnd.choice(["class", "class", "id"])}="{rnd.choice(names[kind])}{rnd.choice(["", "", "-wrap", " box", "_1"])}"'
        attrs = known if name in ("div", "section") or rnd.random() < 0.4 else ""
        return f"<{name}{attrs}>", f"</{name}>"

    def part(kind: str) -> tuple[str, list[int]]:
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        head, tail = tag(kind, semantic)
        if kind == "nav":
            items = [f'<li><a href="/{i}">{text(1, 3)}</a></li>' for i in range(rnd.randint(2, 8))]
            return f"{head}<ul>{''.join(items)}</ul>{tail}", [0] * len(items)
        if kind == "footer":
            lines = [f"<p>{rnd.choice(['&copy; ', '', '© '])}{text(2, 14)}{rnd.choice(['', '.', ' &middot; ' + text(1, 4)])}</p>" for _ in range(rnd.randint(1, 3))]
            lines = lines if rnd.random() < 0.6 else [x[3:-4] for x in lines[:1]]
            return head + "".join(lines) + tail, [0] * len(lines)
        if kind == "form":
            lines = [f"<label>{text(1, 3)}</label><input name=q>", f"<button>{text(1, 2)}</button>"][: rnd.randint(1, 2)]
            return head + "".join(lines) + tail, [0] * len(lines)
        lines = [f"<{t}>{sentence()}</{t}>" for t in (rnd.choice(["p", "p", "p", "div", "h3", "li"]) for _ in range(rnd.randint(1, 4)))]
        lines = lines if rnd.random() < 0.6 else [sentence()]
        return head + "".join(lines) + tail, [0] * len(lines)

    def article() -> tuple[str, list[int]]:
        head, tail = tag("article", rnd.choice(["article", "article", "main"]))
        if rnd.random() < 0.3:
            outer = rnd.choice([("<main>", "</main>"), ('<div id="content">', "</div>"), ("<section>", "</section>")])
            head, tail = outer[0] + head, tail + outer[1]
        out, labels = [], []
        if rnd.random() < 0.8:
            out.append(f"<h1>{text(1, 10)}{rnd.choice(['', '.'])}</h1>")
            labels.append(1)
        for _ in range(rnd.randint(1, 12)):
            kind = rnd.random()
            if kind < 0.72:
                out.append(rnd.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p><b>{}<br>", "<div>{}</div>"]).format(sentence()))
                labels.append(1)
            elif kind < 0.8:
                out.append(f"<h2>{text(1, 6)}</h2>")
                labels.append(1)
            elif kind < 0.88:
                items = [rnd.choice(["<li>{}</li>", '<li><a href="#">{}</a></li>', "<li>{}"]).format(text(1, 12)) for _ in range(rnd.randint(1, 4))]
                out.append(f"<ul>{''.join(items)}</ul>")
                labels += [1] * len(items)
            elif kind < 0.92:
                out.append(f"<blockquote>{sentence()}</blockquote>")
                labels.append(1)
            elif kind < 0.94:
                out.append(f"<table><tr><td>{text(1, 5)}<td>{text(1, 5)}</table>")
                labels += [1, 1]
            else:
                more, other = part(rnd.choice(["ad", "ad", "form", "aside", "notice", "share", "nav"]))
                out.append(more)
                labels += other
        if rnd.random() < 0.25:
            more, other = part("comments")
            out.append(more)
            labels += other
        return head + "".join(out) + tail, labels

    pages = []
    for _ in range(n):
        before = [part(k) for k in ("notice", "header", "nav", "ad", "aside", "form") if rnd.random() < 0.5]
        after = [part(k) for k in ("share", "comments", "aside", "ad", "nav", "form", "notice", "footer") if rnd.random() < 0.5]
        rnd.shuffle(before)
        before, after = ([] if rnd.random() < 0.2 else before), ([] if rnd.random() < 0.2 else after)
        parts = [*before, article(), *after]
        cut = "" if rnd.random() < 0.2 else "</body></html>"
        head = f"<!DOCTYPE html><html><head><title>{text(1, 5)}</title><style>p{{}}</style></head><body>"
        head, cut = ("", "") if rnd.random() < 0.15 else (head, cut)
        pages.append((head + "".join(p for p, _ in parts) + cut, [x for _, labels in parts for x in labels]))
    return pages


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on ``labelled_pages``."""
    return train([([features(b) for b in leaf_blocks(page)], labels) for page, labels in labelled_pages()])


def main_text(page: str | None, model: Field) -> str:
    """The article of a page: its blocks in page order, joined by single spaces."""
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, label in zip(blocks, model.decode([features(b) for b in blocks]), strict=True) if label)


def extract(pages: DataFrame, model: Field | None = None, html: str = "html") -> DataFrame:
    """Add ``text``, the article of each whole page, and ``n_chars``, its code points."""
    model = model or default_field()

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        text = [main_text(p, model) for p in batch[html].to_pylist()]
        return {"text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())}

    return with_arrow_columns(pages, run, "text string, n_chars long")
