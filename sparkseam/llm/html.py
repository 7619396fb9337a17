"""Main-text extraction: flat text blocks, described by word count and link density of themselves and their neighbours,
classified by a decision tree that is trained on a small labelled table."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkseam.llm.html_labels import PAGES

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|object)\b[^>]*>(?:.*?</\1\s*>|.*\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")

# HTML elements that begin and end a block, those whose content isn't the article's, and words that name such parts.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("address article aside body button details dialog div dl fieldset figure footer form head header main menu nav ol section table title ul".split())
ASIDE = frozenset("aside button dialog fieldset footer form head menu nav title".split())
NAMED = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disclaimer discussion footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split())
MAIN = frozenset(("article", "main"))
# Words that may stand beside those of NAMED in the name of a part; those of an article may not stand beside "header", which holds its title.
BESIDE = frozenset("area bar block bottom box container content global inner item left links list main page primary right secondary section site top wrap wrapper".split())
OF_ARTICLE = frozenset("article entry post".split())
TALK = frozenset("comment comments discussion replies reply respond".split())


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    aside: bool
    main: bool
    heading: bool


@dataclass
class Part:
    """An open element: its flags (by its tag, by its name or as a form, as one of readers' talk) and what it holds."""

    name: str
    aside: bool
    named: bool
    talk: bool
    main: bool
    words: int = 0
    h1s: int = 0
    holds_main: bool = False


def _named(name: str) -> frozenset[str]:
    """The words of NAMED in a class or id that as a whole names a part that isn't the article's ("sidebar-left", but neither
    "has-sidebar" nor "tag-social" nor "entry-header"); else none."""
    parts = set(_PART.findall(name))
    found = parts & NAMED
    beside = parts - NAMED - BESIDE
    return frozenset(found) if not beside or beside <= OF_ARTICLE and not found & {"header", "masthead"} else frozenset()


def blocks(page: str) -> list[Block]:
    """The page's non-empty text blocks in order. Unknown and unclosed markup is tolerated.

    A name, or being a form, doesn't count for an element that holds main, all of the page's h1, or over half of its words.
    Readers' talk may hold over half of the words; a form also doesn't count if it holds an article.
    """
    out: list[Block] = []
    within_: list[list[Part]] = []
    open_: list[Part] = []
    h1s = 0
    text: list[str] = []
    linked: list[str] = []
    in_link, heading = False, False

    def end() -> None:
        nonlocal text, linked
        if t := " ".join(html.unescape("".join(text)).split()):
            n = len(html.unescape("".join(linked)).split())
            out.append(Block(t, len(t.split()), n, any(x.aside for x in open_), any(x.main for x in open_), heading))
            within_.append(list(open_))
            for x in open_:
                x.words += out[-1].words
        text, linked = [], []

    at = 0
    for m in _MARK.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            if in_link:
                linked.append(page[at : m.start()])
        at = m.end()
        tag = _TAG.match(m[0])
        if not tag or m[1]:
            continue
        close, name = tag[1], tag[2].lower()
        if name == "a":
            in_link = not close
            linked.append(" ")
        elif name in ("br", "img", "input", "wbr"):
            text.append(" ")
        if name not in BLOCKS:
            continue
        end()
        heading = not close and name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name == "h1" and not close:
            h1s += 1
            for x in open_:
                x.h1s += 1
        if name not in CONTAINERS:
            continue
        if not close:
            main = name in MAIN or "main" in (x.lower() for y in _NAMES.findall(m[0]) for x in y if "role" in m[0].lower())
            within = any(x.main for x in open_)
            for x in open_:
                x.holds_main |= main and (name != "article" or x.name == "form")
            found = frozenset().union(*(_named(x) for y in _NAMES.findall(m[0]) for x in "".join(y).lower().split())) if name not in ("body", "html", "main") else frozenset()
            aside = name in ASIDE and name != "form" or name == "header" and not within
            open_.append(Part(name, aside, bool(found) or name == "form", bool(found & TALK), main))
        else:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k].name == name:
                    del open_[k:]
                    break
    if at < len(page):
        text.append(page[at:])
    end()
    half = sum(b.words for b in out) / 2
    for b, parts in zip(out, within_, strict=True):
        b.aside |= any(x.named and not x.holds_main and not 0 < x.h1s == h1s and (x.talk or x.words <= half) for x in parts)
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "aside", "main", "heading")


def table(bs: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; beyond the page's ends, neighbours have none."""
    own = np.array([[b.words, b.link_words / b.words] for b in bs], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    flags = np.array([[b.aside, b.main, b.heading] for b in bs], float).reshape(-1, 3)
    return np.hstack([own, np.vstack([none, own])[:-1], np.vstack([own, none])[1:], flags])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> dict | float:
    """A binary decision tree: splits of least Gini impurity, on the middle between neighbouring values."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            score = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            best = min(best, (score, f, float(cut)))
    if best[0] == np.inf:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return {"f": best[1], "cut": best[2], "low": grow(x[low], y[low], depth - 1), "high": grow(x[~low], y[~low], depth - 1)}


def judge(tree: dict | float, x: np.ndarray) -> np.ndarray:
    """For each row the tree's share of main text."""
    if not isinstance(tree, dict):
        return np.full(len(x), tree)
    low = x[:, tree["f"]] <= tree["cut"]
    out = np.empty(len(x))
    out[low], out[~low] = judge(tree["low"], x[low]), judge(tree["high"], x[~low])
    return out


def train() -> dict | float:
    """The tree of the labelled pages: each is a list of (markup, 1 if its blocks are main text)."""
    xs, ys = [], []
    for page in PAGES:
        bs, marks = blocks("".join(m for m, _ in page)), []
        for markup, label in page:
            marks += [label] * len(blocks(markup))
        if len(marks) != len(bs):
            raise ValueError("a labelled fragment must hold whole blocks")
        xs.append(table(bs))
        ys.append(np.array(marks, float))
    return grow(np.vstack(xs), np.concatenate(ys))


def main_text(page: str | None, tree: dict | float) -> str:
    bs = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(bs, judge(tree, table(bs)) > 0.5, strict=True) if keep) if bs else ""


def extracted(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (main text, blocks joined by two line feeds), n_chars (its code points).

    Null or empty html and pages without main text give "" and 0. Every row gives a row; extra columns are ignored.
    """
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [main_text(h, tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(t, pa.string()), pa.array([len(x) for x in t], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
