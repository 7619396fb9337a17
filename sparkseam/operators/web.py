"""Web text as Arrow-batched functions: page text, headings of a home page, boilerplate lines."""

from __future__ import annotations

import html
import re
from itertools import islice

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that break a line, those of a home page that count or don't, labels that are no text, and phrases of boilerplate.
_BREAK = re.compile(r"</?(?:br|div|p|li|blockquote|pre)\b[^>]*>", re.I)
_TAG = re.compile(r"<!--.*?-->|<[A-Za-z/!?][^>]*>", re.S)
_IGNORED = re.compile(r"<(script|style|noscript|svg|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_HERO = re.compile(r"<(title|h1|h2|h3|p|li)\b[^>]*>(.*?)(?=</\1\s*>|<(?:title|h1|h2|h3|p|li)\b|\Z)", re.S | re.I)
_PREFIX = {"h1": "# ", "h2": "## ", "h3": "## ", "li": "- "}
_LABELS = ("log in", "login", "sign in", "menu")
_IMAGE = re.compile(r"\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)|!\[[^\]]*\]\([^)]*\)|data:image/[a-zA-Z]+;base64,[A-Za-z0-9+/=]+")
BOILERPLATE = (
    "skip to content", "accept cookies", "cookie settings", "privacy policy", "terms of service", "terms & conditions", "all rights reserved", "copyright", "sign in", "log in", "login", "menu", "navigation",
)


def _plain(fragment: str) -> str:
    """Markup removed; references decoded twice, as pages often hold encoded references; single spaces."""
    return " ".join(html.unescape(html.unescape(_TAG.sub("", fragment))).split())


def text_of(page: str | None) -> str:
    """Text of a provider's HTML on one line: block elements part words, character references are decoded; null gives ""."""
    return _plain(_BREAK.sub("\n", page or ""))


def hero_of(page: str | None, blocks: int = 32, chars: int = 6000) -> str:
    """Title, headings, paragraphs and list items among a page's first blocks as Markdown; labels and tiny ones are left out."""
    found = ((m[1].lower(), t) for m in _HERO.finditer(_IGNORED.sub("", page or "")) if (t := _plain(m[2])))
    return "\n".join(_PREFIX.get(tag, "") + t for tag, t in islice(found, blocks) if len(t) >= 3 and t.lower() not in _LABELS)[:chars]


def without_boilerplate(text: str | None) -> str:
    """Markdown without images and short boilerplate lines; of equal short lines the first stays; one blank line at most between lines."""
    out: list[str] = []
    seen: set[str] = set()
    gap = False
    for line in map(str.strip, _IMAGE.sub("", text or "").splitlines()):
        low = " ".join(line.lower().split())
        short, noise = len(line) <= 120, len(line) <= 90 and any(p in line.lower() for p in BOILERPLATE)
        if not line or noise or short and low in seen:
            gap |= not line
            continue
        if short:
            seen.add(low)
        out += ["", line] if gap and out else [line]
        gap = False
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def html_to_text(c: pd.Series) -> pd.Series:
    return c.map(text_of)


@F.pandas_udf(T.StringType())
def hero_markdown(c: pd.Series) -> pd.Series:
    return c.map(hero_of)


@F.pandas_udf(T.StringType())
def strip_boilerplate(c: pd.Series) -> pd.Series:
    return c.map(without_boilerplate)
