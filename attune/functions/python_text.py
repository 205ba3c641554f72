"""Text functions that need Python; Arrow-batched, never row by row through the JVM bridge."""

from __future__ import annotations

import ast
import html.parser
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(f: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return run


def _ascii(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


class _Visible(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def _visible(t: str) -> str:
    p = _Visible()
    p.feed(t)
    p.close()
    return " ".join(p.parts)


def _literal(t: str) -> list[str] | None:
    try:
        v = ast.literal_eval(t)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return [str(x) for x in v] if isinstance(v, (list, tuple)) else None


def _offsets(t: str) -> list[int]:
    import re

    return [m.start() for m in re.finditer(r"\b\w+(?:['-]\w+)*\b|[^\w\s]", t)]


def full_unaccent(c: Column) -> Column:
    """Every letter without combining marks, all scripts."""
    return _each(_ascii, "string")(c)


def parse_html(c: Column) -> Column:
    """Visible strings of HTML joined by a blank, by a real parser."""
    return _each(_visible, "string")(c)


def parse_literal(c: Column) -> Column:
    """A Python list or tuple written as text, as array of strings; null if it is none. Nothing is evaluated."""
    return _each(_literal, "array<string>")(c)


def token_offsets(c: Column) -> Column:
    """Start of every token of word_tokens."""
    return _each(_offsets, "array<int>")(c)


def unescape_codepoints(c: Column) -> Column:
    """``<U+XXXX>`` as its character; empty text as EMPTY; tabs, line ends and no-break blanks as blanks."""
    import re

    pattern = re.compile(r"<U\+([0-9A-Fa-f]{4,6})>")

    def fix(t: str) -> str:
        t = pattern.sub(lambda m: chr(min(int(m[1], 16), 0x10FFFF)), t)
        t = t.translate({9: " ", 10: " ", 160: " "})
        return t if t.strip() else "EMPTY"

    return _each(fix, "string")(c)


def escape_unicode(c: Column) -> Column:
    """Non-ASCII characters as backslash escapes."""
    return _each(lambda t: t.encode("ascii", "backslashreplace").decode(), "string")(c)
