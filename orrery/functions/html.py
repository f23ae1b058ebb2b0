"""Visible text of HTML pages and decoding with a fallback, as Arrow UDFs."""

from __future__ import annotations

import codecs
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: elements that break lines, that hide their content, and that separate cells
BREAKING = frozenset(["br", "hr", "p", "div", "tr", "li", "pre", "table", "h1", "h2", "h3", "h4"])
HIDING = frozenset(["script", "style", "noscript", "template"])
CELLS = frozenset(["td", "th"])
GAPS = dict.fromkeys(BREAKING, "\n") | dict.fromkeys(CELLS, " ")


def page_events(page: str) -> list[tuple[int, str]]:
    """What a page holds, in order: (1, tag) opened, (-1, tag) closed, (0, text)."""
    events: list[tuple[int, str]] = []
    parser = HTMLParser()
    parser.handle_starttag = lambda tag, attrs: events.append((1, tag))
    parser.handle_endtag = lambda tag: events.append((-1, tag))
    parser.handle_data = lambda data: events.append((0, data))
    parser.feed(page)
    parser.close()
    return events


def in_bodies(events: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The events from each opened body to its end, or to the page's."""
    turns = (step if what == "body" else 0 for step, what in events)
    return [e for e, state in zip(events, accumulate(turns, lambda state, turn: turn or state)) if state == 1]


def body_text(page: str) -> str:
    """Lines of the body's visible text, white space collapsed, blank lines dropped, each ended by a newline."""
    events = in_bodies(page_events(page))
    cover = accumulate((step if what in HIDING else 0 for step, what in events), lambda depth, step: max(depth + step, 0))
    shown = "".join((what if step == 0 else GAPS.get(what, "")) for (step, what), hidden in zip(events, cover) if not hidden)
    return "\n".join(filter(None, (" ".join(line.split()) for line in shown.splitlines()))) + "\n"


@F.pandas_udf(T.StringType())
def visible_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: None if p is None else body_text(p))


def charsets(declared: str) -> list[str]:
    """The declared encoding, and what stands in for it where that is UTF-8 but the bytes aren't."""
    return [declared, "windows-1252"] if codecs.lookup(declared).name == "utf-8" else [declared]


def decode_bytes(raw: bytes, declared: str) -> tuple[str, str]:
    """(text, encoding) by the first of charsets() that fits every byte; none is an error."""
    *first, last = charsets(declared)
    for name in first:
        try:
            return str(raw, name), name
        except UnicodeDecodeError:
            continue
    return str(raw, last), last


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("encoding", T.StringType()))
def decoded(raw: pd.Series, declared: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if r is None else decode_bytes(bytes(r), d or "utf-8") for r, d in zip(raw, declared)]
    return pd.DataFrame(rows, columns=["text", "encoding"])
