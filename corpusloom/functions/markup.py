"""Markup: a sanitiser, visible text, and the layers that readers marked."""

from __future__ import annotations

import difflib
import html
import re
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Tags that may stay, of them those without content; tags of the layers.
ALLOWED = frozenset({"h1", "h2", "h3", "h4", "p", "u", "strong", "em", "mark", "span", "br"})
EMPTY = frozenset({"br"})
MARKED, SUMMARY = frozenset({"mark"}), frozenset({"u", "strong"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4"})
BREAKS = HEADINGS | {"p", "br"}
_TAG = re.compile(r"<[^>]*>")


def visible(markup: str) -> str:
    """Text of markup: tags as spaces, all entities resolved, trimmed."""
    return html.unescape(_TAG.sub(" ", markup)).strip() if markup else ""


class _Cleaner(HTMLParser):
    """Events of the parser written out again, what is not allowed left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.path: list[str] = []

    def close_to(self, depth: int) -> None:
        self.parts += [f"</{name}>" for name in reversed(self.path[depth:])]
        del self.path[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in ALLOWED:
            names = dict(reversed(attrs))
            shown = f' class="{html.escape(names["class"])}"' if names.get("class") and tag not in EMPTY else ""
            self.parts.append(f"<{tag}{shown}>")
            if tag not in EMPTY:
                self.path.append(tag)

    def handle_endtag(self, tag):
        if tag in self.path:
            self.close_to(len(self.path) - 1 - self.path[::-1].index(tag))

    def handle_data(self, data):
        self.parts.append(html.escape(data))


def sanitize(markup: str | None) -> str:
    """Well-formed markup of allowed tags with nothing but their class; text always stays."""
    cleaner = _Cleaner()
    cleaner.feed(markup or "")
    cleaner.close()
    cleaner.close_to(0)
    return "".join(cleaner.parts)


@pandas_udf(StringType())
def sanitize_markup(markup: pd.Series) -> pd.Series:
    return markup.map(sanitize)


class _Layers(HTMLParser):
    """Characters of the text outside headings, each with the layers open around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = {"mark": 0, "summary": 0, "heading": 0}
        self.runs: list[tuple[str, bool, bool]] = []

    def _step(self, tag: str, by: int) -> None:
        for name, tags in (("mark", MARKED), ("summary", SUMMARY), ("heading", HEADINGS)):
            if tag in tags:
                self.open[name] = max(0, self.open[name] + by)
        if tag in BREAKS:
            self.runs.append((" ", False, False))

    def handle_starttag(self, tag, attrs):
        self._step(tag, 1)

    def handle_endtag(self, tag):
        self._step(tag, -1)

    def handle_data(self, data):
        if not self.open["heading"]:
            self.runs.append((data, self.open["mark"] > 0, self.open["summary"] > 0))


def layered_tokens(markup: str | None) -> list[tuple[str, bool, bool]]:
    """(token, marked, summarised) of the text; a token belongs to a layer if any of its
    characters does."""
    reader = _Layers()
    reader.feed(markup or "")
    reader.close()
    text = "".join(t for t, _, _ in reader.runs)
    flags = [(m, s) for t, m, s in reader.runs for _ in t]
    out = []
    for m in re.finditer(r"\S+", text):
        own = flags[m.start() : m.end()]
        out.append((m.group(), any(f[0] for f in own), any(f[1] for f in own)))
    return out


def project(body: Sequence[str], tokens: Sequence[tuple[str, bool, bool]]) -> list[tuple[bool, bool]]:
    """Layers of each body token, from the aligned tokens of a variant; others have none."""
    words = [t for t, _, _ in tokens]
    if words == list(body):
        return [(m, s) for _, m, s in tokens]
    out = [(False, False)] * len(body)
    for a, b, n in difflib.SequenceMatcher(a=list(body), b=words, autojunk=False).get_matching_blocks():
        out[a : a + n] = [(m, s) for _, m, s in tokens[b : b + n]]
    return out


def layer_vectors(body: str | None, markup: str | None) -> list[tuple[bool, bool]]:
    return project((body or "").split(), layered_tokens(markup))
