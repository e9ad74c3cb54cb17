"""Cards as word-processor files: one file per box, written with the standard library.

What is read back from such a file has the same tag, citation, body and layers.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.markup import layer_vectors

# Colours that a marker can have in such files, and the two presets.
COLOURS = {"green": "green", "yellow": "yellow", "blue": "blue", "turquoise": "cyan"}
PRESETS = ("house", "verbatim")
_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    '<Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
)
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/></Relationships>'
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _run(text: str, properties: str = "") -> str:
    lines = (f'<w:t xml:space="preserve">{escape(t)}</w:t>' for t in _FORBIDDEN.sub("", text).split("\n"))
    return f"<w:r><w:rPr>{properties}</w:rPr>{'<w:br/>'.join(lines)}</w:r>"


def _paragraph(runs: Iterable[str], style: str = "") -> str:
    named = f"<w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr>" if style else ""
    return f"<w:p>{named}{''.join(runs)}</w:p>"


def _body(body: str, markup: str | None, colour: str, preset: str) -> list[str]:
    """Paragraphs of a body, its layers as runs. White space goes with the word before it."""
    flags = layer_vectors(body, markup)
    out, runs, held, kind, at = [], [], "", (False, False), 0

    def flush() -> None:
        nonlocal held
        if held:
            mark, summary = kind
            look = f'<w:highlight w:val="{colour}"/>' if mark else ""
            look += '<w:u w:val="single"/>' if summary else '<w:sz w:val="16"/>' if preset == "house" and not mark else ""
            runs.append(_run(held, look))
            held = ""

    for m in re.finditer(r"\S+|\n|[^\S\n]+", body):
        if m.group() == "\n":
            flush()
            out.append(_paragraph(runs))
            runs = []
        elif m.group().isspace():
            held += m.group()
        else:
            if flags[at] != kind:
                flush()
                kind = flags[at]
            held += m.group()
            at += 1
    flush()
    return [*out, _paragraph(runs)]


def write_docx(cards: Iterable[dict], preset: str = "house", highlight: str = "green") -> bytes:
    """A .docx file of cards in the given order (tag, cite, fullcite, body_text, markup_html,
    pocket, hat, block). Headings are written where they differ from those above."""
    if preset not in PRESETS or highlight not in COLOURS:
        raise ValueError(f"preset is one of {PRESETS}, highlight one of {tuple(COLOURS)}")
    above: list[str | None] = [None, None, None]
    parts = []
    for card in cards:
        for level, name in enumerate(("pocket", "hat", "block")):
            text = card.get(name)
            if text and text != above[level]:
                parts.append(_paragraph([_run(text)], f"Heading{level + 1}"))
                above = [*above[:level], text, *[None] * (2 - level)]
        parts.append(_paragraph([_run(card.get("tag") or "")], "Heading4"))
        cited = " ".join(x for x in (card.get("cite"), card.get("fullcite")) if x)
        if cited:
            parts.append(_paragraph([_run(cited)]))
        if card.get("body_text"):
            parts += _body(card["body_text"], card.get("markup_html"), COLOURS[highlight], preset)
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 5))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in (
            ("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS.format("officeDocument", "word/document.xml")),
            ("word/_rels/document.xml.rels", _RELS.format("styles", "styles.xml")),
            ("word/document.xml", f'<w:document xmlns:w="{_NS}"><w:body>{"".join(parts)}</w:body></w:document>'),
            ("word/styles.xml", f'<w:styles xmlns:w="{_NS}">{styles}</w:styles>'),
        ):
            z.writestr(path, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def export_boxes(cards: DataFrame, box: str = "box_id", order: str = "place", preset: str = "house", highlight: str = "green") -> DataFrame:
    """(box, content): the file of every box. A box is one document, so its cards come
    together in one task by nature."""
    kind = cards.schema[box].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(order).astype(object).where(rows.sort_values(order).notna(), None)
        return pd.DataFrame({box: [key[0]], "content": [write_docx(ordered.to_dict("records"), preset, highlight)]})

    return cards.groupBy(box).applyInPandas(run, f"{box} {kind}, content binary")
