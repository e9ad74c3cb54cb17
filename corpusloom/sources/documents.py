"""Cards from word-processor and portable documents.

A .docx file is a zip of XML and is read with the standard library: paragraphs become runs
of text with their effective formatting (run, then character style, then paragraph style).
Text of a .pdf needs a library, if one is there; cards are then found in its lines.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from xml.etree import ElementTree

from ..functions.markup import sanitize
from . import citations as C

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# How the kinds of runs are written as markup, and which count as summary.
WRAP = {
    "mark": ("<mark>", "</mark>"), "strong_u": ("<strong><u>", "</u></strong>"), "u": ("<u>", "</u>"),
    "strong": ("<strong>", "</strong>"), "min": ('<span class="min">', "</span>"), "plain": ("", ""),
}
SUMMARY = ("mark", "strong_u", "u", "strong")
FIELDS = ("tag", "cite", "fullcite", "body_text", "is_analytic", "source_url", "source_pub_date", "pocket", "hat", "block", "markup_html", "summary", "spoken", "highlight_ratio", "fidelity", "ordinal")
CARD_DDL = (
    "tag string, cite string, fullcite string, body_text string, is_analytic boolean, source_url string, source_pub_date string, "
    "pocket string, hat string, block string, markup_html string, summary string, spoken string, highlight_ratio double, fidelity string, ordinal bigint"
)


@dataclass
class Run:
    text: str
    kind: str
    bold: bool
    points: float | None


@dataclass
class Paragraph:
    runs: list[Run]
    level: int | None = None
    table: int | None = None

    @cached_property
    def text(self) -> str:
        return "".join(r.text for r in self.runs).strip()

    def pieces(self) -> Iterator[tuple[str, str]]:
        """(kind, text), neighbours of one kind joined."""
        kind, held = None, ""
        for run in self.runs:
            if run.kind != kind and held:
                yield kind, held
                held = ""
            kind, held = run.kind, held + run.text
        if held:
            yield kind, held

    def markup(self) -> str:
        return "".join(WRAP[k][0] + html.escape(t).replace("\n", "<br>") + WRAP[k][1] for k, t in self.pieces())

    def layer(self, kinds: tuple[str, ...]) -> list[str]:
        return [C.squash(t) for k, t in self.pieces() if k in kinds and t.strip()]

    def shaped_as_tag(self) -> bool:
        """Short, nearly all of it bold and large, and no citation."""
        whole = sum(len(r.text) for r in self.runs)
        large = sum(len(r.text) for r in self.runs if r.bold and (r.points or 0) >= C.TAG_POINTS)
        return 0 < C.count_words(self.text) < C.TAG_WORDS and not C.short_cite(self.text) and large >= C.TAG_BOLD_SHARE * whole > 0


class WordDocument:
    """Paragraphs of a .docx file in order."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as parts:
            self.body = ElementTree.fromstring(parts.read("word/document.xml")).find(f"{_W}body")
            names = parts.namelist()
            styles = ElementTree.fromstring(parts.read("word/styles.xml")) if "word/styles.xml" in names else None
        self.styles = {s.get(f"{_W}styleId"): s for s in styles.iter(f"{_W}style")} if styles is not None else {}

    def _chain(self, style: str | None) -> Iterator[ElementTree.Element]:
        seen: set[str] = set()
        while style in self.styles and style not in seen:
            seen.add(style)
            yield self.styles[style]
            base = self.styles[style].find(f"{_W}basedOn")
            style = base.get(f"{_W}val") if base is not None else None

    def _property(self, name: str, run: ElementTree.Element, paragraph_style: str | None) -> str | None:
        """Value of a run property where it is first given: run, character style, paragraph style."""
        own = run.find(f"{_W}rPr")
        named = own.find(f"{_W}rStyle") if own is not None else None
        places = [own]
        for style in (named.get(f"{_W}val") if named is not None else None, paragraph_style):
            places += [s.find(f"{_W}rPr") for s in self._chain(style)]
        for place in places:
            if place is not None and (found := place.find(f"{_W}{name}")) is not None:
                return found.get(f"{_W}val", "true")
        return None

    def _run(self, run: ElementTree.Element, style: str | None) -> Run:
        text = "".join(
            (e.text or "") if e.tag == f"{_W}t" else "\t" if e.tag == f"{_W}tab" else "\n" if e.tag in (f"{_W}br", f"{_W}cr") else ""
            for e in run
        )
        on = lambda v: v is not None and v.lower() not in ("none", "false", "0", "off", "auto")
        bold, under, marked = (on(self._property(n, run, style)) for n in ("b", "u", "highlight"))
        half = self._property("sz", run, style)
        points = float(half) / 2 if half and half.replace(".", "", 1).isdigit() else None
        small = points is not None and points <= C.SMALL_POINTS
        kind = "mark" if marked else {(True, True): "strong_u", (False, True): "u", (True, False): "strong"}.get((bold, under), "min" if small else "plain")
        return Run(text, kind, bold, points)

    def _paragraph(self, p: ElementTree.Element, table: int | None) -> Paragraph:
        named = p.find(f"{_W}pPr/{_W}pStyle")
        style = named.get(f"{_W}val") if named is not None else None
        title = self.styles[style].find(f"{_W}name") if style in self.styles else None
        level = None
        for name in (title.get(f"{_W}val") if title is not None else None, style):
            if level is None and (m := re.match(r"(?i)\s*heading\s*(\d+)", name or "")):
                level = int(m[1])
        runs = [self._run(r, style) for r in p.iter(f"{_W}r")]
        return Paragraph([r for r in runs if r.text], None if table is not None else level, table)

    def paragraphs(self) -> list[Paragraph]:
        out = []
        for k, child in enumerate(self.body):
            if child.tag == f"{_W}p":
                out.append(self._paragraph(child, None))
            elif child.tag == f"{_W}tbl":
                out += [self._paragraph(p, k) for p in child.iter(f"{_W}p")]
        return out


@dataclass
class Draft:
    """A card while its paragraphs are gathered."""

    tag: str
    place: dict[str, str | None]
    members: list[Paragraph] = field(default_factory=list)

    def card(self, ordinal: int, fidelity: str) -> dict | None:
        """The finished card; None if it has neither tag nor citation."""
        shown = [p for p in self.members if p.text]
        cite, full, taken = C.divide([(p.text, p.table is not None) for p in shown])
        rest = shown[taken:]
        body = "\n".join(p.text for p in rest)
        tag = C.squash(self.tag)
        if not taken and not tag:
            return None
        analytic = not body if taken else C.count_words(body) < C.EVIDENCE_WORDS
        spoken = " ".join(t for p in rest for t in p.layer(("mark",)))
        heading = f"<h4>{html.escape(tag)}</h4>" if tag else ""
        return {
            "tag": tag or None, "cite": cite, "fullcite": full, "body_text": body, "is_analytic": analytic,
            "source_url": C.address(full), "source_pub_date": C.publication_date(full), **self.place,
            "markup_html": sanitize(heading + "".join(f"<p>{p.markup()}</p>" for p in shown)),
            "summary": " ".join(t for p in rest for t in p.layer(SUMMARY)), "spoken": spoken,
            "highlight_ratio": min(1.0, len(spoken) / len(body)) if body else 0.0, "fidelity": fidelity, "ordinal": ordinal,
        }


def _drafts(paragraphs: list[Paragraph], tags: set[int]) -> tuple[list[Draft], int]:
    """Cards under headings of level 4 and under the paragraphs numbered in ``tags``, and how
    many words belong to no card."""
    levels = ("pocket", "hat", "block")
    place: dict[str, str | None] = dict.fromkeys(levels)
    drafts: list[Draft] = []
    current, loose = None, 0
    for k, p in enumerate(paragraphs):
        if p.level is not None:
            current = None
            if p.level <= 3:
                place = {n: place[n] if i < p.level - 1 else C.squash(p.text) or None if i == p.level - 1 else None for i, n in enumerate(levels)}
        if p.level == 4 or k in tags:
            current = Draft(p.text, dict(place))
            drafts.append(current)
        elif p.level is None and current is not None:
            current.members.append(p)
        elif p.level is None:
            loose += C.count_words(p.text)
    return drafts, loose


def _tags_by_format(paragraphs: list[Paragraph]) -> set[int]:
    """Paragraphs shaped as a tag with a short citation within the next two of their section."""
    out = set()
    for k, p in enumerate(paragraphs):
        if p.level is None and p.table is None and p.shaped_as_tag():
            section = []
            for q in paragraphs[k + 1 :]:
                if q.level is not None or len(section) == 2:
                    break
                if q.text and q.table is None:
                    section.append(q.text)
            if any(C.short_cite(t) for t in section):
                out.add(k)
    return out


def _finish(drafts: list[Draft], fidelity: str) -> list[dict]:
    cards = [d.card(k, fidelity) for k, d in enumerate(drafts)]
    return [c | {"ordinal": k} for k, c in enumerate(c for c in cards if c)]


def docx_cards(content: bytes, fidelity: str = "opensource") -> list[dict]:
    """Cards of a .docx file. Headings are followed; where they give no card, or leave more
    than six tenths of a hundred words or more out, formatting is tried, and kept if it
    gives more cards."""
    paragraphs = WordDocument(content).paragraphs()
    drafts, loose = _drafts(paragraphs, set())
    cards = _finish(drafts, fidelity)
    words = sum(C.count_words(p.text) for p in paragraphs if p.level is None)
    if words and (not cards or (words >= 100 and loose > 0.6 * words)):
        other = _finish(_drafts(paragraphs, _tags_by_format(paragraphs))[0], fidelity)
        cards = other if len(other) > len(cards) else cards
    return cards


# Fixed value: lines that are page numbers.
_FURNITURE = re.compile(r"(?i)(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?")


def line_cards(text: str, fidelity: str = "pdf") -> list[dict]:
    """Cards in lines of plain text: a citation of one line and up to three that continue
    it, before it a tag of up to three lines, after it the body up to the next tag."""
    lines = [x for raw in text.split("\n") if (x := C.squash(raw)) and not _FURNITURE.fullmatch(x)]
    if not lines:
        return []
    blocks: list[tuple[int, int]] = []
    k = 0
    while k < len(lines):
        if C.short_cite(lines[k]) or C.cite_line(lines[k]):
            end = k + 1
            while end < min(len(lines), k + 4) and C.cite_line(lines[end]):
                end += 1
            blocks.append((k, end))
            k = end
        else:
            k += 1
    parts: list[tuple[str | None, list[str], list[str]]] = []
    if not blocks:
        lead = C.count_words(lines[0]) <= C.TAG_WORDS
        parts.append((lines[0] if lead else None, [], lines[lead:]))
    starts = [_tag_start(lines, end, begin) for end, (begin, _) in zip([0, *(e for _, e in blocks)], blocks, strict=False)]
    for n, (begin, end) in enumerate(blocks):
        upto = starts[n + 1] if n + 1 < len(blocks) else len(lines)
        parts.append((C.squash(" ".join(lines[starts[n] : begin])) or None, lines[begin:end], lines[end:upto]))
    cards = []
    for tag, cited, body_lines in parts:
        body = "\n".join(body_lines)
        hit = C.short_cite(cited[0]) if cited else None
        full = C.squash(" ".join([hit[1], *cited[1:]] if hit else cited)) or None
        if not cited and not tag:
            continue
        analytic = not body if cited else C.count_words(body) < C.EVIDENCE_WORDS
        cards.append(dict.fromkeys(FIELDS) | {
            "tag": tag, "cite": hit[0] if hit else None, "fullcite": full, "body_text": body, "is_analytic": analytic,
            "source_url": C.address(full), "source_pub_date": C.publication_date(full), "fidelity": fidelity, "ordinal": len(cards),
        })
    return cards


def _tag_start(lines: list[str], low: int, high: int) -> int:
    """Where the tag begins that ends before line ``high``: its last line, and lines above it
    that end without punctuation, three in all and of a tag's length."""
    if high <= low or C.count_words(lines[high - 1]) > C.TAG_WORDS:
        return high
    start = high - 1
    while start > low and high - start < 3:
        above = lines[start - 1].rstrip("\"'’”)»′")
        if not above or above[-1] in ".!?,;:" or C.count_words(" ".join([above, *lines[start:high]])) > C.TAG_WORDS:
            break
        start -= 1
    return start


def pdf_text(content: bytes) -> str:
    """Text of a .pdf file, by whichever library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading .pdf files needs pypdf") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def cards_of_file(path: str, content: bytes, fidelity: str | None = None) -> tuple[str, str | None, list[dict]]:
    """(status, error, cards) of a file by its ending. Failures are data: a file that cannot
    be read has the status ``failed`` and a reason, and the batch goes on."""
    try:
        if path.lower().endswith(".docx"):
            return "parsed", None, docx_cards(content, fidelity or "opensource")
        if path.lower().endswith(".pdf"):
            return "parsed", None, line_cards(pdf_text(content), fidelity or "pdf")
        if path.lower().endswith(".txt"):
            return "parsed", None, line_cards(content.decode("utf-8", errors="replace"), fidelity or "pdf")
        return "skipped", "no reader for this kind of file", []
    except Exception as e:  # noqa: BLE001
        return "failed", f"{type(e).__name__}: {e}"[:300], []
