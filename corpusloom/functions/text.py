"""Text functions as Column expressions (JVM side, inside code generation).

White space is the Unicode set, named here character by character: trimming and translating
by a list is several times faster than a Unicode regular expression, and Java's ``\\s`` would
be ASCII only.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

# All but a-z, 0-9 and the space, as ranges: Java matches the negated class with a single
# character in it about twenty times slower.
NOT_KEPT = r"[\x00-\x1f!-/:-`{-\x{10ffff}]+"
# Fixed value: what counts as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Version baked into every key, its prefixes, and words that names of authors are not.
KEY_VERSION = "1"
AUTHOR_JOINERS = ("and", "et", "al")

# Words without content, for the comparison of a tag with what is read aloud.
CONTENT_STOPWORDS = tuple(
    """
a an the and or but if then than that this these those there here of in on
at to for from by with without as is are was were be been being am it its
not no nor so too very can will just do does did done has have had having
may might must shall should would could about into over under between
across after before during through more most less least own same other
some such only both each few all any when where which who whom why how
what while because until again once out off up down we they you he she i
""".split()
)

# Words that resolutions share whatever they are about.
TOPIC_STOPWORDS = tuple(
    """
resolved the and for its that with should ought
united states state federal government governments
their more than from into over all are not
has have had would will being been when was
were this these those one two out our can
could may might must shall benefits harms outweigh
balance substantially increase decrease reduce between
against about without within
""".split()
)

# How sides are written.
PRO_WORDS = ("P", "PRO", "A", "AFF", "AFFIRMATIVE", "1")
CON_WORDS = ("C", "CON", "N", "NEG", "NEGATIVE", "2")

# Units of sizes, the largest first.
BYTE_UNITS = ((1024**4, "TB"), (1024**3, "GB"), (1024**2, "MB"), (1024, "KB"))

# The shapes of addresses and dates in full citations, and how far a date may lie from the front.
URL_SHAPE, URL_TAIL = r"https?://[^\s\"'<>\)\]]+", r"[.,;:!?'’”]+$"
DOCUMENT_URL_SHAPE, DOCUMENT_URL_TAIL = r"(?i)https?://[^\s<>\"'\)\]]+", r"[.,;:!?]+$"
MONTH_DAY_YEAR = r"\b(\d{1,2})-(\d{1,2})-(\d{4})\b"
NAMED_MONTH = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})\b"
FULL_YEAR = r"\b(19\d{2}|20\d{2})\b"
DATE_ZONE = 200

# Numbering and prefixes of answer blocks.
NUMBERING = r"(?i)^\s*(?:\(?\d+[\).]|\(?[a-z][\).]|[ivx]+[\).])\s+"
ANSWER_PREFIX = r"(?i)^\s*(?:(?:a2|at|a/2|a-2)\s*[:\-–—]?\s+|(?:a2|at)[:\-–—]\s*)"


@pandas_udf(StringType())
def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility form. Only values beyond ASCII reach Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def spaced(text: Column) -> Column:
    """All white space as plain spaces, one for one."""
    return F.translate(text, WHITE, " " * len(WHITE))


def normalize(text: Column, compatible: bool = True) -> Column:
    """Lower-case words of a-z and 0-9 with single spaces; null as empty. With
    ``compatible`` false the compatibility form is taken as done already."""
    text = F.coalesce(text, F.lit(""))
    text = F.lower(nfkc(text) if compatible else text)
    text = F.regexp_replace(spaced(text), NOT_KEPT, "")
    return F.trim(F.regexp_replace(text, "  +", " "))


def canonical_key(norm: Column, analytic: Column) -> Column:
    """Key of a normalised body, or of a normalised tag where ``analytic``."""
    head = F.when(analytic, F.lit(f"{KEY_VERSION}:analytic:")).otherwise(F.lit(f"{KEY_VERSION}:"))
    return F.sha2(F.concat(head, norm), 256)


def blank_to_null(text: Column) -> Column:
    """Without white space around; null if nothing is left."""
    return F.nullif(F.btrim(text, F.lit(WHITE)), F.lit(""))


def has_text(text: Column) -> Column:
    """Whether there is anything but white space; null counts as no."""
    return F.coalesce(F.btrim(text, F.lit(WHITE)) != "", F.lit(False))


def word_list(text: Column) -> Column:
    """Parts between white space; null and blank as an empty list."""
    return F.filter(F.split(spaced(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def words_spoken(text: Column) -> Column:
    return F.size(word_list(text))


def last_item(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


#: ``cite_year_search`` over a column named cite, for users who write SQL.
CITE_YEAR_SQL = r"right(concat('0', try_element_at(filter(regexp_extract_all(coalesce(cite, ''), '(?U)(\\d+)'), d -> length(d) IN (1, 2, 4)), -1)), 2)"


def cite_year_search(cite: Column) -> Column:
    """Two digits of the last number of 1, 2 or 4 digits; numbers of other lengths are passed over."""
    runs = F.filter(F.regexp_extract_all(F.coalesce(cite, F.lit("")), F.lit(r"(?U)(\d+)")), lambda d: F.length(d).isin(1, 2, 4))
    return F.right(F.concat(F.lit("0"), last_item(runs)), F.lit(2))


def cite_year_strict(cite: Column) -> Column:
    """As a number of its own (an apostrophe may precede it) of two digits, or of four that
    begin with 19 or 20; never a single digit."""
    found = F.regexp_extract_all(F.coalesce(cite, F.lit("")), F.lit(r"(?<![0-9A-Za-z])['’]?([0-9]{4}|[0-9]{2})(?![0-9A-Za-z])"))
    good = F.filter(found, lambda d: (F.length(d) == 2) | F.substring(d, 1, 2).isin("19", "20"))
    return F.right(last_item(good), F.lit(2))


def author_tokens(cite: Column, compatible: bool = True) -> Column:
    """Words of the authors' names in a short citation."""
    tokens = F.array_distinct(word_list(normalize(cite, compatible)))
    return F.filter(tokens, lambda w: ~w.isin(*AUTHOR_JOINERS) & ~w.rlike("^[0-9]+$"))


def cites_compatible(year_a: Column, authors_a: Column, year_b: Column, authors_b: Column) -> Column:
    """Years known and equal, and an author in common."""
    return F.coalesce(year_a == year_b, F.lit(False)) & F.arrays_overlap(authors_a, authors_b)


def _unnumbered(block: Column) -> Column:
    return F.regexp_replace(block, NUMBERING, "")


def answer_target(block: Column, compatible: bool = True) -> Column:
    """Normalised argument that an answer block answers; null if it is none."""
    text = _unnumbered(block)
    rest = normalize(F.regexp_replace(text, ANSWER_PREFIX, ""), compatible)
    return F.when(text.rlike(ANSWER_PREFIX), F.nullif(rest, F.lit("")))


def answer_display(block: Column) -> Column:
    """Title without numbering and answer prefix, its writing kept; null as empty."""
    text = F.regexp_replace(_unnumbered(F.coalesce(block, F.lit(""))), ANSWER_PREFIX, "")
    return F.coalesce(blank_to_null(text), F.lit(""))


def argument_key(block: Column, compatible: bool = True) -> Column:
    """Normalised title of any block, prefix or not; null if nothing is left."""
    return F.nullif(normalize(F.regexp_replace(_unnumbered(block), ANSWER_PREFIX, ""), compatible), F.lit(""))


def first_url(cite: Column) -> Column:
    """First web address in a citation, closing punctuation cut off."""
    return F.nullif(F.regexp_replace(F.regexp_extract(cite, URL_SHAPE, 0), URL_TAIL, ""), F.lit(""))


def first_url_document(cite: Column) -> Column:
    """The document reader's variant: any case, quotes do not close the address."""
    return F.nullif(F.regexp_replace(F.regexp_extract(cite, DOCUMENT_URL_SHAPE, 0), DOCUMENT_URL_TAIL, ""), F.lit(""))


def _month_number(name: Column) -> Column:
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    full = "january february march april may june july august september october november december".split()
    out = F.lit(None).cast("int")
    for k, (short, long) in enumerate(zip(months, full, strict=True), 1):
        also = [short, long, "sept"] if short == "sep" else [short, long]
        out = F.when(F.lower(name).isin(*also), F.lit(k)).otherwise(out)
    return out


def _iso(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a date that exists, else null."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"))


def pub_date_by_shape(cite: Column) -> Column:
    """Publication date in the first 200 characters before an address: the first M-D-YYYY,
    else the first ``Month D, YYYY``, else the first year of 19xx or 20xx. A date that does
    not exist falls through to the next shape."""
    front = F.substring(F.split(cite, "http", 2)[0], 1, DATE_ZONE)
    part = lambda pattern, k: F.regexp_extract(front, pattern, k)
    number = lambda pattern, k: part(pattern, k).try_cast("int")
    return F.coalesce(
        _iso(number(MONTH_DAY_YEAR, 3), number(MONTH_DAY_YEAR, 1), number(MONTH_DAY_YEAR, 2)),
        _iso(number(NAMED_MONTH, 3), _month_number(part(NAMED_MONTH, 1)), number(NAMED_MONTH, 2)),
        F.nullif(part(FULL_YEAR, 1), F.lit("")),
    )


def date_floor(date: Column) -> Column:
    """First day that a possibly partial ISO date can mean."""
    return F.when(F.length(date) == 4, F.concat(date, F.lit("-01-01"))).when(F.length(date) == 7, F.concat(date, F.lit("-01"))).otherwise(date)


def date_ceiling(date: Column) -> Column:
    """Last day that a possibly partial ISO date can mean (as text, months of 31 days)."""
    return F.when(F.length(date) == 4, F.concat(date, F.lit("-12-31"))).when(F.length(date) == 7, F.concat(date, F.lit("-31"))).otherwise(date)


def month_of(date: Column) -> Column:
    return F.substring(date, 1, 7)


def domain(url: Column) -> Column:
    """Authority of an address (port and user kept), lower case, without ``www.``; null if none."""
    authority = F.try_parse_url(F.trim(url), F.lit("AUTHORITY"))
    return F.nullif(F.regexp_replace(F.lower(authority), r"^www\.", ""), F.lit(""))


def hostname(url: Column) -> Column:
    """Host of an address (no port, no user), lower case, without ``www.``; null if none."""
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def topic_tokens(text: Column) -> Column:
    """Distinct words of three letters or more that may tell a topic, plural s folded."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*TOPIC_STOPWORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.regexp_replace(w, "(?<=...)s$", "")))


def content_words(text: Column) -> Column:
    """Distinct words with content, of three characters or more."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9']+)"))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*CONTENT_STOPWORDS)))


# The shapes of short citations at the start of a paragraph.
SHORT_CITES = (
    r"(?U)^\s*(?:[A-Z][\w'’.-]+(?:,? (?:and|&) [A-Z][\w'’.-]+)?|[A-Z][\w'’.-]+ et al\.?),? ['’]?\d{2}(?:\d{2})?\b",
    r"(?U)^\s*[A-Z][\w'’.-]+(?:,\s*[A-Z][\w'’.-]+)+(?:,?\s*(?:and|&)\s*[A-Z][\w'’.-]+)?,?\s+['’]?\d{2}(?:\d{2})?\b",
)


def short_cite(text: Column) -> Column:
    """The short citation that a paragraph begins with, null if none."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in SHORT_CITES))


# The longest full citation in words, what an address, a year and a mark of access look like.
FULLCITE_WORDS = 80
FULLCITE_SIGNS = (r"(?i)https?://[^\s<>\"')\]]", r"(?U)\b(?:19|20)\d{2}\b", r"(?i)\b(?:accessed|access date|date of access|retrieved)\b", r"\bDOA\b")


def strong_fullcite(text: Column, most_words: int = FULLCITE_WORDS) -> Column:
    """Whether a paragraph of at most ``most_words`` words carries an address, a year of
    19xx or 20xx or a mark of access."""
    signal = F.lit(False)
    for sign in FULLCITE_SIGNS:
        signal = signal | text.rlike(sign)
    return F.coalesce(signal & (words_spoken(text) <= most_words), F.lit(False))


def side(text: Column) -> Column:
    """P or C, null for anything else."""
    word = F.upper(F.trim(text))
    return F.when(word.isin(*PRO_WORDS), F.lit("P")).when(word.isin(*CON_WORDS), F.lit("C"))


def side_label(value: Column) -> Column:
    return F.when(value == "P", F.lit("Pro")).when(value == "C", F.lit("Con")).otherwise(value)


# Names of the slots of a season.
SLOT_LABELS = {
    "SO": "Sept/Oct", "ND": "Nov/Dec", "JAN": "January", "FEB": "February", "MA": "March", "APR": "April",
    "SEP": "September", "OCT": "October", "NOV": "November", "DEC": "December", "NATS": "Nationals",
}


def slot_label(slot: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SLOT_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, slot), slot)


def season_label(season: Column) -> Column:
    """2021 as 2021-22."""
    return F.format_string("%d-%02d", season.cast("int"), F.pmod(season.cast("int") + 1, F.lit(100)))


def read_time(n_words: Column, per_minute: int = 250) -> Column:
    """m:ss at a pace; half seconds to even."""
    if per_minute <= 0:
        raise ValueError("per_minute must be positive")
    seconds = F.bround(n_words * F.lit(60.0) / F.lit(float(per_minute)), 0).cast("int")
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(seconds, F.lit(60)).cast("string"), 2, "0"))


def first_words(text: Column, n: int = 24) -> Column:
    """Beginning of a text for a listing, an ellipsis after it if more follows."""
    words = word_list(text)
    return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, F.lit("…")).otherwise(F.lit("")))


def visible_text(markup: Column) -> Column:
    """Text of markup: tags as spaces, the common entities resolved, trimmed."""
    text = F.regexp_replace(F.coalesce(markup, F.lit("")), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0*39;|&#x27;|&apos;", "'"), ("&amp;", "&")):
        text = F.regexp_replace(text, entity, char)
    return F.coalesce(blank_to_null(text), F.lit(""))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


@arrow_udf(StringType())
def _human_bytes(*factors: pa.Array) -> pa.Array:
    def shown(n: int) -> str:
        for least, unit in BYTE_UNITS:
            if n >= least:
                return f"{n / least:.1f} {unit}"
        return f"{n} B"

    return pa.array([None if None in row else shown(math.prod(row)) for row in zip(*(f.to_pylist() for f in factors), strict=True)], pa.string())


def human_bytes(n: Column, *factors: Column) -> Column:
    """Size with one decimal in the largest unit that leaves one before the point, of ``n`` times the ``factors``.

    In Python: no product of integers is too long for it, and it prints all digits of a double as printf does."""
    return _human_bytes(n, *factors)
