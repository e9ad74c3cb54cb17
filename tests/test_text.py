"""Text functions on tables of cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import markup as M, text as X
from corpusloom.sources import citations as C


def _map(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(fn(F.col("v"))).collect()]


def test_normalize(spark):
    cases = {
        "Grid  “Reliability” – it's": "grid reliability its", None: "", "": "", "ﬁnal ＴＥＳＴ": "final test",
        "a b\x1cc​d": "a b cd", "naïve CAFÉ": "nave caf", "tab\tline\n2": "tab line 2", "½ x": "12 x",
    }
    assert _map(spark, X.normalize, list(cases)) == list(cases.values())


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (X.cite_year_search, {"Diamond '13": "13", "Rodgers and Cooper 06": "06", "Kessler 2026": "26", "X 7": "07", "X 12345": None, "None": None, None: None, "A 123 b 45": "45"}),
        (X.cite_year_strict, {"Diamond '13": "13", "Diamond ’13": "13", "Kessler 2026": "26", "X 7": None, "X 1850": None, "a13": None, "Smith et al. 24": "24", None: None}),
        (X.answer_target, {"A2: Moratorium": "moratorium", "AT: X-Y": "xy", "1. A/2 - The Grid": "the grid", "at:tight": "tight", "Attack": None, "A2:": None, None: None, "Economy": None}),
        (X.argument_key, {"A2: Moratorium": "moratorium", "The Grid!": "the grid", "(b) Solvency": "solvency", None: None, "": None}),
        (X.answer_display, {"2) A2: The Grid!": "The Grid!", None: "", "Plain": "Plain"}),
        (X.first_url, {"see https://a.example/x?y=1).": "https://a.example/x?y=1", "none": None, None: None, "http://b.example/;": "http://b.example/"}),
        (X.pub_date_by_shape, {"A, 5-23-2018, http://x.example/1-1-2001": "2018-05-23", "13-45-2019 then May 3, 2014": "2014-05-03", "Feb 31, 2015": "2015", "c. 2011": "2011", "none": None, None: None}),
        (X.side, {"aff": "P", " NEG ": "C", "1": "P", "x": None, None: None}),
        (X.hostname, {"https://u:p@WWW.a.example:80/x": "a.example", "bad url": None, None: None}),
        (X.first_words, {" ".join(map(str, range(30))): " ".join(map(str, range(24))) + "…", "a b": "a b", None: ""}),
        (X.visible_text, {"<p>a&amp;b</p><b>c</b>": "a&b  c", None: "", "<p>&nbsp;</p>": ""}),
    ],
)
def test_functions(spark, fn, cases):
    assert _map(spark, fn, list(cases)) == list(cases.values())


def test_lists(spark):
    assert [sorted(x) for x in _map(spark, X.author_tokens, ["Rodgers and Cooper 06", None, "Smith et al. 24"])] == [["cooper", "rodgers"], [], ["smith"]]
    assert [sorted(x) for x in _map(spark, X.topic_tokens, ["Resolved: The grids should reduce gas", None])] == [["gas", "grid"], []]
    assert _map(spark, X.read_time, [0, 250, 125, 1], "int") == ["0:00", "1:00", "0:30", "0:00"]


def test_human_bytes(spark):
    # 4503654602951885 and 4504644163416883 lie just beside 4096.05 and 4096.95 TB: no ties, though the shortest form of the quotient looks like one
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1792: "1.8 KB", 1024**2 - 1: "1024.0 KB", 5 * 1024**3: "5.0 GB", 4503654602951885: "4096.1 TB", 4504644163416883: "4096.9 TB", 2**63 - 1: "8388608.0 TB", -5000: "-5000 B", None: None}
    assert _map(spark, X.human_bytes, list(cases), "bigint") == list(cases.values())


def test_sanitize():
    assert M.sanitize("<u><strong><mark>x</u></strong></mark>") == "<u><strong><mark>x</mark></strong></u>"
    assert M.sanitize('<p onclick="x" class="a&quot;b">t<script>alert(1)</script></p>') == '<p class="a&quot;b">talert(1)</p>'
    assert M.sanitize("<mark>open") == "<mark>open</mark>"
    assert M.sanitize("a < b & c<br/>") == "a &lt; b &amp; c<br>"
    assert M.sanitize(None) == ""


def test_layers():
    tokens = M.layered_tokens("<h4>Tag</h4><p>one t<mark>w</mark>o</p><p><u>three</u></p>")
    assert tokens == [("one", False, False), ("two", True, False), ("three", False, True)]
    assert M.project(["zero", "two", "three"], tokens) == [(False, False), (True, False), (False, True)]
    assert M.layer_vectors(None, None) == []


def test_citations_of_documents():
    assert C.publication_date("x 2/31/2019 and 2020") == "2019-02-31"
    assert C.publication_date("Accessed 2021, published May 3rd, 2019") == "2021"
    assert C.divide([("Kessler ’26", False), ("Dana Kessler, analyst, 2026, https://x.example", False), ("Body", False)]) == ("Kessler ’26", "Dana Kessler, analyst, 2026, https://x.example", 2)
    assert C.divide([("In short:", False), ("Rodgers and Cooper 06, staff", False)]) == ("Rodgers and Cooper 06", "In short: staff", 2)
    assert C.divide([("Just a sentence without any sign", False)]) == (None, None, 0)
    assert C.divide([]) == (None, None, 0)
