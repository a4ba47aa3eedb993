"""Scalar functions against plain-Python twins written from their rules."""

import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholarflow.functions import text as X

TRICKY = [
    "", " ", "　 Café – α²: (v2)\x1f\n", "a b", "x_1-2 É", "---", "[12]", "12]", "[1",
    "$\\alpha  $ and $\\beta $", "a &amp; b &#8212; &#x41; &nope; &eacute &lt;", "&#0;&#xD800;&#1114112;",
    "tab\there", "ß ẞ",
]


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_strip_equals_python(spark):
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} == set(X.WHITESPACE)
    assert column(spark, TRICKY, X.strip("t")) == [(t.strip(),) for t in TRICKY]


def test_abstract_and_slug_equal_python(spark):
    got = column(spark, TRICKY, X.clean_abstract("t"), X.heading_slug("t"))
    for t, (abstract, slug) in zip(TRICKY, got):
        assert abstract == re.sub(r"(\\\S+)\s+\$", r"\1$", t)
        assert slug == "#" + re.sub(r"[^\w\s-]", "", t).lower().replace(" ", "%20")


def test_escape_citation(spark):
    got = [r[0] for r in column(spark, ["[12]", "12]", "[1", "a[1]b", "[]"], X.escape_citation("t"))]
    assert got == ["\\[12\\]", "12\\]", "\\[1", "a[1]b", "\\[\\]"]


def test_unescape(spark):
    known = ["a &amp; b", "&#8212;&#x41;", "&eacute;&Omega;", "&amp;lt;", "no", "&quot;x&quot;"]
    assert column(spark, known, X.unescape_html("t")) == [(html.unescape(t),) for t in known]
    odd = ["&nope;", "&", "a & b;", "&#xD800;", "&#1114112;"]
    assert column(spark, odd, X.unescape_html("t")) == [(html.unescape(t),) for t in odd]
    assert column(spark, ["&x;"], X.unescape_html("t", {"x": 42})) == [("*",)]


@pytest.mark.parametrize("url, source, document", [
    ("https://ieeexplore.ieee.org/document/8686088/", "IEEE", "8686088"),
    ("https://ieeexplore.ieee.org/search", "IEEE", "Unknown"),
    ("https://dl.acm.org/doi/10.1145/3079856.3080246", "ACM", "10.1145/3079856.3080246"),
    ("https://dl.acm.org/doi/abs/1", "ACM", "Unknown"),
    ("https://arxiv.org/abs/1", "Other", "Unknown"),
])
def test_classify_url(spark, url, source, document):
    assert tuple(column(spark, [url], X.classify_url("t"))[0][0]) == (source, document)


def test_file_names(spark):
    names = ["a.b.md", "x.json", "noext", ".hidden", "id-citation.json"]
    assert [r[0] for r in column(spark, names, X.drop_extension("t"))] == [
        "a.b", "x", "noext", ".hidden", "id-citation"
    ]


def test_front_matter_and_chapters(spark):
    text = "---\nt: x\n---\n\n# A\n\nintro\n\n## B\n\nb1\n\n### C\n\nc1\n## D\nd"
    cases = [text, "## a\n## b", "---\nabc", "----", "x\r\n## y", "## \n## "]
    got = column(spark, cases, X.front_matter("t"), X.chapters(X.front_matter("t")["body"]))
    assert got[0][0] == ("---\nt: x\n---", "# A\n\nintro\n\n## B\n\nb1\n\n### C\n\nc1\n## D\nd")
    assert got[0][1] == ["# A\n\nintro", "## B\n\nb1\n\n### C\n\nc1", "## D\nd"]
    assert got[1][1] == ["## a", "## b"]
    assert got[2][0] == ("", "---\nabc")
    assert got[3][0] == ("", "----")
    for t, (parts, chapters) in zip(cases, got):
        body = parts[1]
        pieces = re.split(r"(?=^## )", body, flags=re.MULTILINE)
        assert chapters == [p.strip() for p in pieces if p.strip()]


def test_part_count(spark):
    df = spark.createDataFrame([(0,), (2000,), (2001,), (4000,)], "n long")
    assert [r[0] for r in df.select(X.part_count("n")).collect()] == [1, 1, 2, 3]


def cut_python(text, n, last):
    """Twin of the split: ``last(window)`` gives the cut or -1."""
    width, out = len(text) // n, []
    for _ in range(n - 1):
        at = last(text[:width])
        at = len(text[:width]) if at < 0 else at
        out.append(text[:at])
        text = text[at:]
    return out + [text]


def last_match(window):
    hits = list(re.finditer(r"\n\n", window))
    return hits[-1].start() if hits else -1


def test_split_parts_equal_python(spark):
    letters = st.text(alphabet="ab\n.é", max_size=60)
    cases = []

    @settings(max_examples=250, deadline=None, derandomize=True)
    @given(letters, st.integers(1, 7))
    def gather(t, n):
        cases.append((t, n))

    gather()
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cases)], "i int, t string, n int")
    rows = df.select(
        "i", X.split_parts("t", "n").alias("literal"),
        X.split_parts("t", "n", pattern=r"\n\n").alias("regex"),
    ).orderBy("i").collect()
    for (t, n), row in zip(cases, rows):
        assert row.literal == cut_python(t, n, lambda w: w.rfind("\n\n")), (t, n)
        assert row.regex == cut_python(t, n, last_match), (t, n)
        assert "".join(row.literal) == "".join(row.regex) == t


def test_token_count(spark):
    values = ["", "a b", "Café, x_1!", "α² – β"]
    pattern = re.compile(r"\w+|[^\w\s]")
    assert column(spark, values, X.count_tokens("t")) == [(len(pattern.findall(t)),) for t in values]
