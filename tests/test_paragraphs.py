"""HTML whose blocks stay paragraphs: texts, sections and the whole way from a payload."""

import pytest
from pyspark.sql import functions as F

from siftwork.functions.html import strip_html
from siftwork.operators.chunking import section_chunks
from siftwork.sources import payloads as L
from tests.test_sources import raw_rows

CASES = [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a</p><p>b</p>", "a\n\nb"), ("<div><p>a</p></div>  <div>b<br>c<br/>d</div>", "a\n\nb\nc\nd"),
    ("<ul><li>x</li><li>y &amp; z</li></ul>after", "x\ny & z\n\nafter"), ("a <b>bold</b> word", "a bold word"),
    ("<h2 title='a > b'>Head</h2><table><tr><td>1</td><td>2</td></tr></table>", "Head\n\n1\n\n2"), ("<pre>x</pre><prefix>y</prefix>", "x\n\ny"),
    ("&lt;p&gt;escaped&lt;/p&gt;&lt;p&gt;twice &amp;amp; more&lt;/p&gt;", "escaped\n\ntwice & more"), ("<script>x<p>y</p></script>z", "z"),
    ("<!-- <p> -->a<P>b</P\n>c", "a\n\nb\n\nc"), ("a\x02b", "ab"), ("a&#2; b<p>c", "a b\n\nc"), ("<p></p><p> </p>", ""), ("one  two<p>x\n\n\ny</p>", "one\ntwo\n\nx\ny"),
]


def test_paragraphs(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "i int, h string")
    found = {r["i"]: r["t"] for r in df.select("i", strip_html(F.col("h"), keep_paragraphs=True).alias("t")).collect()}
    assert [found[i] for i in range(len(CASES))] == [t for _, t in CASES]


def test_only_white_space_differs(spark):
    df = spark.createDataFrame([(h,) for h, _ in CASES if h and "\x02" not in h and "&#2;" not in h], "h string")
    for r in df.select(strip_html(F.col("h")).alias("a"), strip_html(F.col("h"), True).alias("b")).collect():
        assert "".join(r["a"].split()) == "".join(r["b"].split())


@pytest.mark.parametrize("keep", [False, True])
def test_sections_of_an_html_posting(spark, keep):
    body = "<p>About the role</p><p>We build things for people.</p><h3>Requirements</h3><ul><li>Five years of Python experience required</li></ul><h3>Benefits</h3><p>Medical, dental and 401k benefits</p>"
    green = {"jobs": [{"id": 1, "title": "Engineer", "updated_at": "2025-01-20T00:00:00Z", "content": body}]}
    rows = L.normalize_all(raw_rows(spark, ("greenhouse", "acme", green)), F.lit("2025-01-31").cast("timestamp"), keep_paragraphs=keep)
    sections = {r["chunk_key"] for r in section_chunks(rows).collect()}
    assert ("requirements" in sections and "benefits" in sections) if keep else len(sections) == 1
