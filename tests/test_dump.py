"""The dump reader: known values, edge dumps, splits, random dumps against a plain model."""

import bz2
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscan.functions import plain_text, unescape_xml
from folioscan.plans.queries import dump_of
from folioscan.plans.render import documents_as_dump
from folioscan.sources import read_dump

HEAD = '<mediawiki xml:lang="en">\n  <siteinfo>\n    <sitename>Wiki</sitename>\n  </siteinfo>\n'
TWO_PAGES = (
    HEAD
    + """  <page>
    <title>AccessibleComputing</title>
    <ns>0</ns>
    <id>10</id>
    <redirect title="Computer accessibility" />
    <revision>
      <id>631144794</id>
      <parentid>381202555</parentid>
      <timestamp>2014-10-26T04:50:23Z</timestamp>
      <contributor>
        <username>Paine Ellsworth</username>
        <id>9092818</id>
      </contributor>
      <comment>add [[WP:RCAT|rcat]]s</comment>
      <model>wikitext</model>
      <text xml:space="preserve">#REDIRECT [[Computer accessibility]]

{{Redr|move|from CamelCase|up}}</text>
      <sha1>x</sha1>
    </revision>
  </page>
  <page>
    <title>Anarchism</title>
    <ns>0</ns>
    <id>12</id>
    <revision>
      <id>645849603</id>
      <timestamp>2015-02-06T04:18:52Z</timestamp>
      <contributor>
        <username>ChrisGualtieri</username>
        <id>16333418</id>
      </contributor>
      <minor />
      <comment>General fixes - Bracket fixes using [[Project:AWB|AWB]]</comment>
      <text xml:space="preserve">{{Redirect2|a|b}}
'''Anarchism''' is a [[political philosophy|philosophy]] &lt;ref name=&quot;x&quot;&gt;{{cite|{{a}}}}&lt;/ref&gt;of ''no rulers''.

== Notes ==
* [[x]]
[[Category:Politics]]</text>
    </revision>
  </page>
</mediawiki>
"""
)


@pytest.fixture
def dump(spark, tmp_path):
    def read(text, name="d.xml", **options):
        path = tmp_path / name
        path.write_bytes(bz2.compress(text.encode()) if name.endswith("bz2") else text.encode())
        return read_dump(spark, str(path), **options)

    return read


def revision(body, page="<title>T</title><id>1</id>"):
    return f"{HEAD}<page>{page}<revision>{body}</revision></page></mediawiki>"


def test_two_pages(dump):
    first, second = dump(TWO_PAGES).orderBy("id").collect()
    assert (first["id"], first["timestamp_ms"], first["comment"]) == (631144794, 1414299023000, "add [[WP:RCAT|rcat]]s")
    assert first["page"].asDict() == {"title": "AccessibleComputing", "id": 10, "is_redirect": True}
    assert first["contributor"].asDict() == {"username": "Paine Ellsworth", "id": 9092818} and not first["is_minor"]
    assert first["text"] == "#REDIRECT [[Computer accessibility]]\n\n{{Redr|move|from CamelCase|up}}"
    assert (second["id"], second["timestamp_ms"], second["is_minor"]) == (645849603, 1423196332000, True)
    assert second["page"].asDict() == {"title": "Anarchism", "id": 12, "is_redirect": False} and second["contributor"]["id"] == 16333418
    assert '<ref name="x">' in second["text"]


def test_plain_text(dump):
    rows = [r["p"] for r in dump(TWO_PAGES).orderBy("id").select(plain_text("text").alias("p")).collect()]
    assert rows == ["#REDIRECT Computer accessibility", "Anarchism is a philosophy of no rulers."]


@pytest.mark.parametrize("text", ["", HEAD, HEAD + "</mediawiki>", HEAD + "<page><title>A</title><id>1</id></page></mediawiki>", HEAD + "<page><title>A</title>"])
def test_no_revisions(dump, text):
    assert dump(text).collect() == []


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_dump(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("", {"id": 0, "timestamp_ms": 0, "comment": "", "text": "", "is_minor": False, "contributor": None}),
        ("<contributor><username>U</username><id>5</id></contributor><parentid>4</parentid>", {"id": 0}),
        ("<id>7</id><contributor><ip>1.2.3.4</ip></contributor>", {"id": 7, "contributor": ("", -1)}),
        ('<id>7</id><contributor deleted="deleted" /><comment deleted="deleted" /><text deleted="deleted" />', {"contributor": None, "comment": "", "text": ""}),
        ("<comment>a\nb &amp; c</comment>", {"comment": "a\nb &amp; c"}),
        ("<timestamp>2024-01-01T02:00:00+02:00</timestamp>", {"timestamp_ms": 1704067200000}),
        ("<timestamp>2024-01-01T00:00:00.5Z</timestamp>", {"timestamp_ms": 1704067200500}),
        ("<minor/>", {"is_minor": True}),
        ("<minor />", {"is_minor": True}),
        ('<text bytes="3" xml:space="preserve" sha1="q">abc\n</text>', {"text": "abc\n"}),
        ('<text xml:space="preserve">\nx</text>', {"text": "\nx"}),
        ("<text>a\r\nb\rc</text>", {"text": "a\nb\nc"}),
        ("<text>a b\u0085c</text>", {"text": "a b\u0085c"}),
        ("<text>&amp;lt; &#65;&#x1F600; &#38;lt; &bogus; &#0; & &quot;&apos;&lt;&gt;</text>", {"text": "&lt; A😀 &lt; &bogus; &#0; & \"'<>"}),
        ("<text>&lt;minor /&gt; &lt;id&gt;3&lt;/id&gt;</text>", {"text": "<minor /> <id>3</id>", "id": 0, "is_minor": False}),
    ],
)
def test_edges(dump, body, want):
    row = dump(revision(body)).collect()[0]
    for k, v in want.items():
        assert (tuple(row[k]) if k == "contributor" and row[k] else row[k]) == v


def test_entity_options(dump):
    text = revision("<comment>&amp;c</comment><text>&lt;a\n&lt;b</text>", "<title>R&amp;D</title><id>1</id>")
    values = {e: dump(text, entities=e).select("text", "comment", "page.title").collect()[0] for e in ("text", "reference", "full", "raw")}
    assert tuple(values["text"]) == ("<a\n<b", "&amp;c", "R&amp;D")
    assert tuple(values["reference"]) == ("<a\n&lt;b", "&amp;c", "R&amp;D")
    assert tuple(values["full"]) == ("<a\n<b", "&c", "R&D")
    assert tuple(values["raw"]) == ("&lt;a\n&lt;b", "&amp;c", "R&amp;D")
    with pytest.raises(ValueError, match="entities"):
        dump(text, entities="x")


def test_malformed_timestamp(dump):
    text = revision("<timestamp>soon</timestamp>")
    assert dump(text, timestamps="lenient").collect()[0]["timestamp_ms"] == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        dump(text).select("timestamp_ms").collect()


def test_long_title_and_several_revisions(dump):
    title = "t" * 70_000
    rows = dump(f"{HEAD}<page><title>{title}</title><id>3</id>" + "".join(f"<revision><id>{i}</id></revision>" for i in range(3)) + "</page>").collect()
    assert [r["id"] for r in rows] == [0, 1, 2] and {r["page"]["title"] for r in rows} == {title}


@pytest.mark.parametrize("compression", ["none", "bzip2"])
@pytest.mark.parametrize("size", ["10000", "100000", "128m"])
def test_splits_do_not_matter(spark, compression, size):
    path = dump_of(spark, "/root/testdata/sf0.01", "documents", compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = read_dump(spark, path).select(F.col("id").alias("doc_id"), "text")
        want = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_null_text_renders_as_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en")], "doc_id long, text string, lang string")
    documents_as_dump(docs).write.text(f"{tmp_path}/d")
    assert read_dump(spark, f"{tmp_path}/d").collect()[0]["text"] == ""


def model(text):
    """A plain reading of what a dump says, by one scan over its elements."""
    out = []
    for page in re.findall(r"(?s)<page>(.*?)</page>", text):
        head = page.split("<revision>")[0]
        for rev in re.findall(r"(?s)<revision>(.*?)</revision>", page):
            by = re.search(r"(?s)<contributor>(.*?)</contributor>", rev)
            rest = re.sub(r"(?s)<contributor>.*?</contributor>", "", rev)
            num = lambda s, d: int(m[1]) if (m := re.search("<id>([0-9]+)</id>", s)) else d
            word = lambda s, t: m[1] if (m := re.search(f"(?s)<{t}>(.+?)</{t}>", s)) else ""
            body = re.search(r"(?s)<text[^>]*[^/>]?>(.*?)</text>", rev)
            body = body[1] if body else ""
            for e, c in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
                body = body.replace(e, c)
            out.append((num(rest, 0), num(head, -1), word(head, "title"), (word(by[1], "username"), num(by[1], -1)) if by else None, word(rev, "comment"), "<minor />" in rev, body))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_random_dumps(dump, seed):
    rng = random.Random(seed)
    maybe = lambda s, p=0.7: s if rng.random() < p else ""
    nl = lambda: rng.choice(["", "\n", "\n    "])
    word = lambda: "".join(rng.choice("ab é\n&<>") for _ in range(rng.randint(1, 12))).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    text = HEAD
    for p in range(60):
        text += "<page>" + nl() + f"<title>P{p}</title>" + nl() + maybe(f"<id>{p}</id>") + maybe('<redirect title="x" />', 0.2) + nl()
        for r in range(rng.randint(0, 4)):
            by = f"<contributor>{nl()}" + maybe("<username>u v</username>") + nl() + maybe(f"<id>{r + 5}</id>") + "</contributor>"
            parts = [maybe(f"<id>{p * 10 + r}</id>"), maybe(by), maybe(f"<comment>{word()}</comment>"), maybe("<minor />", 0.3), maybe(f'<text xml:space="preserve">{word()}</text>')]
            text += "<revision>" + nl().join(parts) + nl() + "</revision>"
        text += nl() + "</page>\n"
    got = [(r["id"], r["page"]["id"], r["page"]["title"] or "", tuple(r["contributor"]) if r["contributor"] else None, r["comment"], r["is_minor"], r["text"]) for r in dump(text).collect()]
    assert sorted(got, key=str) == model(text)


def test_page_conditions_go_below_the_explode(spark):
    df = read_dump(spark, dump_of(spark, "/root/testdata/sf0.001", "conversations")).where("NOT page.is_redirect").select("id")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RLIKE") if "RLIKE" in plan.split("Generate")[0] else "RLIKE" in plan.split("Generate")[1]
    assert "StringContains(value,<page>)" in df._jdf.queryExecution().executedPlan().toString()
    assert "username" not in plan  # unused fields are not extracted


def test_unescape_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(unescape_xml("t").alias("t")).collect() == [(None,)]
