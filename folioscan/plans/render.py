"""Tables rendered as wiki dumps: input for round-trip tests, queries and the bench.

Conversations: a page for each conversation (title ``Conv <id>``, a redirect if
the id is divisible by 5), a revision for each turn (id ``conv_id * 1000 +
turn``). Documents: a page with one revision each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = "2024-01-01T00:00:00Z"


def escape_xml(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def _stamp(minutes: Column) -> Column:
    at = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(EPOCH))) + minutes * 60)
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _page(title: Column, page_id: Column, redirect: Column, body: Column) -> Column:
    return F.concat(
        F.lit("  <page>\n    <title>"), title, F.lit("</title>\n    <ns>0</ns>\n    <id>"), page_id.cast("string"), F.lit("</id>\n"),
        F.when(redirect, F.lit('    <redirect title="Target" />\n')).otherwise(F.lit("")), body, F.lit("  </page>"),
    )


def _revision(rev_id: Column, stamp: Column, by: Column, minor: Column, comment: Column, text: Column) -> Column:
    return F.concat(
        F.lit("    <revision>\n      <id>"), rev_id.cast("string"), F.lit("</id>\n      <parentid>7</parentid>\n      <timestamp>"), stamp, F.lit("</timestamp>\n"), by,
        F.when(minor, F.lit("      <minor />\n")).otherwise(F.lit("")), F.lit("      <comment>"), comment,
        F.lit('</comment>\n      <model>wikitext</model>\n      <text xml:space="preserve">'), text, F.lit("</text>\n    </revision>\n"),
    )


def conversations_as_dump(conversations: DataFrame, empty_pages: bool = False) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    by = F.when(F.col("role") == "system", F.lit("")).otherwise(
        F.concat(F.lit("      <contributor>\n        <username>"), F.col("role"), F.lit("</username>\n        <id>"), conv.cast("string"), F.lit("</id>\n      </contributor>\n"))
    )
    xml = _revision(conv * 1000 + turn, _stamp(conv * 60 + turn), by, turn % 2 == 1, F.concat(F.lit("turn "), turn.cast("string")), escape_xml(F.col("text")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "xml"))), lambda x: x["xml"]), "")
    pages = conversations.withColumn("xml", xml).groupBy("conv_id").agg(body.alias("body"))
    lines = pages.select(_page(F.concat(F.lit("Conv "), conv.cast("string")), conv, conv % 5 == 0, F.col("body")).alias("value"))
    if empty_pages:
        none = pages.select(_page(F.concat(F.lit("Empty "), conv.cast("string")), -conv - 2, F.lit(False), F.lit("")).alias("value"))
        lines = lines.unionByName(none)
    return lines


PREAMBLE = """<mediawiki xml:lang="en">
  <siteinfo>
    <sitename>Made of tables</sitename>
    <id>5</id>
    <namespaces><namespace key="0" /><namespace key="1">Talk</namespace></namespaces>
  </siteinfo>
"""


def with_preamble(lines: DataFrame) -> DataFrame:
    """A dump in one file, as it is published: a preamble before the first page, a closing tag behind the last."""
    ends = [(0, PREAMBLE.rstrip("\n")), (2, "</mediawiki>")]
    rows = lines.select(F.lit(1).alias("turn"), "value").unionByName(lines.sparkSession.createDataFrame(ends, "turn int, value string"))
    return rows.coalesce(1).sortWithinPartitions("turn").select("value")


def documents_as_dump(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    by = F.lit("      <contributor>\n        <ip>192.0.2.1</ip>\n      </contributor>\n")
    xml = _revision(doc, _stamp(doc % 500_000), by, F.lit(False), F.col("lang"), escape_xml(F.coalesce("text", F.lit(""))))
    return documents.select(_page(F.concat(F.lit("Doc "), doc.cast("string")), doc, F.lit(False), xml).alias("value"))


def write_dump(lines: DataFrame, path: str, compression: str = "none") -> str:
    lines.write.option("compression", compression).text(path)
    return path
