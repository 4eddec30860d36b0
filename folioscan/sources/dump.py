"""Reading wiki XML dumps: one row per revision, in parallel, plain or bzip2.

The text source cuts a dump at ``</page>``; markup inside texts is escaped, so
that tag cannot occur elsewhere. Splits may fall anywhere: the line reader
gives each page to exactly one task, for bzip2 as well. The header of a page is
taken before its revisions are exploded, so conditions on the page and unused
columns are dealt with by the optimizer below the explode.

A single page has to fit in one string (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import schema as S
from folioscan.functions import unescape_xml

ENTITIES = ("text", "reference", "full", "raw")


def _tag(c: Column, tag: str) -> Column:
    """Content of the first such element, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, rf"(?s)<{tag}>(.+?)</{tag}>", 1), F.lit(""))


def _number(c: Column, default: int) -> Column:
    digits = F.nullif(F.regexp_extract(c, r"<id>([0-9]+)</id>", 1), F.lit(""))
    return F.coalesce(digits.try_cast("long"), F.lit(default).cast("long"))


def pages_of(chunks: DataFrame) -> DataFrame:
    """``value`` chunks that end before ``</page>`` to (page, header) strings; text before a page is skipped."""
    return (
        chunks.where(F.col("value").contains("<page>"))
        .select(F.regexp_extract("value", r"(?s)(<page>.*)$", 1).alias("_xml"))
        .select("_xml", F.regexp_extract("_xml", r"(?s)^(.*?)(<revision>|$)", 1).alias("_header"))
    )


def _last_line_kept(text: Column) -> Column:
    last = F.substring_index(text, "\n", -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(last))
    return F.concat(unescape_xml(head), last)


def revisions_of(chunks: DataFrame, entities: str = "text", timestamps: str = "strict") -> DataFrame:
    """Chunks of a dump to revisions, batch or streaming.

    entities: ``text`` decodes texts and leaves titles, names and comments as
    they stand; ``reference`` also leaves the last line of each text; ``full``
    decodes everything; ``raw`` nothing. timestamps: ``strict`` raises for a
    malformed one, ``lenient`` gives the default. Pages without revisions give
    no row. Fields that are absent get the defaults of ``schema``; a missing or
    hidden contributor is null. CR LF and CR in texts become LF.
    """
    if entities not in ENTITIES:
        raise ValueError(f"entities must be one of {ENTITIES}")
    if timestamps not in ("strict", "lenient"):
        raise ValueError("timestamps must be strict or lenient")
    name = unescape_xml if entities == "full" else (lambda c: c)
    body_of = {"text": unescape_xml, "full": unescape_xml, "reference": _last_line_kept, "raw": lambda c: c}[entities]
    instant = F.to_timestamp if timestamps == "strict" else F.try_to_timestamp

    page = F.named_struct(
        F.lit("title"), name(_tag(F.col("_header"), "title")), F.lit("id"), _number(F.col("_header"), S.NO_PAGE_ID), F.lit("is_redirect"), F.col("_header").rlike(r"<redirect[^>]*/>")
    )
    rows = pages_of(chunks).select(
        page.alias("page"),
        F.explode(F.regexp_extract_all("_xml", F.lit(r"(?s)<revision>(.*?)</revision>"), F.lit(1))).alias("_rev"),
    )
    # An element that is looked for outside the text must not be found inside it; texts are escaped, so it cannot.
    by = F.regexp_extract("_rev", r"(?s)<contributor>(.*?)</contributor>", 1)
    rest = F.regexp_replace("_rev", r"(?s)<contributor>.*?</contributor>", "")
    contributor = F.when(
        F.col("_rev").contains("<contributor>"),
        F.named_struct(F.lit("username"), F.coalesce(name(_tag(by, "username")), F.lit(S.NO_USERNAME)), F.lit("id"), _number(by, S.NO_CONTRIBUTOR_ID)),
    )
    text = F.regexp_replace(F.regexp_extract("_rev", r"(?s)<text(?:\s[^>]*)?(?<!/)>(.*?)</text>", 1), r"\r\n?", "\n")
    return rows.select(
        _number(rest, S.NO_REVISION_ID).alias("id"),
        F.coalesce(F.unix_millis(instant(_tag(F.col("_rev"), "timestamp"))), F.lit(S.NO_TIMESTAMP).cast("long")).alias("timestamp_ms"),
        "page",
        contributor.alias("contributor"),
        F.coalesce(name(_tag(F.col("_rev"), "comment")), F.lit("")).alias("comment"),
        F.col("_rev").rlike("<minor ?/>").alias("is_minor"),
        body_of(text).alias("text"),
    )


def read_dump(spark: SparkSession, paths: str | list[str], entities: str = "text", timestamps: str = "strict") -> DataFrame:
    """Revisions of one or more dump files or folders; see ``revisions_of``. A missing path raises."""
    return revisions_of(spark.read.text(paths, lineSep="</page>"), entities, timestamps)
