"""The query catalogue: each query as a Spark plan, and its SQL over the same tables."""

from __future__ import annotations

import contextlib
import io
from email.utils import formatdate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import functions as fn
from folioscan.operators import count_redirects, lookup_id, lookup_title, open_index, skip_redirects, with_position, write_index
from folioscan.plans.render import conversations_as_dump, documents_as_dump, escape_xml, with_preamble, write_dump
from folioscan.plans.repack import main, repack
from folioscan.sources import newest_local, read_dump, resolve_dump
from folioscan.streaming import ingest, read_dump_stream
from folioscan.workspace import scratch

_rendered: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dump_of(spark: SparkSession, sf_dir: str, kind: str, compression: str = "none") -> str:
    """The dump of a table, rendered once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind + compression)
    if key not in _rendered:
        lines = {
            "conversations": lambda: conversations_as_dump(table(spark, sf_dir, "conversations")),
            "with_empty": lambda: conversations_as_dump(table(spark, sf_dir, "conversations"), empty_pages=True),
            "with_preamble": lambda: with_preamble(conversations_as_dump(table(spark, sf_dir, "conversations"))),
            "documents": lambda: documents_as_dump(table(spark, sf_dir, "documents")),
        }[kind]()
        _rendered[key] = write_dump(lines, scratch(spark, f"dump-{kind}"), compression)
    return _rendered[key]


def index_of(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, "index")
    if key not in _rendered:
        path = scratch(spark, "index")
        write_index(read_dump(spark, dump_of(spark, sf_dir, "conversations")), path)
        _rendered[key] = path
    return _rendered[key]


def conv(spark, sf_dir):
    return read_dump(spark, dump_of(spark, sf_dir, "conversations"))


def docs(spark, sf_dir, entities="text"):
    return read_dump(spark, dump_of(spark, sf_dir, "documents"), entities)


def flat(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "timestamp_ms", F.col("page.title").alias("title"), F.col("page.id").alias("page_id"), F.col("page.is_redirect").alias("is_redirect"),
        F.col("contributor.username").alias("username"), F.col("contributor.id").alias("contributor_id"), "comment", "is_minor", "text",
    )


FLAT_SQL = """SELECT conv_id * 1000 + turn AS id, epoch_ms(TIMESTAMP '2024-01-01') + (conv_id * 60 + turn) * 60000 AS timestamp_ms,
 'Conv ' || conv_id AS title, conv_id AS page_id, conv_id % 5 = 0 AS is_redirect,
 CASE WHEN role = 'system' THEN NULL ELSE role END AS username, CASE WHEN role = 'system' THEN NULL ELSE conv_id END AS contributor_id,
 'turn ' || turn AS comment, turn % 2 = 1 AS is_minor, text FROM conversations"""
LAST_LINE_SQL = r"regexp_extract(text, '([^\n]*)$', 1)"
ESCAPED_LAST = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def redirect_counter(spark, sf_dir):
    rows, seen = count_redirects(conv(spark, sf_dir))
    skip_redirects(rows).write.format("noop").mode("overwrite").save()
    found = seen.get
    return spark.createDataFrame([(found["redirectPages"], found["revisions"])], "redirect_pages long, revisions long")


VERSIONS = 8
VERSIONS_SQL = f"SELECT event_type, event_id % {VERSIONS} AS version, max(epoch_ms(date_trunc('second', ts))) AS ms FROM events GROUP BY ALL"


def versions(spark, sf_dir):
    """(base folder, rows of event_type, version, ms): files of several dump versions of each language. An event type stands for a language, and the last digit of an event's number in base 8 for a version, whose file gets the time of its last event, in whole seconds."""
    base, jvm = scratch(spark, "versions"), spark.sparkContext._jvm
    version = (F.col("event_id") % VERSIONS).alias("version")
    last = F.max(F.unix_seconds(F.date_trunc("second", "ts").cast("timestamp"))) * 1000
    rows = table(spark, sf_dir, "events").groupBy("event_type", version).agg(last.alias("ms")).collect()  # some forty
    for kind, number, ms in rows:
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{kind}/v{number}.xml")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(path)
        out.write(b"<mediawiki/>")
        out.close()
        fs.setTimes(path, ms, -1)
    return base, rows


def newest_dump(spark, sf_dir):
    """The newest of several dump versions of each language."""
    base, rows = versions(spark, sf_dir)
    found = [(kind, newest_local(spark, f"{base}/{kind}")) for kind in sorted({r["event_type"] for r in rows})]
    return spark.createDataFrame([(kind, path.rsplit("/", 1)[1], ms) for kind, (path, ms) in found], "event_type string, newest string, modified_ms long")


class _Publisher:
    """A publisher whose dumps are all of one time."""

    def __init__(self, ms: int):
        self.ms = ms

    def last_modified(self, lang: str) -> int:
        return self.ms

    def open(self, lang: str) -> io.BytesIO:
        return io.BytesIO(f"<page><title>{lang}</title><id>1</id><revision><id>2</id></revision></page>".encode())


def chosen_dump(spark, sf_dir):
    """Which dump is read if the publisher's are as new as the newest of all languages: a local one of that time, else the one fetched, of which a page is read."""
    base, rows = versions(spark, sf_dir)
    publisher = _Publisher(max(r["ms"] for r in rows))
    out = []
    for kind in sorted({r["event_type"] for r in rows}):
        path = resolve_dump(spark, base, kind, True, publisher)
        again = resolve_dump(spark, base, kind, False, publisher)
        out.append((kind, path.rsplit("/", 1)[1], read_dump(spark, path).count(), again.rsplit("/", 1)[1]))
    return spark.createDataFrame(out, "event_type string, dump string, revisions long, again string")


CHOSEN_SQL = f"""SELECT event_type, dump, (dump LIKE '%wiki-latest%')::BIGINT AS revisions, dump AS again FROM (
 SELECT event_type, CASE WHEN max(ms) >= (SELECT max(ms) FROM ({VERSIONS_SQL})) THEN 'v' || arg_max(version, (ms, version)) || '.xml'
  ELSE event_type || 'wiki-latest-pages-articles.' || (SELECT max(ms) FROM ({VERSIONS_SQL})) || '.xml' END AS dump FROM ({VERSIONS_SQL}) GROUP BY event_type)"""


def dump_names(spark, sf_dir):
    """Names and addresses of dumps, and the times that a publisher would say, read from the dates of HTTP."""
    _, rows = versions(spark, sf_dir)
    out = []
    for kind, number, ms in rows:
        said = fn.http_date_ms(formatdate(ms // 1000, usegmt=True))
        out.append((kind, number, fn.dump_url(kind), fn.dump_file_name(kind, said), said))
    return spark.createDataFrame(out, "event_type string, version long, url string, file string, ms long")


DUMP_NAMES_SQL = f"""SELECT event_type, version, 'http://dumps.wikimedia.org/' || event_type || 'wiki/latest/' || event_type || 'wiki-latest-pages-articles.xml.bz2' AS url,
 event_type || 'wiki-latest-pages-articles.' || ms || '.xml' AS file, ms FROM ({VERSIONS_SQL})"""


def repack_index(spark, sf_dir):
    out = scratch(spark, "repacked")
    repack(spark, dump_of(spark, sf_dir, "conversations"), out)
    return flat(open_index(spark, out))


def repack_counters(spark, sf_dir):
    out = scratch(spark, "repacked")
    found = repack(spark, dump_of(spark, sf_dir, "conversations"), out, skip=True)
    left = open_index(spark, out).agg(F.count(F.lit(1)).alias("kept_revisions"))
    return left.select(*[F.lit(found[k]).cast("long").alias(v) for k, v in (("redirectPages", "redirect_revisions"), ("distinctRedirectPages", "redirect_pages"), ("revisions", "revisions"))], "kept_revisions")


def repack_command(spark, sf_dir):
    """The command, over a folder of dumps of a language, without redirects."""
    base, out = scratch(spark, "base"), scratch(spark, "repacked")
    write_dump(with_preamble(conversations_as_dump(table(spark, sf_dir, "conversations"))), f"{base}/en")
    with contextlib.redirect_stdout(io.StringIO()):
        status = main(["-b", base, "-o", out, "-r", "--lang", "en"], spark)
    if status:
        raise RuntimeError(f"the command ended with {status}")
    return flat(open_index(spark, out))


def lookup_title_q(spark, sf_dir):
    path = index_of(spark, sf_dir)
    smallest = open_index(spark, path).agg(F.min(F.struct(F.col("page.id"), F.col("page.title")))["title"].alias("t")).first()["t"]
    return lookup_title(spark, path, smallest).transform(flat)


def lookup_id_q(spark, sf_dir):
    path = index_of(spark, sf_dir)
    largest = open_index(spark, path).agg(F.max("id")).first()[0]
    row = lookup_id(spark, path, largest)
    return spark.createDataFrame([row], open_index(spark, path).schema).transform(flat)


def stream_scan(spark, sf_dir):
    out = scratch(spark, "stream")
    ingest(read_dump_stream(spark, dump_of(spark, sf_dir, "conversations")), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").transform(flat)


#: Before and behind a text: what plain text leaves out, at depths that no fixed number of passes reaches.
BEFORE = "{{hat|note}}<!-- c -->'''{title}''' [[Main page|label]] [http://x.org site] &amp;nbsp;"
BEHIND = "{{a|" * 20 + "x" + "}}" * 20 + "\n{| a\n| {| b |} c\n|}[[fr:Titre]]<gallery>x.jpg|y</gallery><math>a_{{b}}</math>{{{1|}}}\n== See also ==\n* x"


def plain(lang):
    def query(spark, sf_dir):
        head, tail = BEFORE.split("{title}")
        wrapped = F.concat(F.lit(head), F.col("page.title"), F.lit(tail), F.col("text"), F.lit(BEHIND))
        return docs(spark, sf_dir).select("id", fn.plain_text(wrapped, lang).alias("plain"))

    return query


def plain_sql(footer):
    """By hand: the texts hold no markup, so they stay as they are between what is left of both ends."""
    end = "" if footer else " || chr(10) || chr(10) || 'See also' || chr(10) || '* x'"
    whole = rf"regexp_replace('Doc ' || doc_id || ' label site &nbsp;' || coalesce(text, ''){end}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"SELECT doc_id AS id, regexp_replace({whole}, '[ \t\r\n]+$', '') AS plain FROM documents"


#: name -> (plan, SQL)
CATALOGUE: dict = {
    "scan_revisions": (lambda s, d: flat(conv(s, d)), FLAT_SQL),
    "scan_revisions_bz2": (lambda s, d: flat(read_dump(s, dump_of(s, d, "conversations", "bzip2"))), FLAT_SQL),
    "page_fields": (
        lambda s, d: conv(s, d).select("page.*").distinct().withColumnsRenamed({"id": "page_id"}),
        "SELECT DISTINCT 'Conv ' || conv_id AS title, conv_id AS page_id, conv_id % 5 = 0 AS is_redirect FROM conversations",
    ),
    "revision_ids": (lambda s, d: conv(s, d).select("id"), "SELECT conv_id * 1000 + turn AS id FROM conversations"),
    "timestamps_ms": (
        lambda s, d: conv(s, d).select("id", "timestamp_ms"),
        "SELECT conv_id * 1000 + turn AS id, epoch_ms(TIMESTAMP '2024-01-01') + (conv_id * 60 + turn) * 60000 AS timestamp_ms FROM conversations",
    ),
    "contributors": (
        lambda s, d: conv(s, d).select("id", F.col("contributor.username").alias("username"), F.col("contributor.id").alias("contributor_id"), F.col("contributor").isNull().alias("hidden")),
        "SELECT conv_id * 1000 + turn AS id, CASE WHEN role <> 'system' THEN role END AS username, CASE WHEN role <> 'system' THEN conv_id END AS contributor_id, role = 'system' AS hidden FROM conversations",
    ),
    "comments_minor": (lambda s, d: conv(s, d).select("id", "comment", "is_minor"), "SELECT conv_id * 1000 + turn AS id, 'turn ' || turn AS comment, turn % 2 = 1 AS is_minor FROM conversations"),
    "text_roundtrip": (lambda s, d: docs(s, d).select(F.col("id").alias("doc_id"), "text"), "SELECT doc_id, coalesce(text, '') AS text FROM documents"),
    "text_reference_entities": (
        lambda s, d: docs(s, d, "reference").select(F.col("id").alias("doc_id"), "text"),
        f"SELECT doc_id, left(text, length(text) - length({LAST_LINE_SQL})) || {ESCAPED_LAST.format(LAST_LINE_SQL)} AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    ),
    "xml_unescape": (
        lambda s, d: table(s, d, "documents").select("doc_id", fn.unescape_xml(F.concat(escape_xml(F.col("text")), F.lit("&apos;&amp;lt;"))).alias("text")),
        "SELECT doc_id, text || '''&lt;' AS text FROM documents",
    ),
    "normalize_title": (lambda s, d: table(s, d, "part").select("p_partkey", fn.normalize_title("p_name").alias("title")), "SELECT p_partkey, replace(p_name, ' ', '_') AS title FROM part"),
    "page_url": (
        lambda s, d: docs(s, d).select("id", fn.page_url(F.col("page.title"), F.col("comment")).alias("url")),
        "SELECT doc_id AS id, 'http://' || lang || '.wikipedia.org/wiki/Doc_' || doc_id AS url FROM documents",
    ),
    "reversed_url": (
        lambda s, d: docs(s, d).select("id", fn.reversed_url(F.col("page.title"), F.col("comment")).alias("url")),
        "SELECT doc_id AS id, 'org.wikipedia.' || lang || '/wiki/Doc_' || doc_id AS url FROM documents",
    ),
    "skip_redirects": (lambda s, d: flat(skip_redirects(conv(s, d))), f"SELECT * FROM ({FLAT_SQL}) WHERE NOT is_redirect"),
    "redirect_counter": (redirect_counter, "SELECT count(*) FILTER (conv_id % 5 = 0) AS redirect_pages, count(*) AS revisions FROM conversations"),
    "empty_pages_dropped": (lambda s, d: flat(read_dump(s, dump_of(s, d, "with_empty"))), FLAT_SQL),
    "sorted_by_id": (
        lambda s, d: with_position(conv(s, d).select("id"), "id"),
        "SELECT id, row_number() OVER (ORDER BY id) AS position FROM (SELECT conv_id * 1000 + turn AS id FROM conversations)",
    ),
    "lookup_title": (lookup_title_q, f"SELECT * FROM ({FLAT_SQL}) WHERE page_id = (SELECT min(conv_id) FROM conversations)"),
    "lookup_id": (lookup_id_q, f"SELECT * FROM ({FLAT_SQL}) ORDER BY id DESC LIMIT 1"),
    "newest_dump": (newest_dump, f"SELECT event_type, 'v' || arg_max(version, (ms, version)) || '.xml' AS newest, max(ms) AS modified_ms FROM ({VERSIONS_SQL}) GROUP BY event_type"),
    "chosen_dump": (chosen_dump, CHOSEN_SQL),
    "dump_names": (dump_names, DUMP_NAMES_SQL),
    "scan_with_preamble": (lambda s, d: flat(read_dump(s, dump_of(s, d, "with_preamble"))), FLAT_SQL),
    "repack_index": (repack_index, FLAT_SQL),
    "repack_counters": (
        repack_counters,
        "SELECT count(*) FILTER (conv_id % 5 = 0) AS redirect_revisions, count(DISTINCT conv_id) FILTER (conv_id % 5 = 0) AS redirect_pages, count(*) AS revisions, count(*) FILTER (conv_id % 5 <> 0) AS kept_revisions FROM conversations",
    ),
    "repack_command": (repack_command, f"SELECT * FROM ({FLAT_SQL}) WHERE NOT is_redirect"),
    "plain_text_en": (plain("en"), plain_sql(True)),
    "plain_text_de": (plain("de"), plain_sql(False)),
    "plain_text_zh": (plain("zh"), plain_sql(False)),
    "debug_text": (
        lambda s, d: conv(s, d).select("id", fn.revision_text().alias("debug")),
        f"""SELECT id, 'id:' || id || chr(10) || ' timestamp:' || timestamp_ms || chr(10) || ' page: title:' || title || chr(10) || 'id:' || page_id || chr(10) || 'isRedirect:' || is_redirect || ' ' || chr(10)
 || ' contributor:' || coalesce('username:' || username || chr(10) || 'id:' || contributor_id, 'null') || ' ' || chr(10) || ' comment:' || comment || ' ' || chr(10)
 || ' isMinor:' || is_minor || ' ' || chr(10) || ' text:' || text AS debug FROM ({FLAT_SQL})""",
    ),
    "stream_scan": (stream_scan, FLAT_SQL),
}
