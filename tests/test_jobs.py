"""Index, lookups, counters, local dump versions, the repack command and streams."""

import bz2
import io
import os
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from folioscan.functions import dump_file_name, dump_url, http_date_ms, normalize_title, page_url, plain_text, reversed_url
from folioscan.operators import ArticleNotFound, count_redirects, lookup_id, lookup_title, open_index, skip_redirects, sort_by_id, with_position, write_index
from folioscan.plans import repack
from folioscan.plans.queries import dump_of
from folioscan.sources import HttpFetcher, newest_local, read_dump, resolve_dump
from folioscan.streaming import ingest, read_dump_stream

SF = "/root/testdata/sf0.001"


class Fetcher:
    def __init__(self, modified, body=b"<page><title>N</title><id>1</id><revision><id>9</id></revision></page>"):
        self.modified, self.body, self.fetched = modified, body, 0

    def last_modified(self, lang):
        return self.modified

    def open(self, lang):
        self.fetched += 1
        return io.BytesIO(self.body)


@pytest.fixture
def base(tmp_path):
    os.makedirs(tmp_path / "en")
    for name, age in (("b.xml", 300), ("a.xml", 100), ("c.xml", 200)):
        (tmp_path / "en" / name).write_text(f"<page><title>{name}</title><id>1</id><revision><id>1</id></revision></page>")
        os.utime(tmp_path / "en" / name, (time.time() - age,) * 2)
    return str(tmp_path)


def test_newest_local(spark, base):
    path, ms = newest_local(spark, f"{base}/en")
    assert path.endswith("a.xml") and abs(ms / 1000 - (time.time() - 100)) < 30
    assert newest_local(spark, f"{base}/de") is None and os.path.isdir(f"{base}/de")
    assert newest_local(spark, f"{base}/de") is None


def test_resolve_dump(spark, base):
    now = int(time.time() * 1000)
    assert resolve_dump(spark, base).endswith("a.xml")
    old = Fetcher(now - 10_000_000)
    assert resolve_dump(spark, base, fetcher=old).endswith("a.xml") and not old.fetched
    new = Fetcher(now + 10_000)
    assert resolve_dump(spark, base, check_new=False, fetcher=new).endswith("a.xml") and not new.fetched
    path = resolve_dump(spark, base, fetcher=new)
    assert path.endswith(dump_file_name("en", now + 10_000)) and new.fetched == 1 and read_dump(spark, path).collect()[0]["id"] == 9
    assert not [f for f in os.listdir(f"{base}/en") if f.startswith("_incoming")]
    assert resolve_dump(spark, base, "fr", check_new=False, fetcher=Fetcher(now)).endswith(f"fr/{dump_file_name('fr', now)}")
    with pytest.raises(FileNotFoundError):
        resolve_dump(spark, base, "es")


def test_names_and_dates():
    assert dump_url("de").endswith("/dewiki/latest/dewiki-latest-pages-articles.xml.bz2")
    assert http_date_ms("Fri, 6 Feb 2015 04:18:52 GMT") == 1423196332000
    with pytest.raises(OSError):
        http_date_ms("yesterday")


@pytest.fixture
def server(tmp_path):
    """A publisher on this machine."""
    body = bz2.compress(b"<page><title>N</title><id>1</id><revision><id>9</id></revision></page>\n" * 3)

    class Answer(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(404 if "xx" in self.path else 200)
            self.send_header("Last-Modified", "Fri, 6 Feb 2015 04:18:52 GMT")
            self.send_header("Content-Length", str(len(body) + 5 * ("short" in self.path)))
            self.end_headers()

        def do_GET(self):
            self.do_HEAD()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    with HTTPServer(("127.0.0.1", 0), Answer) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{http.server_port}/"
        http.shutdown()


def test_http_fetcher(spark, base, server):
    fetcher = HttpFetcher(lambda lang: f"{server}{lang}.xml.bz2", timeout=10)
    assert fetcher.last_modified("de") == 1423196332000
    path = resolve_dump(spark, base, "de", False, fetcher)
    assert path.endswith(f"de/{dump_file_name('de', 1423196332000, '.xml.bz2')}") and read_dump(spark, path).count() == 3
    assert resolve_dump(spark, base, "de", True, fetcher) == newest_local(spark, f"{base}/de")[0]  # what is there is as new
    for lang in ("xx", "short"):
        with pytest.raises(OSError):
            resolve_dump(spark, base, lang, True, fetcher)
        assert not [f for f in os.listdir(f"{base}/{lang}") if not f.startswith(".")]
    assert repack.main(["-b", base, "-o", f"{base}/http", "--lang", "fr"], spark, fetcher) == 0 and open_index(spark, f"{base}/http").count() == 3


def test_titles(spark):
    df = spark.createDataFrame([("a b\tc ",), (None,)], "t string")
    assert [tuple(r) for r in df.select(normalize_title("t"), page_url("t", "de"), reversed_url("t")).collect()] == [
        ("a_b\tc_", "http://de.wikipedia.org/wiki/a_b\tc_", "org.wikipedia.en/wiki/a_b\tc_"),
        (None, None, None),
    ]


def test_index(spark, tmp_path):
    revisions = read_dump(spark, dump_of(spark, SF, "conversations"))
    write_index(revisions, str(tmp_path / "i"))
    ids = [r["id"] for r in revisions.select("id").orderBy("id").collect()]
    row = lookup_id(spark, str(tmp_path / "i"), ids[5])
    assert row["id"] == ids[5] and row["page"]["id"] == ids[5] // 1000
    found = lookup_title(spark, str(tmp_path / "i"), row["page"]["title"]).collect()
    assert {r["page"]["title"] for r in found} == {row["page"]["title"]} and len(found) == sum(i // 1000 == ids[5] // 1000 for i in ids)
    for wrong in (lambda: lookup_id(spark, str(tmp_path / "i"), -5), lambda: lookup_title(spark, str(tmp_path / "i"), "conv 1")):
        with pytest.raises(ArticleNotFound, match="does not exist"):
            wrong()
    plan = open_index(spark, str(tmp_path / "i")).where(F.col("id") == 7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,7)" in plan
    write_index(revisions, str(tmp_path / "one"), files=1)
    names = [f for f in os.listdir(tmp_path / "one" / "revisions") if f.endswith(".parquet")]
    assert len(names) == 1 and [r["id"] for r in spark.read.parquet(str(tmp_path / "one" / "revisions")).collect()] == ids


def test_counter_comes_before_the_filter(spark):
    rows, seen = count_redirects(read_dump(spark, dump_of(spark, SF, "conversations")))
    left = skip_redirects(rows).count()
    assert seen.get["redirectPages"] > 0 and seen.get["revisions"] == left + seen.get["redirectPages"]


def test_order_and_positions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("id")).repartition(7)
    assert [r["id"] for r in sort_by_id(df).collect()] == sorted(r["id"] for r in df.collect())
    rows = with_position(df, "id").collect()
    assert sorted((r["id"], r["position"]) for r in rows) == [(v, k + 1) for k, v in enumerate(sorted(r["id"] for r in rows))]
    assert with_position(df.limit(0), "id").collect() == []


def test_repack_command(spark, base, capsys):
    assert repack.main(["-b", base, "-o", f"{base}/out"], spark) == 0
    assert "redirectPages=0" in capsys.readouterr().out and open_index(spark, f"{base}/out").count() == 1
    assert repack.main(["-b", base, "-o", f"{base}/out"], spark) == 1  # it exists

    class Broken(Fetcher):
        def open(self, lang):
            raise OSError("gone")

    assert repack.main(["-b", base, "-o", f"{base}/x", "--lang", "es"], spark, Broken(5)) == 1
    assert [f for f in os.listdir(f"{base}/es") if not f.startswith(".")] == []
    # Nothing is there, so a dump is fetched although nobody asked for a newer one.
    capsys.readouterr()
    assert repack.main(["-b", base, "-o", f"{base}/x", "--lang", "es"], spark, Fetcher(1_500_000_000_000)) == 0
    assert "revisions=1" in capsys.readouterr().out and os.path.exists(f"{base}/es/{dump_file_name('es', 1_500_000_000_000)}")
    assert repack.main(["-h"], spark) == 0 and repack.main(["-b", base], spark) == 1


def test_repack_skips_redirects(spark, tmp_path):
    counters = repack.repack(spark, dump_of(spark, SF, "conversations"), str(tmp_path / "o"), skip=True)
    left = open_index(spark, str(tmp_path / "o"))
    assert left.where("page.is_redirect").isEmpty() and left.count() == counters["revisions"] - counters["redirectPages"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    page = "<page><title>T</title><id>{0}</id><revision><id>{0}</id></revision></page>"
    for k in range(3):
        (tmp_path / "in" / f"{k}.xml").write_text(page.format(k))
        ingest(read_dump_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
        assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).select("id").collect()) == list(range(k + 1))


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("en", "a <!-- x\ny --> b<ref>c</ref><ref name='d'/>", "a  b"),
        ("en", "{{a|{{b|{{c}}}}}}x{| t\n|}y", "xy"),
        *[("en", "{{a|" * n + "in" + "}}" * n + " out {x} }} {{ end", "out {x} }} {{ end") for n in (1, 8, 9, 50, 400)],
        ("en", "a{{b}}c}}d{{e{{f}}g", "ac}}d{{eg"),
        ("en", "x {| a {| b |} c {| d {| e |} |} |} y {| z", "x  y {| z"),
        ("en", "a{{b|{{{1|c}}}}}d {{{2}}}", "ad"),
        ("en", "[[fr:Titre]][[zh-min-nan:X]]a<gallery a=b>\nx|y\n</gallery><math>x^2</math>b[[Help:c|d]]", "abd"),
        ("en", "[[File:a.jpg|thumb|a [[b]] c]]d [[e|f]] [[g]]", "d f g"),
        ("de", "[[Datei:a.jpg]]x\n== Weblinks ==\ny", "x"),
        ("zh", "[[文件:a.jpg]]x\n== 参考文献 ==\ny", "x"),
        ("fr", "[[Category:A]]x\n== References ==\ny", "x"),
        ("en", "== H ==\n'''b''' ''i'' [http://x y z] [http://q]\n\n\n\n<br/>&nbsp;&lt;", "H\nb i y z \n\n <"),
        ("en", None, None),
    ],
)
def test_plain_text(spark, lang, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(plain_text("t", lang).alias("p")).first()["p"]
    assert got == want


def test_library_does_not_need_the_subpackage():
    """Nothing outside folioscan/llm imports it but the entry and the pipeline."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "folioscan")):
        if os.path.basename(folder) == "llm" or "/llm/" in folder + "/":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"folioscan\.llm|from \.+llm", f.read()), name


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from folioscan import workspace

    def session(master):
        conf = SimpleNamespace(get=lambda key, default: default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master, applicationId=master))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            workspace.shared_root(session(master))
    assert workspace.shared_root(session("local[4]")).startswith("file://") and workspace.shared_root(session("local")).startswith("file://")


def test_write_once_keeps_what_is_complete(spark, tmp_path):
    from folioscan.workspace import write_once

    path = f"file://{tmp_path}/t"
    assert write_once(spark.range(3), path).count() == 3 and write_once(spark.range(9), path).count() == 3
    os.remove(tmp_path / "t" / "_SUCCESS")
    assert write_once(spark.range(9), path).count() == 9
