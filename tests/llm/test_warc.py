"""Archives read back against what was written, and predicates against plain filters."""

import gzip
import hashlib
import io
import random
import struct
import zlib
from base64 import b32encode

import pytest
from pyspark.sql import functions as F

from folioscan.llm import warc

ROWS = [
    (1, "http://a/", "<p>x</p>", 1), (2, "http://b/\r\nWARC-Type: x", "<p>x</p>", 1), (3, None, None, 1), (4, "http://ü/ ", "", 1),
    (5, "u", "é\r\n\r\nWARC/1.1\r\n", 1), (6, "u", "y" * 3_000_000, 1), (7, "u", "y" * 3_000_000, 1), (None, "n", "<p>x</p>", 1), (8, "u", "<p>x</p>", 1),
]
SCHEMA = "page_id long, url string, html string, record_type int"


def brute(rows):
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        again = i is not None and first[h or ""] != i
        out.append((i, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = [tuple(r)[:5] for r in warc.round_trip(df).collect()]
    assert sorted(got, key=str) == brute(ROWS)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_id_with_two_payloads(spark):
    rows = [(3, "u", "B", 1), (5, "u", "A", 1), (5, "u", "B", 1), (6, "u", "C", 1), (2, "u", "D", 1), (7, "u", "D", 1), (7, "u", "B", 1)]
    got = [tuple(r)[:5] for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_query_round_trip(spark):
    from folioscan.llm.queries import op3_warc

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"], 0) for r in pages.collect()]
    assert sorted([tuple(r) for r in op3_warc(spark, "/root/testdata/sf0.01").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str) == brute(rows)


def test_predicates_and_payloads(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(df, folder)
    everything = warc.read_warc(spark, folder, "bytes", manifest)
    assert {r["record_id"]: r["payload"] for r in everything.where("record_type = 'response'").collect()}["<urn:page:5>"].decode() == ROWS[4][2]
    plain = everything.drop("payload")
    wanted = {"record_type": ["revisit"], "record_id": ["<urn:page:1>", "<urn:page:6>"]}
    for column, values in wanted.items():
        want = sorted(map(str, plain.where(F.col(column).isin(*values)).collect()))
        assert want and sorted(map(str, warc.read_warc(spark, folder, "skip", where={column: values}).drop("payload").collect())) == want
        assert sorted(map(str, warc.read_warc(spark, folder, "skip", manifest, {column: values}).drop("payload").collect())) == want
    with pytest.raises(Exception, match="no header columns"):
        warc.read_warc(spark, folder, where={"payload": ["x"]}).collect()


def test_a_frame_serves_many_queries(spark, tmp_path):
    """Conditions of one query are not those of the next, nor of another branch of the same query."""
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(spark.createDataFrame(ROWS, SCHEMA).repartition(2), folder)
    for rows in (warc.read_warc(spark, folder, manifest=manifest), warc.read_warc(spark, folder, where={"record_type": ["response", "revisit"]})):
        revisits, responses = rows.where("record_type = 'revisit'"), rows.where("record_type = 'response'")
        for _ in range(2):
            assert (revisits.count(), rows.count(), responses.count()) == (4, 9, 5)
        assert revisits.unionByName(responses).count() == 9


def test_files_of_other_record_types_are_not_opened(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(spark.createDataFrame(ROWS, SCHEMA).repartition(2), folder)
    for r in manifest.where("record_type = 'response'").collect():
        with open(r["file"], "wb") as f:
            f.write(b"nothing that could be read")
    assert warc.read_warc(spark, folder, "check", manifest, {"record_type": ["revisit"]}).count() == 4


def test_unwanted_payloads_are_not_decoded():
    good, bad = warc.record(1, "u", b"fine"), warc.record(2, "u", b"fine").replace(b"\r\n\r\nfine", b"\r\n\r\nfake")
    raw = gzip.compress(good) + gzip.compress(bad) + gzip.compress(warc.record(3, "u", b"", 1))
    rows = list(warc.read_records(io.BytesIO(raw), True, lambda r: r["record_id"] != "<urn:page:2>"))
    assert [r["record_id"] for r in rows] == ["<urn:page:1>", "<urn:page:3>"]
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(raw), True))
    assert len(list(warc.read_records(io.BytesIO(good + bad), False, payload="skip"))) == 2


@pytest.mark.parametrize("zipped", [True, False])
def test_unwanted_payloads_are_not_inflated(zipped, monkeypatch):
    """The second member is broken behind its header; it is passed over by its length, and so is a long uncompressed block."""
    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    noise = random.Random(0).randbytes(50_000)
    members = [warc.record(k, "u", noise if k == 2 else b"small") for k in (1, 2, 3)]
    if zipped:
        members = [warc._gzip(m) for m in members]
        members[1] = members[1][:20_000] + b"\xff" * 20_000 + members[1][40_000:]
    raw = b"".join(members)
    rows = list(warc.read_records(io.BytesIO(raw), zipped, lambda r: r["record_id"] != "<urn:page:2>"))
    assert [(r["record_id"], r["payload_bytes"]) for r in rows] == [("<urn:page:1>", 5), ("<urn:page:3>", 5)]
    assert [r["payload_bytes"] for r in warc.read_records(io.BytesIO(raw), zipped, payload="skip")] == [5, 50_000, 5]
    if zipped:
        with pytest.raises((zlib.error, ValueError)):
            list(warc.read_records(io.BytesIO(raw), True))


def test_members_are_gzip(spark):
    data = b"a record " * 500
    assert gzip.decompress(warc._gzip(data) + warc._gzip(b"")) == data
    assert struct.unpack("<II", warc._gzip(data)[16:24]) == (len(warc._gzip(data)), len(data))


def test_repeated_ids_give_a_record_for_each_row(spark):
    """Rows out are rows in, and every payload is a response somewhere."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 4]), "u", rng.choice(["A", "B", "C", "", None]), 1) for _ in range(60)] + [(5, "u", "alone", 1), (2, "u", "alone2", 1)]
    got = [tuple(r)[:5] for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert {r[2] for r in got if r[3] == "response"} == {r[2] for r in got}
