"""WARC archives: a writer with revisits for repeated payloads, and a data source.

``write_warc`` writes a record for each page, gzipped one by one, each task into
files of its own, responses and revisits apart. Of pages with the same payload
the one with the least id is a response; the others are revisits that name it
and hold no payload. Names of files are made anew by each attempt, and only
those in the returned manifest belong to the archive, so a task that ran twice
leaves nothing behind that is read. Each gzip member says its own lengths in the
extra field ``sl``, so a reader can pass over it.

``WarcSource`` (``spark.read.format("warc")``) plans partitions of whole files
by size; files whose record type the manifest names and nobody wants are not
planned. A record's header is read first; its payload is only decoded, and its
digest only checked, if the record is wanted and the payload asked for (option
``payload``: ``check`` by default, ``bytes`` to return it too, ``skip`` for
headers alone). What is passed over is not inflated where the member says its
length. Predicates on record type and other header columns go into the reader by
``where`` of ``read_warc``, when the frame is made: Spark 4.1 keeps what a query
has pushed into a Python source with the frame, so a frame that took its
conditions from queries would answer the next one wrongly.

Defined results: null payloads are empty; empty payloads are payloads like any
other; rows without an id are always responses, as are all rows that repeat the
least id; an id with several payloads has a record for each of its rows, judged by
that row's payload; ties go to the least id; very long payloads are records like
any other, one of them at a time in memory; null addresses leave the header out;
an empty table gives an archive without records; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscan.llm.common import dealt_join, small_or_plain
from folioscan.llm.textscan import in_arrow
from folioscan.workspace import persist_table, scratch

LEVEL = 3
PARTITION_BYTES = 32 << 20
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 20
#: What is inflated at once while headers are read.
HEAD_BYTES = 4096
#: A task begins another file beyond that.
FILE_BYTES = 1 << 30

HEADER_COLUMNS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
SCHEMA = "file string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value: white space and control characters escaped."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id, url: str | None, payload: bytes, refers_to=None, key: tuple[str, int] | None = None) -> bytes:
    """One WARC record; a revisit if it refers to another page. key: SHA-1 in hex and length of the payload, where they are known; a revisit needs no more."""
    sha, size = (base64.b32encode(bytes.fromhex(key[0])).decode(), key[1]) if key else (digest(payload), len(payload))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Record-ID: <{URN}{page_id}>"] if page_id is not None else []
    head += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    """A member; its extra field says how long it is and how long its contents are."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    known = size < 1 << 32 and len(data) < 1 << 32
    extra = struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) if known else b""
    return b"\x1f\x8b\x08" + bytes([4 * known]) + b"\0\0\0\0\0\xff" + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _payload_key(payload_col: str) -> list[Column]:
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return [F.sha1(text.cast("binary")).alias("sha"), F.octet_length(text).alias("size")]


def revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """(id, sha, size, refers_to) of the payloads that a page with a lesser id has."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), *_payload_key(payload_col)).where(F.col("id").isNotNull() & (F.col("size") >= least_bytes))
    rows = persist_table(rows, "payload-digests")
    first = rows.groupBy("sha", "size").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return dealt_join(rows, first, ["sha", "size"], ["id"]).where("id <> refers_to").select("id", "sha", "size", "refers_to")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the archive; returns its stored manifest (file, record_type, records, bytes). Ids are integers."""
    again = persist_table(revisits(pages, id_col, payload_col, least_bytes).distinct(), "revisits")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"), *_payload_key(payload_col))
    rows = rows.join(small_or_plain(again), ["id", "sha", "size"], "left").select("id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "sha", "size", "refers_to")
    target, path = _store(folder)
    target.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _store(folder)
        open_now: dict[str, list] = {}  # kind -> name, records, bytes, stream
        done: list[tuple] = []

        def close(kind: str) -> None:
            name, n, size, out = open_now.pop(kind)
            out.close()
            done.append((name, kind, n, size))

        try:
            for batch in batches:
                for page_id, url, payload, sha, size, refers_to in zip(*(batch.column(c) for c in ("id", "url", "payload", "sha", "size", "refers_to")), strict=True):
                    refers_to = refers_to.as_py()
                    kind = "response" if refers_to is None else "revisit"
                    data = _gzip(record(page_id.as_py(), url.as_py(), (payload.as_py() or "").encode(), refers_to, (sha.as_py(), size.as_py())))
                    if kind not in open_now:
                        name = f"{where}/{kind}-{uuid.uuid4().hex}.warc.gz"
                        open_now[kind] = [name, 0, 0, store.open_output_stream(name, compression=None)]
                    now = open_now[kind]
                    now[3].write(data)
                    now[1], now[2] = now[1] + 1, now[2] + len(data)
                    if now[2] >= FILE_BYTES:
                        close(kind)
        finally:
            for kind in list(open_now):
                close(kind)
        columns = list(zip(*done, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "record_type", "records", "bytes"])

    return persist_table(in_arrow(rows, run, "file string, record_type string, records long, bytes long"), "warc-manifest")


@dataclass
class Files(InputPartition):
    names: list[str]


class Members:
    """The bytes of a possibly gzipped file, member after member, as far as they are asked for."""

    def __init__(self, raw, zipped: bool):
        self.raw, self.zipped = raw, zipped
        self.rest = b""  # raw bytes that are not used yet
        self.buffer, self.at = b"", 0  # contents, and how far they are used
        self.inflate, self.lengths, self.used, self.out = None, None, 0, 0  # of the present member

    def _raw(self, least: int = 1) -> bytes:
        while len(self.rest) < least and (data := self.raw.read(READ_BYTES)):
            self.rest += data
        return self.rest

    def _open(self) -> bool:
        """Begin a member; False at the end of the file."""
        head = self._raw(24)
        if not head:
            return False
        self.inflate, self.lengths, self.used, self.out = zlib.decompressobj(31), None, 0, 0
        if head[3:4] == b"\x04" and head[10:16] == b"\x0c\0sl\x08\0":
            self.lengths = struct.unpack("<II", head[16:24])
        return True

    def _more(self, want: int) -> bool:
        """Add to the buffer, about ``want`` bytes; False at the end of the file."""
        while True:
            if not self.zipped:
                got, self.rest = self._raw(), b""
                if not got:
                    return False
            else:
                if self.inflate is None and not self._open():
                    return False
                if not (data := self._raw()):
                    raise ValueError("the file ends within a member")
                got = self.inflate.decompress(data, max(HEAD_BYTES, want))
                self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
                self.used, self.out = self.used + len(data) - len(self.rest), self.out + len(got)
                if self.inflate.eof:
                    self.inflate = None
            if got:
                self.buffer, self.at = self.buffer[self.at :] + got, 0
                return True

    def line(self) -> bytes | None:
        """Up to and with the next line feed; None at the end."""
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more(0):
                return None
        out, self.at = self.buffer[self.at : end + 1], end + 1
        return out

    def take(self, n: int) -> bytes:
        while (have := len(self.buffer) - self.at) < n:
            if not self._more(n - have):
                raise ValueError("the file ends within a record")
        out, self.at = self.buffer[self.at : self.at + n], self.at + n
        return out

    def skip(self, n: int) -> None:
        """Pass over ``n`` bytes, the last of a record but its closing blank lines; a member that holds nothing else is left at once, without inflating it."""
        have = len(self.buffer) - self.at
        if n > have and self.inflate is not None and self.lengths and self.out - have + n + 4 == self.lengths[1]:
            self._pass(self.lengths[0] - self.used)
            self.buffer, self.at, self.inflate = b"", 0, None
            return
        if n > have and not self.zipped:
            self.buffer, self.at = b"", 0
            self._pass(n - have)
            return
        while n > 0:
            have = min(n, len(self.buffer) - self.at)
            self.at, n = self.at + have, n - have
            if n and not self._more(0):
                raise ValueError("the file ends within a record")

    def _pass(self, n: int) -> None:
        """Pass over raw bytes."""
        if n <= len(self.rest):
            self.rest = self.rest[n:]
        else:
            self.raw.seek(n - len(self.rest), 1)
            self.rest = b""


def _headers(source: Members) -> dict[str, str] | None:
    line = source.line()
    while line is not None and not line.strip():
        line = source.line()
    if line is None:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found = {}
    while (line := (source.line() or b"").strip()):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def read_records(raw, zipped: bool, wanted=lambda columns: True, payload: str = "check") -> Iterator[dict]:
    """Records of one file; a block is passed over unread if ``wanted`` says no to the header columns."""
    source = Members(raw, zipped)
    while (head := _headers(source)) is not None:
        row = {c: head.get(h) for c, h in HEADER_COLUMNS.items()}
        row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
        length = int(head["content-length"])
        if not wanted(row):
            source.skip(length)
            continue
        row["payload"] = None
        said = None
        if head.get("content-type", "").startswith("application/http"):
            while length > 0:
                line = source.line()
                if line is None or len(line) > length:
                    raise ValueError(f"the block of {row['record_id']} ends within its header")
                length -= len(line)
                name, _, value = line.decode("latin-1").partition(":")
                if name.strip().lower() == "content-length":
                    said = int(value)
                if not line.strip():
                    break
        row["payload_bytes"] = said if row["record_type"] == "revisit" else length
        if row["record_type"] == "response" and payload != "skip":
            body = source.take(length)
            if row["payload_digest"] and digest(body) != row["payload_digest"]:
                raise ValueError(f"payload of {row['record_id']} does not match its digest")
            row["payload"] = body if payload == "bytes" else None
        else:
            source.skip(length)
        yield row


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "check")
        self.files = json.loads(options["files"]) if "files" in options else None
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.equal = [(c, tuple(v)) for c, v in json.loads(options.get("where", "{}")).items()]
        if bad := {c for c, _ in self.equal} - set(HEADER_COLUMNS):
            raise ValueError(f"no header columns: {sorted(bad)}")

    def partitions(self) -> list[Files]:
        if self.files is None:
            store, path = _store(self.path)
            found = store.get_file_info(fs.FileSelector(path, recursive=True))
            sized = [(x.path, x.size) for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz"))]
        else:
            sized = [tuple(x) for x in self.files]
        bins: list[list[str]] = []
        room = 0
        for name, size in sorted(sized):
            if size > room or not bins:
                bins.append([])
                room = self.partition_bytes
            bins[-1].append(name)
            room -= size
        return [Files(b) for b in bins] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        wanted = lambda row: all(row[c] in values for c, values in self.equal)
        rows, size = [], 0
        for name in partition.names:
            with store.open_input_file(name) as raw:
                for row in read_records(raw, name.endswith(".gz"), wanted, self.payload):
                    rows.append(row | {"file": name})
                    size += len(row["payload"] or b"") + 200
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
        yield batch(rows)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, folder: str, payload: str = "check", manifest: DataFrame | None = None, where: dict[str, list[str]] | None = None) -> DataFrame:
    """The records of an archive.

    manifest: the files that belong to it; one row for each reaches the driver,
    as for any listing. where: header columns and the values wanted.
    """
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("path", folder).option("payload", payload).option("where", json.dumps(where or {}))
    if manifest is not None:
        if where and "record_type" in where:
            manifest = manifest.where(F.col("record_type").isin(*where["record_type"]))
        reader = reader.option("files", json.dumps([(r["file"], r["bytes"]) for r in manifest.select("file", "bytes").collect()]))
    return reader.load()


def page_number(urn) -> Column:
    return F.regexp_extract(urn, rf"^<{URN}(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the pages to an archive in the shared folder and read it back: id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    manifest = write_warc(pages, folder, id_col, url_col, payload_col, least_bytes)
    # A revisit has no payload to check: its header says all there is.
    rows = read_warc(spark, folder, "check", manifest, {"record_type": ["response"]}).unionByName(read_warc(spark, folder, "skip", manifest, {"record_type": ["revisit"]}))
    return rows.select(page_number(F.col("record_id")).alias("id"), "payload_bytes", "payload_digest", "record_type", page_number(F.col("refers_to")).alias("refers_to"), "target_uri")
