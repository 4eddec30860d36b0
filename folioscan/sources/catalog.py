"""Local dump versions, and fetching newer ones."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable
from typing import BinaryIO, Protocol

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscan.functions import dump_file_name, dump_url, http_date_ms

#: Bytes that pass through the driver at once.
CHUNK = 1 << 20


class Fetcher(Protocol):
    def last_modified(self, lang: str) -> int: ...

    def open(self, lang: str) -> BinaryIO: ...


class HttpFetcher:
    """The published dumps over HTTP. The archive is kept compressed: Spark reads it in parallel."""

    suffix = ".xml.bz2"

    def __init__(self, url: Callable[[str], str] = dump_url, timeout: float = 60):
        self.url, self.timeout = url, timeout

    def last_modified(self, lang: str) -> int:
        ask = urllib.request.Request(self.url(lang), method="HEAD")
        with urllib.request.urlopen(ask, timeout=self.timeout) as answer:
            return http_date_ms(answer.headers["Last-Modified"])

    def open(self, lang: str) -> BinaryIO:
        return urllib.request.urlopen(self.url(lang), timeout=self.timeout)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def newest_local(spark: SparkSession, folder: str) -> tuple[str, int] | None:
    """(path, modification time in ms) of the newest file that is not empty; makes the folder if it is absent. Ties: the larger path."""
    fs, where, _ = _filesystem(spark, folder)
    if not fs.exists(where):
        fs.mkdirs(where)
        return None
    files = spark.read.format("binaryFile").load(folder).select("path", F.unix_millis("modificationTime").alias("ms"))
    best = files.agg(F.max_by("path", F.struct("ms", "path")).alias("path"), F.max("ms").alias("ms")).first()
    return (best["path"], best["ms"]) if best["path"] else None


def resolve_dump(spark: SparkSession, base: str, lang: str = "en", check_new: bool = True, fetcher: Fetcher | None = None) -> str:
    """The path of the dump to read from ``base/lang``.

    A local dump is used unless there is none, or ``check_new`` is set and the
    publisher's is newer; then ``fetcher`` brings that. Without a fetcher only
    local dumps count, and FileNotFoundError is raised if there is none.
    """
    folder = f"{base.rstrip('/')}/{lang}"  # made if it is absent
    local = newest_local(spark, folder)
    if fetcher is None or (local and not check_new):
        if not local:
            raise FileNotFoundError(f"no dump in {folder}")
        return local[0]
    remote = fetcher.last_modified(lang)
    if local and local[1] >= remote:
        return local[0]
    fs, _, jvm = _filesystem(spark, folder)
    target = f"{folder}/{dump_file_name(lang, remote, getattr(fetcher, 'suffix', '.xml'))}"
    part = jvm.org.apache.hadoop.fs.Path(f"{folder}/_incoming-{remote}")
    try:
        with fetcher.open(lang) as source:
            _copy(source, fs.create(part, True))
        if not fs.rename(part, jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"cannot move the fetched dump to {target}")
    finally:
        fs.delete(part, False)
    return target


def _copy(source: BinaryIO, out) -> None:
    """Into a Hadoop stream, chunk by chunk: nothing is kept on the driver's disk. A source that ends early raises."""
    try:
        said, n = getattr(source, "length", None), 0
        while data := source.read(CHUNK):
            out.write(data)
            n += len(data)
    finally:
        out.close()
    if said is not None and n != said:
        raise OSError(f"{n} of {said} bytes arrived")
