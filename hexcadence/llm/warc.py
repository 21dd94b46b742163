"""WARC archives: written by Spark's text sink, read by a Python data source that skips unwanted payloads."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from hexcadence.llm.base import named, stored

MIN_REVISIT_BYTES = 1000
SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, payload_digest string, "
    "content_type string, content_length bigint, payload_length bigint, payload binary"
)
# Header names of the format, and the columns that show them.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "refers_to": "warc-refers-to",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_READ = 1 << 20
_BATCH = 8 << 20  #: bytes of payload handed on at once


# --- writing ----------------------------------------------------------------------------------------


def _header_value(value: Column) -> Column:
    """A header's text: line ends would end the header, so control characters become their percent codes."""
    return F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")


def _record_id(key: Column) -> Column:
    """A URI that gives a row's key back."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def page_key(record_id: Column) -> Column:
    digits = F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(digits != "", digits).cast("bigint")


def planned(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """Rows with key, url, payload, length, digest, and the response (if any) that a row revisits.

    Of rows with equal payloads of at least MIN_REVISIT_BYTES the one with the largest key is the response; the
    others refer to it. Null keys are smallest. Rows that repeat the largest key are all responses, as are all rows of
    a payload that has null keys only. Digests that occur once are not joined back; the others come from a written
    table, so the planner broadcasts it only if its file is small, and adaptive execution splits a frequent payload.
    """
    body = F.coalesce(named(payload), F.lit(""))
    rows = pages.select(
        named(key).cast("bigint").alias("key"),
        named(url).cast("string").alias("url"),
        body.alias("payload"),
        F.octet_length(body).cast("bigint").alias("length"),
        F.sha1(body.cast("binary")).alias("digest"),
    )
    shared = stored(
        rows.where(F.col("length") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("first"))
        .where("n > 1")
        .select("digest", "first"),
        "payloads",
    )
    own = F.col("first").isNull() | F.col("key").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").withColumn("revisits", F.when(~own, F.col("first"))).drop("first")


def text_records(rows: DataFrame, date: str) -> DataFrame:
    """One string per record: WARC headers, HTTP headers, and the payload unless the record is a revisit."""
    revisit = F.col("revisits").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        F.col("length").cast("string"),
        F.lit("\r\n\r\n"),
    )
    target = F.when(
        F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), _header_value(F.col("url")), F.lit("\r\n"))
    ).otherwise("")
    refers = F.when(
        revisit,
        F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            _record_id(F.col("revisits")),
            F.lit("\r\n"),
        ),
    ).otherwise("")
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("length"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        _record_id(F.col("key")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\n"),
        target,
        refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        block.cast("string"),
        F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write a record for each row into part files of WARC records under ``path``, on any file system of Spark.

    A record ends with CRLF CRLF, which is the sink's line separator. Null payloads are empty, null urls have no
    target header, other columns are not read. Record ids carry the key, so they are unique if the key is. Rows stay
    in their partitions unless the table of shared payloads is too large to be broadcast.
    """
    text_records(planned(pages, key, url, payload), date).write.option("lineSep", "\r\n\r\n").text(path)


# --- reading ----------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    """Archives that one task reads."""

    paths: tuple[str, ...]


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


class WarcReader(DataSourceReader):
    """Plans file partitions, and reads headers first: the block of a record that no filter wants is skipped."""

    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.target_bytes = int(options.get("partitionBytes", 64 << 20))
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes tests of header columns for a value, a list of values, a prefix or presence."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((column, "in", frozenset([f.value])))
            elif isinstance(f, In):
                self.wanted.append((column, "in", frozenset(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.wanted.append((column, "present", None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files in groups of about ``partitionBytes``; a larger file stands alone."""
        from pyarrow import fs

        system, root = _system(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        groups, held, size = [], [], 0
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if held and size + f.size > self.target_bytes:
                groups.append(Files(tuple(held)))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        if held:
            groups.append(Files(tuple(held)))
        return groups or [Files(())]

    def _keep(self, row: dict) -> bool:
        for column, test, value in self.wanted:
            x = row[column]
            if x is None or (test == "in" and x not in value) or (test == "starts" and not x.startswith(value)):
                return False
        return True

    def read(self, partition: Files):
        system, _ = _system(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as f:
                for row in self._records(_Bytes(f), path):
                    rows.append(row)
                    held += 200 + len(row[-1] or b"")
                    if held > _BATCH:
                        yield _as_batch(rows)
                        rows, held = [], 0
        if rows:
            yield _as_batch(rows)

    def _records(self, data: _Bytes, path: str) -> Iterator[tuple]:
        while (line := data.line()) is not None:
            if not line.strip():
                continue
            if not _VERSION.fullmatch(line):
                raise ValueError(f"{path}: no WARC record at byte {data.at - len(line)}")
            headers = data.headers()
            length = int(headers["content-length"])
            row = {c: headers.get(h) for c, h in HEADERS.items()}
            digest = row["payload_digest"]
            row["payload_digest"] = digest.partition(":")[2].lower() if digest else None
            if not self._keep(row):
                data.skip(length)
                continue
            end = data.at + length
            full = length
            if (row["content_type"] or "").startswith("application/http"):
                data.line()  # the status line
                http = data.headers()
                full = int(http.get("content-length", end - data.at))
            payload = None
            if self.with_payload and row["record_type"] != "revisit":
                payload = data.take(end - data.at)
            data.skip(end - data.at)
            yield (*row.values(), length, full, payload)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * len(HEADERS) + [pa.int64(), pa.int64(), pa.binary()]
    names = [*HEADERS, "content_length", "payload_length", "payload"]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class _Bytes:
    """A file read forward in blocks, by lines and by counts; skipping far seeks instead of reading."""

    def __init__(self, file):
        self.file, self.held, self.pos, self.at = file, b"", 0, 0

    def _more(self) -> bool:
        block = self.file.read(_READ)
        self.held, self.pos = self.held[self.pos :] + block, 0
        return bool(block)

    def line(self) -> bytes | None:
        while (i := self.held.find(b"\n", self.pos)) < 0:
            if not self._more():
                i = len(self.held) - 1
                break
        if i < self.pos:
            return None
        out = self.held[self.pos : i + 1]
        self.pos, self.at = i + 1, self.at + len(out)
        return out

    def headers(self) -> dict[str, str]:
        out, last = {}, None
        while (line := self.line()) is not None and line.strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and last:
                out[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
        return out

    def take(self, n: int) -> bytes:
        parts = []
        while n > 0:
            part = self.held[self.pos : self.pos + n]
            parts.append(part)
            self.pos, self.at, n = self.pos + len(part), self.at + len(part), n - len(part)
            if n > 0 and not self._more():
                raise ValueError("a record is cut short")
        return b"".join(parts)

    def skip(self, n: int) -> None:
        here = min(n, len(self.held) - self.pos)
        self.pos, self.at = self.pos + here, self.at + here
        if n > here:
            self.at += n - here
            self.held, self.pos = b"", 0
            self.file.seek(self.at)


class WarcSource(DataSource):
    """``spark.read.format("warc")``: options path, payload (true), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records under ``path``. Filters on header columns reach the reader, which then skips other records' blocks.

    The path must be one that every executor can open (a shared mount, or an object store or HDFS known to Arrow).
    ``payload=False`` reads headers alone. Revisits have no payload. payload_length is that of the full payload.
    Broken records raise an error; an empty folder gives no rows.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
