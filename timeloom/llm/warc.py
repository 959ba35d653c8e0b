"""WARC files as a PySpark data source: reading with pushed-down header predicates, writing with revisit records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import bounded, cut, own_path

SCHEMA = "record_id string, record_type string, target_uri string, record_date string, payload_digest string, refers_to string, content_length bigint, payload_length bigint, payload binary"
#: Record header behind each column that a predicate can be pushed to.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "record_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: Bytes after which a writer begins a new file, and files in one reading task at most by size.
ROLL, PLAN = 64 << 20, 64 << 20
DATE = "2000-01-01T00:00:00Z"


def is_manifest(name: str) -> bool:
    """Each commit writes a manifest-<id>.json; a folder of older writes has one manifest.json."""
    return name == "manifest.json" or (name.startswith("manifest-") and name.endswith(".json"))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Files(InputPartition):
    files: list


def _lines(block: bytes) -> dict[str, str]:
    pairs = (x.partition(b":") for x in block.split(b"\r\n")[1:] if b":" in x)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


class Records:
    """The records of one file, read as it is uncompressed; payloads are read only if asked for."""

    def __init__(self, file):
        self.file, self.held = file, b""

    def _head(self) -> bytes | None:
        """Bytes up to the empty line, without it; None at the end of the file."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            more = self.file.read(1 << 16)
            if not more:
                return None
            self.held += more
        head, self.held = self.held[:end], self.held[end + 4 :]
        return head

    def _take(self, n: int) -> bytes:
        while len(self.held) < n:
            more = self.file.read(max(n - len(self.held), 1 << 16))
            if not more:
                raise ValueError("a record is cut short")
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out

    def _skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.file.seek(self.file.tell() + n - len(self.held))
            self.held = b""

    def __iter__(self) -> Iterator[tuple[dict[str, str], object]]:
        """(headers, read): read() gives the block; a block that is not read is passed over without being decoded."""
        while True:
            while not (rest := self.held.lstrip(b"\r\n")):
                self.held = self.file.read(1 << 16)
                if not self.held:
                    return
            self.held = rest
            head = self._head()
            if head is None:
                raise ValueError("a record header is cut short")
            if not head.startswith(b"WARC/"):
                raise ValueError("no WARC record where one should begin")
            headers = _lines(head)
            left = [int(headers["content-length"])]

            def read() -> bytes:
                n, left[0] = left[0], 0
                return self._take(n)

            yield headers, read
            self._skip(left[0])


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.options = options["path"], options
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and IN on header columns are decided on headers alone; all other filters are left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in HEADERS and None not in values:
                self.wanted.append((HEADERS[f.attribute[0]], values))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, put together up to PLAN bytes a task; with manifests only the files that one of them names."""
        where, path = _open(self.path)
        found = where.get_file_info(fs.FileSelector(path, recursive=True)) if where.get_file_info(path).type == fs.FileType.Directory else [where.get_file_info(path)]
        lists = [json.loads(where.open_input_stream(x.path).read()) for x in found if is_manifest(x.base_name)]
        names = set().union(*lists) if lists else None
        found = sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and (names is None or x.base_name in names))
        out, held, total = [], [], 0
        for name, size in found:
            if held and total + size > PLAN:
                out.append(Files(held))
                held, total = [], 0
            held.append(name)
            total += size
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = _open(self.path)
        payloads = self.options.get("payload", "true") == "true"
        arrow = pa.schema([(x.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in SCHEMA.split(", ")])
        rows, size = [], 0
        for name in partition.files:
            with where.open_input_file(name) as file:
                # the members of a compressed file are read as one
                for headers, block in Records(gzip.GzipFile(fileobj=file) if name.endswith(".gz") else file):
                    if not all(headers.get(k, "").removeprefix("sha1:" if k == "warc-payload-digest" else "") in v for k, v in self.wanted):
                        continue
                    kind, length, payload = headers.get("warc-type"), int(headers["content-length"]), None
                    inner, payload_length = b"", None
                    if headers.get("content-type", "").startswith("application/http") and (payloads or kind == "revisit"):
                        inner, _, payload = block().partition(b"\r\n\r\n")
                        payload_length = int(_lines(inner).get("content-length", len(payload)))
                        payload = None if kind == "revisit" else payload
                    elif payloads:
                        payload = block()
                        payload_length = len(payload)
                    rows.append((headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, headers.get("warc-refers-to"), length, payload_length, payload))
                    size += len(payload or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), arrow)], schema=arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), arrow)], schema=arrow)


def record(kind: str, record_id: str, uri: str, digest: str, length: int, payload: bytes, refers_to: str | None) -> bytes:
    """One record; a revisit holds the HTTP header only, with the full payload's length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (b"" if kind == "revisit" else payload)
    clean = " ".join((uri or "").split())
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceWriter):
    """Rows (record_id, record_type, target_uri, payload_digest, refers_to, payload_length, payload) as files of records.

    Each attempt of a task writes files of its own names; commit() lists those of the attempts that counted in a manifest
    of its own, so lost and repeated attempts leave no records behind and what stood there before stays. Overwriting drops
    the manifests before it.
    """

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> Written:
        where, path = _open(self.path)
        where.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        try:
            for r in rows:
                if out is None or size > ROLL:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc")
                    out, size = where.open_output_stream(f"{path}/{names[-1]}"), 0
                data = record(r["record_type"], r["record_id"], r["target_uri"], r["payload_digest"], r["payload_length"], bytes(r["payload"] or b""), r["refers_to"])
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        where, path = _open(self.path)
        where.create_dir(path, recursive=True)
        before = [x.path for x in where.get_file_info(fs.FileSelector(path, recursive=True)) if is_manifest(x.base_name)]
        with where.open_output_stream(f"{path}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())
        for name in before if self.overwrite else []:
            where.delete_file(name)

    def abort(self, messages: list) -> None:
        """Without a manifest entry the files of an aborted write are never read."""


class WarcSource(DataSource):
    """Format ``warc``. Options: path (any filesystem URI), payload (false: payloads are not read)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def _sha1_base32(hexa: Column) -> Column:
    """Base32 of a SHA-1 given in hex: five hex digits are four digits of base 32, in another alphabet."""
    groups = [F.lpad(F.conv(F.substring(hexa, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_id_of(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("bigint")


def records_of(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The record of each page (page_id, url, html): of equal payloads of at least ``min_bytes`` bytes the one with the
    largest page_id is a response, the others are revisits of it; all other records are responses.

    Null html counts as empty; pages of one page_id and equal payload are all responses; a null page_id is a response of
    the record id 0-null that others never refer to. Extra columns are dropped. Only digests and ids are
    aggregated; the list of repeated payloads is broadcast if it is short, so that payloads are shuffled only for a long one.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    x = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"))
    x = x.withColumns({"payload_digest": _sha1_base32(F.sha1("payload")), "payload_length": F.length("payload").cast("long")})
    last = pages.select("page_id", _sha1_base32(F.sha1(payload)).alias("digest"), F.length(payload).alias("bytes")).filter(F.col("bytes") >= min_bytes)
    last = last.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null").select("digest", "last")
    x = x.join(bounded(cut(last)), (F.col("payload_digest") == F.col("digest")) & (F.col("payload_length") >= min_bytes), "left")
    again = F.col("last").isNotNull() & (F.col("page_id") < F.col("last"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return x.select(
        urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.coalesce("target_uri", F.lit("")).alias("target_uri"),
        "payload_digest", F.when(again, urn(F.col("last"))).alias("refers_to"), "payload_length", F.when(~again, F.col("payload")).alias("payload"),
    )


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters handed to Python readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    register(pages.sparkSession)
    records_of(pages, min_bytes).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """All responses with and all revisits without reading their blocks' payloads, by two reads with pushed-down record types."""
    kinds = [read(spark, path).filter("record_type = 'response'"), read(spark, path, payload=False).filter("record_type = 'revisit'")]
    return kinds[0].unionByName(kinds[1])


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: what the written archives say, payloads checked."""
    spark = pages.sparkSession
    path = own_path(spark, "warc")
    write_pages(pages, path, min_bytes)
    x = records(spark, path)
    digest = F.when(F.col("payload").isNotNull(), _sha1_base32(F.sha1("payload"))).otherwise(F.col("payload_digest"))
    whole = F.when(F.col("payload").isNotNull(), F.length("payload").cast("long")).otherwise(F.col("payload_length"))
    return x.select(page_id_of(F.col("record_id")).alias("page_id"), whole.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page_id_of(F.col("refers_to")).alias("refers_to"))
