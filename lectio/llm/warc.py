"""WARC archives as a Spark data source (``warc``), and archives of web pages in which equal
payloads are stored once.

*Reading.*  The committed files are planned as partitions of about ``partitionBytes``; a file
with marked record starts is cut there.  A task parses a record's headers first.  Conditions on
header columns (record type, ids, digests, lengths, ...) are pushed down and judged on the
headers alone: the block of a record that fails them is skipped, by seeking where the file says
how long a record is, and no payload is decoded with ``payload=false``.

*Writing.*  Each record is its own gzip member (``compress=false``: plain), whose extra field
``sl`` holds the member's length, so a reader hops from record to record; any gzip reader
ignores that field.  A task writes files of about ``fileBytes`` under fresh names; the driver's
commit lists those of the successful attempts in ``_committed-*.json``.  A lost executor's
files are never listed and so never read.  Folders without such lists (archives from
elsewhere) are read file by file; ``.gz`` files hold one record a member, with or without ``sl``.

Paths are opened through pyarrow's file systems on driver and executors: a folder that all of them see.
Control characters in header values are percent-encoded.  Malformed records raise, naming the file and the position.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from ..operators.prep import join_by_key
from ..session import scratch_path
from .common import small_batches, written

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
CHUNK = 1 << 16
#: Header names of the format and their columns.
HEADERS = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Date": "warc_date", "WARC-Target-URI": "target_uri",
           "WARC-Payload-Digest": "payload_digest", "WARC-Refers-To": "refers_to", "Content-Type": "content_type"}
SCHEMA = ("record_type string, record_id string, warc_date string, target_uri string, payload_digest string, refers_to string, "
          "content_type string, content_length long, payload_length long, payload binary, file string, offset long")
ARROW = pa.schema([(c, pa.string()) for c in HEADERS.values()] + [("content_length", pa.int64()), ("payload_length", pa.int64()),
                                                                  ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"       # fixed value: profile of revisit records
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


# ---------------------------------------------------------------- files
def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it, of a plain path or a URI."""
    local = re.match(r"(?:file:(?://)?)?(/.*)", path)
    return (pafs.LocalFileSystem(), local[1]) if local else pafs.FileSystem.from_uri(path)


def committed_files(path: str) -> list[dict]:
    """Files of an archive: {file, bytes, starts}, where starts are offsets at which records begin."""
    fs, at = open_fs(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [{"file": at, "bytes": fs.get_file_info(at).size, "starts": [0]}]
    infos = [i for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File]
    lists = [i.path for i in infos if re.fullmatch(r"_committed-\w+\.json", i.base_name)]
    if lists:
        out = []
        for p in sorted(lists):
            with fs.open_input_stream(p) as f:
                out += [{**x, "file": f"{at.rstrip('/')}/{x['file']}"} for x in json.loads(f.read())]
        return out
    return [{"file": i.path, "bytes": i.size, "starts": [0]} for i in sorted(infos, key=lambda i: i.path) if re.search(r"\.warc(\.gz)?$", i.path)]


@dataclass
class Slices(D.InputPartition):
    """(file, first byte, byte after the last record) triples of one task."""
    parts: list = field(default_factory=list)


def plan(files: list[dict], partition_bytes: int) -> list[Slices]:
    """Cut files at their marked starts and pack the pieces, in order, into partitions."""
    out, now, held = [], [], 0
    for f in files:
        ends = [*f["starts"][1:], f["bytes"]]
        for start, end in zip(f["starts"], ends):
            if now and held + end - start > partition_bytes:
                out, now, held = [*out, Slices(now)], [], 0
            if now and now[-1][0] == f["file"] and now[-1][2] == start:
                now[-1] = (f["file"], now[-1][1], end)
            else:
                now.append((f["file"], start, end))
            held += end - start
    return [*out, Slices(now)] if now else out


# ---------------------------------------------------------------- records
class _Plain:
    """One uncompressed record's bytes from ``start``."""

    def __init__(self, f, start: int):
        self.f, self.at = f, start

    def more(self) -> bytes:
        self.f.seek(self.at)
        got = self.f.read(CHUNK)
        self.at += len(got)
        return got


class _Member:
    """One gzip member's inflated bytes; ``length`` of the member if its header says so."""

    def __init__(self, f, start: int):
        self.f, self.at, self.inflate, self.rest = f, start, zlib.decompressobj(31), b""
        f.seek(start)
        head = f.read(24)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError("no gzip member")
        self.length = int.from_bytes(head[16:20], "little") if head[3] & 4 and head[10:16] == b"\x0c\x00sl\x08\x00" else None

    def more(self) -> bytes:
        if self.inflate.eof:
            return b""
        data = self.inflate.unconsumed_tail
        if not data:
            self.f.seek(self.at)
            data = self.f.read(CHUNK)
            self.at += len(data)
            if not data:
                raise ValueError("cut gzip member")
        return self.inflate.decompress(data, CHUNK) or self.more()

    def end(self) -> int:
        """Position after the member, inflating what is left of it piece by piece."""
        while not self.inflate.eof:
            self.more()
        return self.at - len(self.inflate.unused_data)


def _until(source, data: bytes, mark: bytes, what: str) -> tuple[bytes, bytes]:
    at = data.find(mark)
    while at < 0:
        seen = max(0, len(data) - len(mark) + 1)
        got = source.more()
        if not got:
            raise ValueError(f"{what} without end")
        data += got
        at = data.find(mark, seen)
    return data[:at], data[at + len(mark):]


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:40]!r}")
        out.setdefault(name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip())
    return out


def records(f, start: int, end: int, gz: bool, wanted, payload: bool) -> Iterator[dict]:
    """Records of ``f`` from byte ``start`` up to ``end`` whose headers ``wanted`` accepts."""
    while start < end:
        try:
            source = _Member(f, start) if gz else _Plain(f, start)
            head, data = _until(source, b"", END, "record header")
            lines = head.lstrip(b"\r\n").split(b"\r\n")
            if not lines[0].startswith(b"WARC/"):
                raise ValueError("no WARC record")
            given = _fields(lines[1:])
            length = int(given["content-length"])
            row = {c: given.get(h.lower()) for h, c in HEADERS.items()}
            row |= {"content_length": length, "payload_length": length, "payload": None, "offset": start}
            http, http_head = (row["content_type"] or "").startswith("application/http"), 0
            if http and length:
                block, after = _until(source, data, END, "HTTP header")
                http_head = len(block) + len(END)
                row["payload_length"] = length - http_head
                if row["record_type"] == "revisit":
                    row["payload_length"] = int(_fields(block.split(b"\r\n")[1:]).get("content-length", length - http_head))
                data = after
            if wanted(row):
                if payload and row["record_type"] != "revisit":
                    parts, have = [data], len(data)
                    while have < length - http_head:
                        got = source.more()
                        if not got:
                            raise ValueError("cut block")
                        parts.append(got)
                        have += len(got)
                    row["payload"] = b"".join(parts)[:length - http_head]
                yield row
            if not gz:
                start += len(head) + len(END) + length + len(END)
            elif source.length:
                start += source.length
            else:
                start = source.end()
        except (ValueError, KeyError, zlib.error) as e:
            raise ValueError(f"malformed WARC record at byte {start}: {e}") from e


# ---------------------------------------------------------------- pushed conditions
_COMPARE = {D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b, D.LessThan: lambda a, b: a < b,
            D.LessThanOrEqual: lambda a, b: a <= b, D.EqualTo: lambda a, b: a == b, D.In: lambda a, b: a in b,
            D.StringStartsWith: lambda a, b: a.startswith(b), D.StringEndsWith: lambda a, b: a.endswith(b), D.StringContains: lambda a, b: b in a}
_ORDERED = (D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)
_KNOWN = {*HEADERS.values(), "content_length", "payload_length"}


def can_push(cond) -> bool:
    """Conditions on header columns.  Order of strings is left to Spark, which orders by bytes."""
    if isinstance(cond, D.Not):
        return can_push(cond.child)
    if not hasattr(cond, "attribute") or len(cond.attribute) != 1 or cond.attribute[0] not in _KNOWN:
        return False
    if isinstance(cond, _ORDERED):
        return not isinstance(cond.value, str)
    if isinstance(cond, D.In):
        return None not in cond.value
    return isinstance(cond, (D.EqualNullSafe, D.IsNull, D.IsNotNull, *_COMPARE))


def judge(cond, row: dict) -> bool | None:
    """SQL's three values: null where a comparison meets null."""
    if isinstance(cond, D.Not):
        got = judge(cond.child, row)
        return None if got is None else not got
    value = row[cond.attribute[0]]
    if isinstance(cond, D.IsNull):
        return value is None
    if isinstance(cond, D.IsNotNull):
        return value is not None
    if isinstance(cond, D.EqualNullSafe):
        return value == cond.value
    if value is None or (not isinstance(cond, D.In) and cond.value is None):
        return None
    return _COMPARE[type(cond)](value, cond.value)


# ---------------------------------------------------------------- data source
class WarcReader(D.DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        self.conditions = []

    def pushFilters(self, filters):
        for cond in filters:
            if can_push(cond):
                self.conditions.append(cond)
            else:
                yield cond

    def partitions(self):
        return plan(committed_files(self.path), self.partition_bytes) or [Slices([])]

    def read(self, partition):
        fs, _ = open_fs(self.path)
        wanted = lambda row: all(judge(c, row) for c in self.conditions)
        rows, held = [], 0
        for file, start, end in partition.parts:
            with fs.open_input_file(file) as f:
                try:
                    for row in records(f, start, end, file.endswith(".gz"), wanted, self.payload):
                        rows.append({**row, "file": file})
                        held += 500 + len(row["payload"] or b"")
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                            rows, held = [], 0
                except ValueError as e:
                    raise ValueError(f"{file}: {e}") from e
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


@dataclass
class Written(D.WriterCommitMessage):
    files: list


def record_bytes(row: dict) -> bytes:
    """One record: headers, then an HTTP head and the payload (revisits: the head alone)."""
    http = (row["content_type"] or "").startswith("application/http")
    payload = row["payload"] or b""
    length = len(payload) if row["payload"] is not None else row["payload_length"] or 0
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length if http else b""
    block += payload
    lines = [VERSION.decode()]
    for h, c in HEADERS.items():
        if row[c] is not None:
            lines.append(f"{h}: {_CONTROL.sub(lambda m: '%%%02X' % ord(m[0]), row[c])}")
        if h == "WARC-Type" and row[c] == "revisit":
            lines.append(f"WARC-Profile: {IDENTICAL}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + END + block + END


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``sl`` says its own length and the length inflated."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    length = 24 + len(body) + len(tail)
    return (b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00sl\x08\x00" + length.to_bytes(4, "little")
            + (len(data) & 0xFFFFFFFF).to_bytes(4, "little") + body + tail)


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"], overwrite
        self.compress, self.level = options.get("compress", "true").lower() != "false", int(options.get("level", 6))
        self.file_bytes, self.mark_bytes = int(options.get("fileBytes", 256 << 20)), int(options.get("markBytes", 16 << 20))

    def write(self, iterator):
        fs, at = open_fs(self.path)
        fs.create_dir(at, recursive=True)
        files, out = [], None
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = {c: v.as_py() for c, v in zip(batch.schema.names, (col[i] for col in batch.columns))}
                    data = record_bytes(row)
                    data = gzip_member(data, self.level) if self.compress else data
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.compress else ''}"
                        files.append({"file": name, "bytes": 0, "starts": [0]})
                        out = fs.open_output_stream(f"{at.rstrip('/')}/{name}", compression=None)
                    now = files[-1]
                    if now["bytes"] - now["starts"][-1] >= self.mark_bytes:
                        now["starts"].append(now["bytes"])
                    out.write(data)
                    now["bytes"] += len(data)
                    if now["bytes"] >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        fs, at = open_fs(self.path)
        fs.create_dir(at, recursive=True)
        folder = at.rstrip("/")
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File] if self.overwrite else []
        new = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{folder}/_committed-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(new).encode())
        kept = {f"{folder}/{f['file']}" for f in new}
        for p in old:
            if p not in kept:
                fs.delete_file(p)

    def abort(self, messages):
        fs, at = open_fs(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                fs.delete_file(f"{at.rstrip('/')}/{f['file']}")


class WarcDataSource(D.DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known and switch on pushdown to Python sources."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True, **options) -> DataFrame:
    """The records of an archive (columns of SCHEMA).  Filters on header columns reach the reader."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).options(**options).load(path)


def write_warc(rows: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write records: the columns of SCHEMA up to ``payload``; a null payload with a
    payload_length makes a revisit's block, the HTTP head alone."""
    register(rows.sparkSession)
    small_batches(rows.sparkSession)
    names = [*HEADERS.values(), "payload_length", "payload"]
    rows.select(*names).write.format("warc").mode(mode).options(**options).save(path)


# ---------------------------------------------------------------- pages
#: Payloads of so many bytes or more are stored once.
LEAST_BYTES = 100
ID = r"^<urn:page:(-?\d*):\d+>$"


def page_records(pages: DataFrame, date: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Records for ``pages`` (page_id, url, html): of equal payloads of ``least_bytes`` or more the one with the
    smallest page_id (null last; any one of repeated ids) is a response, the others revisits that
    refer to it; all others are responses.  Other columns are ignored, null html is empty."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.select("*", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest"),
                       F.monotonically_increasing_id().alias("row"))
    base = written(base, "warc-pages", "zstd")
    able = base.where(F.col("n_bytes") >= least_bytes)
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first")
    copies = able.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), least).where("copies > 1")
    copies = written(copies, "warc-copies")
    got = join_by_key(base, copies, ["digest"], "copies", base.count())
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))

    def urn(page, row):
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))

    return got.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id"), F.col("row")).alias("record_id"),
        F.lit(date).alias("warc_date"), F.col("url").alias("target_uri"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(revisit, urn(F.col("first.page_id"), F.col("first.row"))).alias("refers_to"),
        F.lit("application/http; msgtype=response").alias("content_type"), F.col("n_bytes").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def _page(urn: str):
    got = F.regexp_extract(urn, ID, 1)
    return F.when(got != "", got.cast("long"))


def archived_pages(archive: DataFrame) -> DataFrame:
    """The pages of a read archive: page_id, url, record_type, payload (responses), payload_bytes and payload_digest
    of the full payload, refers_to.  A response whose payload differs from its digest header raises."""
    claimed = F.regexp_replace("payload_digest", "^sha256:", "")
    found = F.sha2("payload", 256)
    digest = (F.when(F.col("record_type") == "revisit", claimed).when(found == claimed, found)
              .otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id"))))
    n = F.when(F.col("record_type") == "revisit", F.col("payload_length")).otherwise(F.octet_length("payload").cast("long"))
    return archive.select(_page("record_id").alias("page_id"), F.col("target_uri").alias("url"), "record_type", "payload",
                          n.alias("payload_bytes"), digest.alias("payload_digest"), _page("refers_to").alias("refers_to"))


def archive_pages(pages: DataFrame, path: str | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` as an archive (a fresh scratch folder without ``path``) and read it back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(page_records(pages, date), path)
    return archived_pages(read_warc(spark, path))
