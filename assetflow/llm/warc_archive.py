"""WARC archives as a Spark data source (operator 12).

``spark.write.format("warc")`` writes one gzip member per record (WARC/1.1), a
``warcinfo`` record first in every file.  Tasks write below ``_staging``; the commit
moves the files of the successful attempts, so retried or doubled tasks leave
nothing behind.  Files end after ``max_bytes``.

``spark.read.format("warc")`` reads each file sequentially, a file per task: bytes
are inflated in pieces, the header ends at the first empty line, ``Content-Length``
bytes follow, then two line ends and the end of the member.  Block and payload
digests are recomputed.  A record that is broken comes with a ``problem``; after
damage that hides where the next record begins the rest of the file is given up
and reported in one row.

Payloads that occur before are written as ``revisit`` records without payload
(profile identical-payload-digest).  Paths are anything pyarrow opens.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from assetflow.llm.common import materialise
from assetflow.session import scratch_folder

REVISIT_BYTES = 1000                 # smaller payloads are never revisits
MAX_BYTES = 1 << 30
LEVEL = 6
SALT = 8                             # a hot payload's rows are dealt over so many join partitions
_CHUNK, _SEND, _HEADER = 1 << 16, 8 << 20, 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, "
          "refers_to long, file string, offset long, problem string")
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _member(kind: str, ident: str, block: bytes, date: str, content_type: str, more: dict[str, str | None]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": date, **more, "WARC-Block-Digest": _sha1(block),
            "Content-Type": content_type, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{lines}\r\n".encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id, url, payload: bytes, digest: str, refers_to, kind: str, date: str) -> bytes:
    """One gzip member; control characters of the URL are percent-encoded, ``digest`` is hexadecimal SHA-1."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = None if url is None else re.sub(r"[\x00-\x1f\x7f]|^ | $", lambda m: f"%{ord(m[0]):02X}", url)
    more = {"WARC-Target-URI": target, "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()}
    if kind == "revisit":
        more |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(refers_to)}
    return _member(kind, record_id(page_id), http if kind == "revisit" else http + payload, date, "application/http; msgtype=response", more)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.date = options.get("date", datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))

    def write(self, iterator):
        fs, path = open_path(self.path)
        fs.create_dir(f"{path}/_staging", recursive=True)
        files, out = [], None
        try:
            for batch in iterator:
                cols = [batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "payload_digest", "refers_to", "record_type")]
                for page_id, url, payload, digest, refers_to, kind in zip(*cols):
                    if out is None or out.tell() >= self.max_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"pages-{uuid.uuid4().hex}.warc.gz")
                        out = fs.open_output_stream(f"{path}/_staging/{files[-1]}", compression=None)
                        info = f"software: assetflow\r\nformat: WARC File Format 1.1\r\nfilename: {files[-1]}\r\n".encode()
                        out.write(_member("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", info, self.date, "application/warc-fields", {}))
                    out.write(page_record(page_id, url, payload, digest, refers_to, kind, self.date))
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages):
        fs, path = open_path(self.path)
        fs.create_dir(path, recursive=True)
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{path}/_staging/{name}", f"{path}/{name}")
        self._clear(fs, path)

    def abort(self, messages):
        self._clear(*open_path(self.path))

    @staticmethod
    def _clear(fs, path):
        if fs.get_file_info(f"{path}/_staging").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/_staging")


class Broken(Exception):
    pass


class Members:
    """Sequential bytes of gzip members, inflated in pieces of bounded size."""

    def __init__(self, stream):
        self.stream, self.raw, self.taken = stream, b"", 0
        self.z, self.data = None, bytearray()

    def next_member(self) -> bool:
        """Begin the next member; False at the end of the file."""
        self.data.clear()
        self.z = zlib.decompressobj(31)
        return self._feed()

    @property
    def offset(self) -> int:
        return self.taken - len(self.raw)

    def _feed(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(_CHUNK)
            self.taken += len(self.raw)
        return bool(self.raw)

    def _pull(self) -> bool:
        """Inflate some more of the member; False at its end."""
        while not self.z.eof:
            if not self._feed():
                raise Broken("file ends inside a record")
            try:
                piece = self.z.decompress(self.raw, _CHUNK)
            except zlib.error as e:
                raise Broken(f"corrupt member: {e}") from None
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if piece:
                self.data += piece
                return True
        return False

    def until(self, mark: bytes, limit: int) -> bytes:
        at = self.data.find(mark)
        while at < 0:
            seen = max(0, len(self.data) - len(mark))
            if len(self.data) > limit or not self._pull():
                raise Broken("no end of header")
            at = self.data.find(mark, seen)
        out = bytes(self.data[:at])
        del self.data[:at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self._pull():
                raise Broken("record shorter than its Content-Length")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def rest(self) -> bytes:
        """What is left of the member, a few bytes unless it is broken."""
        out = bytearray(self.data)
        self.data.clear()
        while self._pull():
            out = (out + self.data)[:64]
            self.data.clear()
        return bytes(out)


def fields(lines: str) -> dict[str, str]:
    """Header fields with lower-case names; folded lines continue the one before."""
    out: dict[str, str] = {}
    last = None
    for line in lines.split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            out[last] = value[1:] if value[:1] == " " else value
    return out


def records(stream):
    """``(offset, header fields, block, problem)`` of every member of a gzip WARC stream."""
    source = Members(stream)
    while source.next_member():
        at, head, block, problem = source.offset, {}, b"", None
        try:
            first, _, lines = source.until(b"\r\n\r\n", _HEADER).decode("utf-8", "replace").partition("\r\n")
            head = fields(lines)
            if not first.startswith("WARC/"):
                problem = "no WARC record"
            elif not re.fullmatch(r"\d+", head.get("content-length", "")):
                problem = "no Content-Length"
            else:
                block = source.exactly(int(head["content-length"]))
            if source.rest() != b"\r\n\r\n" and not problem:
                problem = "record longer than its Content-Length"
        except Broken as e:
            yield at, head, block, str(e)
            if source.z.eof:
                continue                      # the member is whole: the next one begins behind it
            return
        if not problem and "warc-block-digest" in head and head["warc-block-digest"] != _sha1(block):
            problem = "block digest differs"
        yield at, head, block, problem


def page_row(head: dict[str, str], block: bytes, problem: str | None, keep: bool):
    """The first seven and the last column of SCHEMA."""
    http, mark, payload = block.partition(b"\r\n\r\n")
    said = fields(http.decode("utf-8", "replace")).get("content-length")
    kind, digest = head.get("warc-type"), head.get("warc-payload-digest")
    size = int(said) if said and re.fullmatch(r"\d+", said) else None
    if not problem and kind == "response":
        if not mark or size is not None and size != len(payload):
            problem = "payload length differs"
        elif digest is not None and digest != _sha1(payload):
            problem = "payload digest differs"
    hexed = None
    if digest and digest.startswith("sha1:"):
        try:
            hexed = base64.b32decode(digest[5:]).hex()
        except ValueError:
            problem = problem or "payload digest unreadable"
    revisit = kind == "revisit"
    return (_page(head.get("warc-record-id")), head.get("warc-target-uri"), kind, payload if keep and kind == "response" else None,
            size if revisit else len(payload) if kind == "response" else None, hexed, _page(head.get("warc-refers-to")) if revisit else None), problem


@dataclass
class _File(InputPartition):
    name: str


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.keep = options["path"].rstrip("/"), options.get("payload", "true").lower() == "true"

    def partitions(self):
        fs, path = open_path(self.path)
        infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return [_File(i.path) for i in sorted(infos, key=lambda i: i.path) if i.is_file and i.path.endswith(".warc.gz")] or [_File("")]

    def read(self, partition):
        if not partition.name:
            return
        fs, _ = open_path(self.path)
        rows, size = [], 0
        with fs.open_input_stream(partition.name, compression=None) as stream:
            for offset, head, block, problem in records(stream):
                if head.get("warc-type") not in ("response", "revisit") and not problem:
                    continue
                row, problem = page_row(head, block, problem, self.keep)
                rows.append((*row, partition.name, offset, problem))
                size += 256 + (len(block) if self.keep else 0)
                if size > _SEND:
                    yield self._batch(rows)
                    rows, size = [], 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * len(_TYPES), _TYPES)], names=_NAMES)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)``, one row per page.

    Of equal payloads of at least REVISIT_BYTES the rows with the largest id are responses, the others
    revisit them; rows that repeat that id and payload are all responses.  A null id is smaller than the
    rest; payloads without any id are all responses.  A null payload is empty.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    groups = (own.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest")
              .agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null"))
    groups = materialise(groups.select(F.col("payload_digest").alias("digest"), "top"), "warc-groups")
    dealt = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    copies = groups.withColumn("of", F.explode(F.array(*[F.lit(k) for k in range(SALT)])))
    met = dealt.join(copies, (F.col("payload_digest") == F.col("digest")) & (F.col("salt") == F.col("of")), "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return met.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                      F.when(revisit, F.col("top")).alias("refers_to"))


def write(found: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> None:
    """Write ``page_records`` as archives below ``path``, a shared folder."""
    found.sparkSession.dataSource.register(WarcSource)
    found.write.format("warc").option("path", path).option("max_bytes", max_bytes).mode("append").save()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Response and revisit records of the archives below ``path``, and rows with a ``problem`` for what cannot be read."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, problem)`` of ``pages``, written and read back.

    An empty table gives an empty result; ids and URLs may be null or repeat.
    """
    folder = scratch_folder(pages.sparkSession, "warc")
    write(page_records(pages, id_col, url_col, html_col), folder)
    return read(pages.sparkSession, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
