"""WARC archives: writing, normalising monolithic gzip files, and reading by index.

``write_archives`` deals pages to tasks; each task streams its records into
whole-file gzip archives (one gzip stream for all records). ``normalise`` turns
such archives into archives that can be read at random: the whole stream is
inflated once, each record is deflated again as a gzip member of its own, and a
sidecar index (one line per record: offset, length, record id, type) is written
beside it. ``read_archives`` seeks by that index.

Files lie in the shared folder and are named by task attempt; a manifest of
those that were finished is written as a table before it is used, so a task that
is run again, or twice, leaves no doubt about which files count. A task holds
one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulant.llm.common import fresh_path, materialise

#: A revisit is written for copies of payloads of at least so many bytes.
MIN_REVISIT_BYTES = 0
#: A task begins another archive beyond so many uncompressed bytes.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
GZIP_BITS = 31

_MANIFEST = "archive string, index string, records long"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long, payload binary"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return None if number in ("", "null") else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, kind: str) -> bytes:
    """One WARC record. A revisit has the HTTP header alone, which keeps the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: What stands unescaped in a URI header; all else, line ends included, is percent-encoded.
_URL_SAFE = "!#$%&'()*+,/:;=?@[]~"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


class Records:
    """Cuts a stream of inflated bytes into whole WARC records."""

    def __init__(self) -> None:
        self._held = bytearray()
        self._need = 0  # length of the record at the front, once its header is there

    def feed(self, data: bytes) -> Iterator[bytes]:
        self._held += data
        while True:
            if not self._need:
                end = self._held.find(b"\r\n\r\n")
                if end < 0:
                    return
                self._need = end + 4 + int(headers(bytes(self._held[:end]))["content-length"]) + 4
            if len(self._held) < self._need:
                return
            yield bytes(self._held[: self._need])
            del self._held[: self._need]
            self._need = 0

    def close(self) -> None:
        if self._held:
            raise ValueError(f"the archive ends within a record: {len(self._held)} bytes are left")


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces of bounded size."""
    engine, fed = zlib.decompressobj(GZIP_BITS), False
    while waiting := stream.read(CHUNK):
        while waiting:
            fed = True
            yield engine.decompress(waiting, CHUNK)
            if engine.eof:
                waiting, engine, fed = engine.unused_data, zlib.decompressobj(GZIP_BITS), False
            else:
                waiting = engine.unconsumed_tail
    if fed:
        yield engine.flush()
        if not engine.eof:
            raise ValueError("the gzip stream is cut short")


class _File:
    """A file that gets its own name only once it is complete."""

    def __init__(self, files, path: str):
        self._files, self.path = files, path
        self._part = f"{path}.part"
        self._out = files.open_output_stream(self._part, compression=None)
        self.write = self._out.write

    def close(self) -> None:
        self._out.close()
        self._files.move(self._part, self.path)


def _unique() -> str:
    c = TaskContext.get()
    return f"{c.partitionId():06d}-{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        done: list[tuple[str, str, int]] = []
        out = None
        for batch in batches:
            for page_id, url, html, refers_to, kind in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "kind"))):
                if out is None:
                    out, engine, size, n = _File(files, f"{base}/raw-{_unique()}.warc.gz"), zlib.compressobj(6, zlib.DEFLATED, GZIP_BITS), 0, 0
                data = record(page_id, url, (html or "").encode(), refers_to, kind)
                out.write(engine.compress(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.write(engine.flush())
                    out.close()
                    done.append((out.path, "", n))
                    out = None
        if out is not None:
            out.write(engine.flush())
            out.close()
            done.append((out.path, "", n))
        yield _manifest_batch(done)

    return run


def _manifest_batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["archive", "index", "records"])


def _normaliser(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                name = f"{base}/members-{_unique()}.warc.gz"
                out, index = _File(files, name), _File(files, f"{name}.idx")
                cut, at, n = Records(), 0, 0
                with files.open_input_stream(source, compression=None) as stream:
                    for data in inflate(stream):
                        for one in cut.feed(data):
                            engine = zlib.compressobj(6, zlib.DEFLATED, GZIP_BITS)
                            member = engine.compress(one) + engine.flush()
                            head = headers(one[: one.index(b"\r\n\r\n")])
                            out.write(member)
                            index.write(f"{at} {len(member)} {head['warc-record-id']} {head['warc-type']}\n".encode())
                            at, n = at + len(member), n + 1
                cut.close()
                out.close()
                index.close()
                yield _manifest_batch([(name, f"{name}.idx", n)])

    return run


def _reader(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist()):
                rows, held = [], 0
                with files.open_input_stream(index, compression=None) as side:
                    lines = side.read().decode().splitlines()
                with files.open_input_file(archive) as stream:
                    for line in lines:
                        at, length = map(int, line.split(" ", 2)[:2])
                        stream.seek(at)
                        one = zlib.decompress(stream.read(length), GZIP_BITS)
                        rows.append(_parsed(one, archive, at, payloads))
                        held += len(one) if payloads else 300
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _parsed(one: bytes, archive: str, at: int, payloads: bool) -> tuple:
    end = one.index(b"\r\n\r\n")
    head = headers(one[:end])
    block = one[end + 4 : end + 4 + int(head["content-length"])]
    split = block.index(b"\r\n\r\n")
    http, payload = headers(block[:split]), block[split + 4 :]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    kind = head["warc-type"]
    if kind == "response" and (digest_of(payload) != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"the payload of {head['warc-record-id']} in {archive} is damaged")
    refers_to = _page(head.get("warc-refers-to"))
    return _page(head["warc-record-id"]), int(http["content-length"]), digest, kind, refers_to, head.get("warc-target-uri"), archive, at, payload if payloads and kind == "response" else None


def with_roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, refers_to, kind.

    Payloads are equal when their SHA-256 and lengths are; only these keys are
    grouped, and pages meet the groups' winners in a join that adaptive execution
    can split at a hot payload.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"_sha": F.sha2("html", 256), "_n": F.octet_length("html")})
    won = materialise(rows.groupBy("_sha", "_n").agg(F.max("page_id").alias("_winner")), "warc-winners")
    again = (F.col("_n") >= min_bytes) & F.col("_winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_winner"))
    joined = rows.join(won, ["_sha", "_n"])
    return joined.select("page_id", "url", "html", F.when(again, F.col("_winner")).alias("refers_to"), F.when(again, "revisit").otherwise("response").alias("kind"))


def _listed(files_written: DataFrame) -> DataFrame:
    """The manifest, one archive per task."""
    kept = materialise(files_written, "warc-manifest")
    n = kept.count()
    return kept.repartition(max(1, min(n, 100_000)))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` as monolithic archives in ``folder``; returns their manifest.

    Null html is an empty payload. Of equal payloads the row with the largest
    id is the response and the others revisit it; rows that repeat this id are
    responses too, null ids revisit unless all are null. An empty table writes nothing.
    """
    _make(folder)
    return _listed(with_roles(pages, id_col, url_col, html_col).mapInArrow(_writer(folder, archive_bytes), _MANIFEST))


def _make(folder: str) -> None:
    files, base = _filesystem(folder)
    files.create_dir(base, recursive=True)


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive of ``manifest`` with one gzip member per record and a sidecar index."""
    _make(folder)
    return _listed(manifest.mapInArrow(_normaliser(folder), _MANIFEST))


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record, read by the sidecar index; payloads only on demand."""
    return manifest.mapInArrow(_reader(folder, payloads), _READ)


def warc_round_trip(pages: DataFrame, spark: SparkSession, **columns: str) -> DataFrame:
    """Writes, normalises and reads back: the records of all pages."""
    top = fresh_path(spark, "warc")
    raw, members = f"{top}/raw", f"{top}/members"
    normal = normalise(write_archives(pages, raw, **columns), members)
    files, base = _filesystem(raw)
    files.delete_dir(base)  # the normalised archives are complete and listed
    return read_archives(normal, members)
