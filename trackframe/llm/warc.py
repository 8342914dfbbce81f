"""WARC archives with a two-level capture index.

write(): one WARC 1.1 record per page, each its own gzip member, one archive per task, in the
shared folder. A task names its archive by its attempt, and only archives named in the
committed capture table count, so lost and repeated tasks leave no doubles.

index(): captures sorted by reversed-host URL key go into compressed blocks of lines, one file
of blocks per range partition; a sparse directory holds each block's first key and place. It is
kept as a table and beside each file of blocks.

captures_of(): for each key the files are found among the files' first keys (one a file: what is
broadcast is bounded by the number of range partitions), the blocks by binary search in those files' directories. Requests are
then dealt by block: each block is read once, the only range read of the index, and the lines found by binary search in it.
So a key with a third of all captures is the work of many tasks.

read(): range-reads the records that captures name.

Defined cases: null html is an empty payload; a page without a URL has no target URI and an empty
key, control characters and spaces in URLs are percent-encoded in headers and keys; pages without an id are written under
an id of their own kind and read back as null, and never are what others refer to; of repeated rows with equal id and payload all are
responses or all revisits; extra columns are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import fresh, save, shuffle_width, table

SMALLEST = 100
BLOCK_LINES = 512
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "key string, page_id long, file string, offset long, length long, record_type string, digest string"
_BLOCK = "first string, file string, offset long, length long, lines int"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NO_ID = 1 << 64


def encoded(url: str) -> str:
    """The URL with control characters and spaces percent-encoded, so that it fits a header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.example.com:80/a?b#c is com,example,www)/a?b."""
    if not url:
        return ""
    rest = encoded(url).split("#", 1)[0]
    scheme, mark, tail = rest.partition("://")
    if not mark:
        scheme, tail = "", rest
    cut = min((i for i in (tail.find(c) for c in "/?") if i >= 0), default=len(tail))
    host, path = tail[:cut].rpartition("@")[2].lower(), tail[cut:]
    name, _, port = host.partition(":")
    if port in ("", "80" if scheme.lower() == "http" else "443" if scheme.lower() == "https" else ""):
        port = ""
    return ",".join(reversed(name.split("."))) + (":" + port if port else "") + ")" + (path if path.startswith("/") else "/" + path)


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_NO_ID if page_id is None else page_id & (_NO_ID - 1))}>"


def _page_id(urn: str) -> int | None:
    n = uuid.UUID(urn.strip("<>")[9:]).int
    if n & _NO_ID:
        return None
    return n - _NO_ID if n >> 63 else n


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One compressed record; a revisit has the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"\r\n" if revisit else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {encoded(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}", "", ""]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + http + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes | None]:
    """Headers and payload (None for a revisit) of one compressed record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, None if headers["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _writer(folder: str):
    def run(batches):
        task = TaskContext.get()
        store, path = _store(folder)
        name, out, at = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", None, 0
        for batch in batches:
            rows = []
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "first", "revisit")]
            for page_id, url, digest, first, revisit, payload in zip(*cols, K.texts(batch.column("html"))):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                member = record(page_id, url, payload, digest, first, revisit)
                out.write(member)
                rows.append((url_key(url), page_id, name, at, len(member), "revisit" if revisit else "response", digest))
                at += len(member)
            if rows:
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["key", "page_id", "file", "offset", "length", "record_type", "digest"])
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame, folder: str, smallest: int = SMALLEST) -> DataFrame:
    """Writes pages (page_id, url, html) as archives under folder; returns the capture table.

    Of pages with equal payloads of ``smallest`` bytes or more, that with the smallest id is
    the response and the others are revisits of it.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256))
    again = p.where(F.octet_length("html") >= smallest).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = again.where("n > 1 and first is not null").select("digest", "first")
    again = save(again, "again")  # written, so that Spark can split a skewed side of the join
    p = p.join(again, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    return save(p.mapInArrow(_writer(folder), _CAPTURE), "captures")


def _indexer(folder: str, block_lines: int):
    def run(batches):
        task = TaskContext.get()
        store, path = _store(folder)
        name, out, at, lines, blocks = f"{path}/index-{task.partitionId():06d}-{task.taskAttemptId()}.gz", None, 0, [], []

        def flush():
            nonlocal out, at, lines
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(name, compression=None)
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = z.compress("\n".join("\t".join(x) for x in lines).encode()) + z.flush()
            out.write(data)
            blocks.append((lines[0][0], name, at, len(data), len(lines)))
            at, lines = at + len(data), []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length", "record_type", "digest"))):
                lines.append(["" if x is None else str(x) for x in row])
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(name + ".dir", compression=None) as side:
                side.write("\n".join(f"{b[0]}\t{b[2]}\t{b[3]}" for b in blocks).encode())
            yield pa.record_batch([pa.array(c) for c in zip(*blocks)], names=["first", "file", "offset", "length", "lines"]).cast(
                pa.schema([("first", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int32())])
            )

    return run


def index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the blocks under folder; returns the sparse directory, a row per block."""
    width = shuffle_width(captures.sparkSession)
    ordered = captures.repartitionByRange(width, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return save(ordered.mapInArrow(_indexer(folder, block_lines), _BLOCK), "directory")


def _range(uri: str, path: str, offset: int, length: int) -> bytes:
    return _ranges(uri, path, [(offset, length)])[0]


def _ranges(uri: str, path: str, parts: list[tuple[int, int]]) -> list[bytes]:
    store, _ = _store(uri)
    found = []
    with store.open_input_file(path) as f:
        for offset, length in parts:
            f.seek(offset)
            data = f.read(length)
            if len(data) != length:
                raise OSError(f"{path} is too short")
            found.append(data)
    return found


def _block_lines(data: bytes) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(data, 31).decode().split("\n")]


def _reader(folder: str):
    def run(batches):
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            i = 0
            while i < len(files):
                j, size = i, 0
                while j < len(files) and files[j] == files[i] and size < 8 << 20:
                    size += lengths[j]
                    j += 1
                rows = []
                for member in _ranges(folder, files[i], list(zip(offsets[i:j], lengths[i:j]))):
                    head, payload = parse(member)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    refers, size_ = None, None
                    if payload is None:
                        refers = _page_id(head["WARC-Refers-To"])
                    else:
                        size_ = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError("a payload's digest is wrong")
                    rows.append((_page_id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size_, digest, head["WARC-Type"], refers))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                i = j

    return run


def read(captures: DataFrame, folder: str) -> DataFrame:
    """The records of the archives that captures (file, offset, length) name: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to. A revisit's size is that of the payload it refers to, if that is among them."""
    part = F.floor(F.col("offset") / (64 << 20))
    places = captures.select("file", "offset", "length").repartition(shuffle_width(captures.sparkSession), "file", part).sortWithinPartitions("file", "offset")
    r = save(places.mapInArrow(_reader(folder), _RECORD), "records")
    whole = r.where("record_type = 'response'").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("g"), F.col("payload_bytes").alias("b")).distinct()
    revisits = r.where("record_type = 'revisit'").join(whole, (F.col("refers_to") == F.col("p")) & (F.col("payload_digest") == F.col("g")), "left")
    return r.where("record_type = 'response'").unionByName(revisits.select("page_id", "url", F.col("b").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


@functools.lru_cache(maxsize=64)
def _directory(folder: str, path: str):
    store, _ = _store(folder)
    with store.open_input_file(path + ".dir") as f:
        rows = [x.split("\t") for x in f.read().decode().split("\n")]
    return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]


def _keyed(batches):
    for batch in batches:
        yield pa.record_batch([batch.column("url"), pa.array([url_key(x) for x in batch.column("url").to_pylist()], pa.string())], names=["url", "key"])


def _requested(folder: str, shared):
    """Keys to (key, file, offset, length) of the blocks that may hold them."""

    def blocks_of(key):
        firsts, paths = shared.value
        for f in range(max(0, bisect.bisect_left(firsts, key) - 1), len(paths)):
            if firsts[f] > key:
                return
            keys, places = _directory(folder, paths[f])
            for b in range(max(0, bisect.bisect_left(keys, key) - 1), len(keys)):
                if keys[b] > key:
                    break
                yield paths[f], *places[b]

    def run(batches):
        for batch in batches:
            rows = [(key, *x) for key in batch.column("key").to_pylist() for x in blocks_of(key)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, [pa.string(), pa.string(), pa.int64(), pa.int64()])], names=["key", "file", "offset", "length"])

    return run


def _captured(folder: str):
    """Requests sorted by block to the captures found."""

    def run(batches):
        place = own = lines = None
        for batch in batches:
            rows = []
            for key, *at in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length"))):
                if at != place:
                    place, lines = at, _block_lines(_range(folder, *at))
                    own = [x[0] for x in lines]
                for c in lines[bisect.bisect_left(own, key) : bisect.bisect_right(own, key)]:
                    rows.append((key, int(c[1]) if c[1] else None, c[2], int(c[3]), int(c[4]), c[5], c[6]))
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=["key", "page_id", "file", "offset", "length", "record_type", "digest"])

    return run


def captures_of(directory: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """The captures of keys (different, not null): key, page_id, file, offset, length, record_type, digest."""
    # one row a file of blocks, as many as the index has range partitions
    files = directory.groupBy("file").agg(F.min("first").alias("first")).collect()
    # Python and Spark both order keys by code point here
    files = sorted((r["first"], r["file"]) for r in files)
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast(([f for f, _ in files], [p for _, p in files]))
    requests = keys.select("key").mapInArrow(_requested(folder, shared), "key string, file string, offset long, length long")
    requests = requests.repartition(shuffle_width(spark), "file", "offset").sortWithinPartitions("file", "offset", "key")
    return requests.mapInArrow(_captured(folder), _CAPTURE)


def lookup(directory: DataFrame, folder: str, urls: DataFrame) -> DataFrame:
    """Captures of each row of urls (url): url, page_id, file, offset, length, record_type."""
    keyed = urls.select("url").mapInArrow(_keyed, "url string, key string")
    found = captures_of(directory, folder, keyed.select("key").distinct())
    return keyed.join(found, "key").select("url", "page_id", "file", "offset", "length", "record_type")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, pages = fresh(spark, "warc"), table(spark, sf_dir, "pages")
    directory = index(write(pages, folder), folder)
    keys = pages.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(_keyed, "url string, key string").select("key").distinct()
    return read(captures_of(directory, folder, keys), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
f AS (SELECT d, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.f IS NULL OR f.f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.f IS NULL OR f.f = page_id THEN NULL ELSE f.f END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
"""
