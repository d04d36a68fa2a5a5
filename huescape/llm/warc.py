"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. A bundle (file) ends with a seek table in a skippable frame (the
seekable format's footer: sizes of each frame, their number, a magic number), which plain decoders pass over. An index
maps each record to bundle, frame and place within the frame, so that one record costs one read and one frame.

Records are WARC/1.1: a response holds an HTTP head and the payload; a revisit holds the head alone and names the record,
the address and the date it refers to. Responses are written first; revisits are joined with their index, so that what
they name exists whatever rows are repeated.

Bundles are written to a folder that all executors share, through Arrow's file systems, under names of their own. The
index has the names that successful attempts returned; what a lost executor left is never referred to, and deleted.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import spread, stored, table, tidy, work_path

#: Payloads of fewer bytes are never deduplicated. Bytes of records in a frame, and of frames in a bundle, before the next begins.
LEAST, FRAME, BUNDLE, LEVEL = 100, 512 << 10, 256 << 20, 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = "page_id long, record_id string, digest string, url string, bundle string, frame int, frame_at long, frame_size long, record_at long, record_size long"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, decompressed) sizes, without checksums."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(read, size: int) -> list[tuple[int, int, int]]:
    """(place, compressed, decompressed) of each frame of a bundle. read(place, n) gives bytes."""
    n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    raw, at, out = read(size - 9 - n * width, n * width), 0, []
    for i in range(n):
        packed, whole = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, whole))
        at += packed
    return out


def _line(value) -> bytes:
    """A header value: control characters would end the line, so they are escaped like in a URL."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", str(value)).encode()


def record(record_id: str, page_id, url: str, payload: bytes, size: int, digest: str, date: str, refers: tuple | None = None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without payload of refers = (page_id, record_id, url). A page_id of
    null is left out. size: bytes of the payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + b"\r\n\r\n"
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers is None else b"revisit"), b"WARC-Record-ID: <" + record_id.encode() + b">", b"WARC-Date: " + date.encode()]
    head += [b"WARC-Target-URI: " + _line(url or ""), b"WARC-Payload-Digest: sha256:" + digest.encode()]
    if page_id is not None:
        head.append(b"X-Page-ID: " + str(page_id).encode())
    if refers is None:
        body += payload
    else:
        head += [b"WARC-Profile: " + _PROFILE, b"WARC-Refers-To: <" + refers[1].encode() + b">", b"WARC-Refers-To-Target-URI: " + _line(refers[2] or ""), b"WARC-Refers-To-Date: " + date.encode(), b"X-Refers-To-Page-ID: " + str(refers[0]).encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: " + str(len(body)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes, int]]:
    """Headers, HTTP headers, payload and size of each record of a frame."""
    at = 0
    fields = lambda x: dict(line.split(": ", 1) for line in x.decode().split("\r\n")[1:])
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = fields(data[at:end])
        n = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        cut = block.index(b"\r\n\r\n")
        yield head, fields(block[:cut]), block[cut + 4 :], end + 8 + n - at
        at = end + 8 + n


class _Bundle:
    """A bundle being written; rows of the index wait for their frame."""

    def __init__(self, folder: str, frame: int):
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out, self.most, self.frames, self.at = fs.open_output_stream(f"{path}/{self.name}", compression=None), frame, [], 0
        self.waiting, self.held, self.rows, self.count = [], 0, [], 0
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def next_id(self) -> str:
        """An identifier for the next record: unlike any other's, as the bundle's name is."""
        self.count += 1
        return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.name}#{self.count}')}"

    def add(self, row: tuple, data: bytes) -> None:
        """row: page_id, record_id, digest, url."""
        self.waiting.append((row, data))
        self.held += len(data)
        if self.held >= self.most:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        packed, at = self.zstd.compress(b"".join(d for _, d in self.waiting)), 0
        for row, data in self.waiting:
            self.rows.append((*row, self.name, len(self.frames), self.at, len(packed), at, len(data)))
            at += len(data)
        self.out.write(packed)
        self.frames.append((len(packed), at))
        self.at += len(packed)
        self.waiting, self.held = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int32(), *[pa.int64()] * 4]
    names = [c.split()[0] for c in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


_RECORDS = ("page_id", "url", "html", "size", "digest", "refers_to", "refers_id", "refers_url")


def _write(folder: str, frame: int, bundle: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for values in zip(*(batch.column(c) for c in _RECORDS), strict=True):
                page_id, url, html, size, digest, *refers = (v.as_py() for v in values)
                out = out or _Bundle(folder, frame)
                name = out.next_id()
                out.add((page_id, name, digest, url), record(name, page_id, url, (html or "").encode(), size, digest, date, None if refers[0] is None else tuple(refers)))
                if out.at >= bundle:
                    out.close()
                    yield _index_batch(out.rows)
                    out = None
            if out and out.rows:
                yield _index_batch(out.rows)
                out.rows = []
        if out:
            out.close()
            yield _index_batch(out.rows)

    return run


def dedupe(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, size (bytes), digest, refers_to of every page. Of pages with equal payloads of `least` bytes and
    more, the one with the smallest page_id refers to nothing, the others to it. Rows that share that page_id all stand for
    themselves, and so do rows of which every page_id is null. Null html is an empty payload."""
    text = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text.alias("html"), F.octet_length(text).cast("long").alias("size"), F.sha2(text.cast("binary"), 256).alias("digest"))
    seen = p.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = seen.where("n > 1").select("digest", "first")
    joined = p.join(again, "digest", "left")
    refers_to = F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "size", "digest", refers_to.alias("refers_to"))


@tidy
def write_archives(pages: DataFrame, folder: str, least: int = LEAST, frame: int = FRAME, bundle: int = BUNDLE, date: datetime | None = None) -> DataFrame:
    """Writes pages (page_id, url, html; more columns are ignored) to bundles in folder (a URI that all executors reach;
    it is for this call alone) and returns the index, itself a stored table: a row for each record. No pages, no bundles.
    date: that of the records (now)."""
    spark, when = pages.sparkSession, (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows, write = dedupe(pages, least), _write(folder, frame, bundle, when)
    nothing = F.lit(None).cast("string")
    responses = rows.where("refers_to is null").withColumn("refers_id", nothing).withColumn("refers_url", nothing)
    first = stored(responses.select(*_RECORDS).mapInArrow(write, _INDEX), "warc-responses")
    # A payload can have very many revisits: they are dealt to parts, and the record they name goes to each part once.
    revisits = stored(rows.where("refers_to is not null").drop("html"), "warc-revisits")
    dealt, parts = spread(revisits, "digest", "page_id", revisits.count())
    named = first.join(revisits.select("digest", F.col("refers_to").alias("page_id")).distinct(), ["digest", "page_id"])
    named = named.groupBy("digest").agg(F.min(F.struct("record_id", "url")).alias("r")).join(parts, "digest").select("digest", "part", F.col("r.record_id").alias("refers_id"), F.col("r.url").alias("refers_url"))
    more = dealt.join(named, ["digest", "part"]).withColumn("html", nothing)
    index = stored(first.unionByName(more.select(*_RECORDS).mapInArrow(write, _INDEX)), "warc-index")
    _remove_others(spark, index, folder)
    return index


def _remove_others(spark: SparkSession, index: DataFrame, folder: str) -> None:
    """Deletes bundles that the index doesn't name: those of attempts that failed."""
    from pyarrow.fs import FileSelector, FileSystem

    fs, path = FileSystem.from_uri(folder)
    there = [(f.base_name,) for f in fs.get_file_info(FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".warc.zst")]
    if there:
        for r in spark.createDataFrame(there, "bundle string").join(index.select("bundle").distinct(), "bundle", "left_anti").toLocalIterator():
            fs.delete_file(f"{path}/{r[0]}")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(folder)
        unpack, name, file = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            at = [batch.column(c).to_pylist() for c in ("bundle", "frame_at", "frame_size")]
            for bundle, place, size in zip(*at, strict=True):
                if bundle != name:
                    if file:
                        file.close()
                    name, file = bundle, fs.open_input_file(f"{path}/{bundle}")
                rows = []
                for head, http, body, _ in parse(unpack.decompressobj().decompress(file.read_at(size, place))):
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
                    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload of page {head.get('X-Page-ID')} does not have its digest")
                    page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                    row = (None if page is None else int(page), int(http["Content-Length"]), digest, kind, None if refers is None else int(refers), head["WARC-Target-URI"])
                    rows.append((*row, body) if payloads else row)
                names = [c.split()[0] for c in _READ.split(", ")] + ["payload"] * payloads
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        if file:
            file.close()

    return run


def read_archives(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of the bundles that the index names: a frame is a task's unit, read once. payloads: with `payload`
    (binary, empty for revisits)."""
    frames = index.select("bundle", "frame_at", "frame_size").distinct()
    # The list of frames is short whatever they hold, so Spark would put it into few tasks: they are dealt out by number.
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), frames.count() // 64)
    frames = frames.repartition(tasks, "bundle", "frame_at").sortWithinPartitions("bundle", "frame_at")
    return frames.mapInArrow(_read(folder, payloads), _READ + ", payload binary" * payloads)


def fetch(spark: SparkSession, index: DataFrame, folder: str, page_id: int) -> list[bytes]:
    """The records of one page, by its index rows alone: one read and one frame each."""
    import zstandard
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(folder)
    out = []
    for r in index.where(F.col("page_id") == page_id).collect():
        with fs.open_input_file(f"{path}/{r['bundle']}") as f:
            frame = zstandard.ZstdDecompressor().decompressobj().decompress(f.read_at(r["frame_size"], r["frame_at"]))
        out.append(frame[r["record_at"] : r["record_at"] + r["record_size"]])
    return out


@tidy
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives."""
    folder = work_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder).drop("url")


def oracle(source: str = "pages") -> str:
    """The query as DuckDB SQL."""
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM {source}),
f AS (SELECT *, CASE WHEN n >= {LEAST} THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""
