"""Token ids as Parquet list columns, for selective reads of tokens and of metadata.

Documents are ranged by doc_id, encoded where they land and written in that order by Spark's own writer, so a lost
executor's files are written anew by its committer. Ids are a list column with its dictionary on (a vocabulary of
50,000 fits it; a page falls back to delta packing where it doesn't, by data page v2), rows are in groups of a fixed
size, and pages carry indexes: a reader of a few documents, or of the counts alone, fetches just those pages.

File columns: part int, seq long (row within the part), doc_id, first long (ids before it in the part), n_tokens int,
ids list<int>. A document's place in the whole corpus is the sum of the parts before its own plus `first`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table, work_path
from ._pieces import Pieces
from ._words import lean, pieces, release, utf8

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: Bytes: a row group, a page, a dictionary page.
LAYOUT = {"parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10), "parquet.dictionary.page.size": str(512 << 10), "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.page.row.count.limit": "5000", "compression": "zstd"}
_FILE = "part int, seq long, doc_id long, first long, n_tokens int, ids array<int>"


_encoders: dict[str, Pieces] = {}


def encoder(path: str) -> Pieces:
    """A worker's encoder; it lasts as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Pieces(path)
    return _encoders[path]


def _tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first, enc = TaskContext.get().partitionId(), 0, 0, encoder(path)
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in pieces(off):
                ids, row = enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.diff(row) + 1
                ends = np.cumsum(n)
                every = np.insert(ids, row[1:], end_id).view(np.int32)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(every))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(seq, seq + len(n))), batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(first + ends - n), pa.array(n.astype(np.int32)), column],
                    ["part", "seq", "doc_id", "first", "n_tokens", "ids"],
                )
                seq, first = seq + len(n), first + int(ends[-1])
            release()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the token files of docs (doc_id, text; more columns are ignored) in ascending doc_id order, null first,
    rows that share a doc_id in order of their text. Null text is empty: the end id alone. An empty table leaves no rows."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The key has the text's hash too, so a doc_id that very many rows share is not one range.
    ranged = text.withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h").drop("h")
    ranged.mapInArrow(_encode(tokenizer or _tokenizer_path(), end_id), _FILE).write.options(**LAYOUT).parquet(path)


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table of _FILE. Columns left unselected and row groups ruled out by a filter stay unread."""
    return spark.read.schema(_FILE).parquet(path)


def placed(files: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (part, first and more, made from files) + start: ids of all documents before. The running total has a row for
    each file alone, and counts are all that is read for it."""
    sums = files.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("first")).drop("base")


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids."""
    files = token_files(spark, path)
    return placed(files, files).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        off, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        raw = memoryview(np.ascontiguousarray(flat)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        n = pa.array(np.diff(off).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "first", "doc_id")), n, pa.array(crc, pa.int64())], ["part", "first", "doc_id", "n_tokens", "ids_crc32"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read from the files."""
    files = token_files(spark, path)
    sums = files.select("part", "first", "doc_id", "ids").mapInArrow(lean(_checksums), "part int, first long, doc_id long, n_tokens long, ids_crc32 long")
    return placed(files, sums).select("doc_id", "start", "n_tokens", "ids_crc32")


def stage(docs: DataFrame) -> DataFrame:
    path = work_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return checksums(docs.sparkSession, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files that hold its ids."""
    return stage(table(spark, sf_dir, "documents"))
