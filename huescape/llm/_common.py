"""Shared folder, materialised tables and sizes that every operator here relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import Stored, discard, scope, shared_dir, stored, tidy, work_path  # noqa: F401


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, its Arrow batches set to at most 8 MB: operators stream, so a Python worker need never hold more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key).lower().removesuffix("b")
    if not size.isdigit() or int(size) > 8 << 20:
        spark.conf.set(key, str(8 << 20))
    return spark


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, so that the operator's own results take their place."""
    return df.drop(*[c for c in df.columns if c in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5_hex(*cols) -> F.col:
    """md5 of the columns' text, joined by colons; null counts as empty. The same in Spark and in DuckDB."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols]).cast("binary"))


def hash32(*cols):
    """The first 32 bits of md5_hex, as a long from 0 to 2^32 - 1."""
    return F.conv(F.substring(md5_hex(*cols), 1, 8), 16, 10).cast("long")


def widened(df: DataFrame, ddl: str) -> T.StructType:
    """df's schema with more fields at its end."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id, text, label of the documents of at most `sample` labels: the first by hash of their ids. Ids and labels of
    the sample, a few bytes a row, are what is broadcast; other texts stay where they are. Repeated labels count once, and
    of documents that share an id the least text: rows are no more than labels, however often either is repeated."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label).distinct()
    rows = rows.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", label).limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))


def likely(df: DataFrame, column: str, keys: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Rows of df whose column may be among keys (a column of the same name): all that are, and few more as long as there
    are far fewer keys than bits. What is broadcast has at most bits / 64 rows however many keys there are; with too many
    of them the filter just lets everything through. For use ahead of an exact join, to shuffle less."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    word, bit = (place / 64).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    filled = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    there = df.withColumn("_word", word).join(F.broadcast(filled), "_word")
    return there.where(F.col("_bits").bitwiseAND(bit) != 0).select(df.columns)


def spread(df: DataFrame, key: str, by: str, total: int, rows: int = 256) -> tuple[DataFrame, DataFrame]:
    """df with a column `part`, and (key, part) as it occurs at most: a key of many rows is dealt to parts of about `rows`
    rows each by a hash of column `by`; all others have the one part 0. total: df's rows. The keys of many rows, which are
    what is broadcast, are 4,096 at most."""
    least = max(rows, total // 4096)
    parts = F.ceil(F.col("_n") / least).cast("long")
    hot = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(key, parts.alias("_parts"))
    one = F.lit(0).cast("long")
    dealt = df.join(F.broadcast(hot), key, "left").withColumn("part", F.when(F.col("_parts").isNull(), one).otherwise(F.pmod(F.xxhash64(by), F.col("_parts")))).drop("_parts")
    return dealt, dealt.select(key, "part").distinct()
