"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from huescape.llm import decontamination, mixing, near_duplicates, quality, tokens
from huescape.llm._common import Stored, scope, small_batches, stored, table, tidy  # noqa: F401


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on labelled rows of this stage's own input."""
    model = quality.fit_model(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (word 5-shingles, similarity 0.8): that with the least doc_id.
    Rows that share the doc_id kept are one document repeated: one of them stays. Rows of a null doc_id stay."""
    kept = near_duplicates.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in windows of benchmark items."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each document and pass that takes words of it, its text cut to those words, in order
    of the shards and slots that hold them."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns, from them, each row's place, length and checksum."""
    return tokens.stage(docs)


def _small(stage):
    return lambda spark, docs, sf_dir: stage(small_batches(spark), docs, sf_dir)


STAGES = [(name, _small(stage)) for name, stage in (("quality", keep_good), ("near duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix), ("tokens", tokenize))]

#: Learned models and tokenizers are beyond SQL. tests/llm holds each stage against a brute-force version on its own input.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage leaves behind is deleted once the next has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope() as s:
            after = Stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            s.keep(after.df)
        if before:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
