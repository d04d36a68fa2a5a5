"""Quality by hierarchical empirical Bayes.

A logistic model over shares measured in each text (shouting, symbols, table bars, repeated words) is the document's own
evidence. Summed by host and by path (grouped aggregation, one row a group), it gives posterior rates of good documents:
a path's rate shrinks toward its host's, a host's toward the global one, the more the fewer documents it has. How much
is estimated from the spread of the groups' means beyond what chance makes. A document's posterior odds are its own
likelihood ratio times its path's prior odds, which are worked out from the other documents: its own evidence counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import labelled, stored, table, tidy, widened, without
from ._linear import fit_dense
from ._words import NOT_SPACE, Words, lean, pieces, utf8

#: Labelled rows that the model is fitted on, at most: the first by hash of their ids. Kept: posterior of at least THRESHOLD.
SAMPLE, THRESHOLD, L2 = 20_000, 0.5, 1.0
#: Rates of so many paths are broadcast at most.
SITES = 20_000
#: Pseudo-documents that a prior counts for, at least and at most.
LEAST, MOST = 1.0, 1e6
MEASURES = ("words", "mean_length", "upper", "symbols", "symbol_ends", "bars", "digits", "repeats", "distinct", "letters")

_UPPER, _SYMBOL, _DIGIT, _LETTER = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
for _c in "!#$%&*+/<=>@[\\]^_`{|}~":
    _SYMBOL[ord(_c)] = True


def measures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """MEASURES of each row. A row without words has zeros (distinct: 1)."""
    w = Words(data, off, NOT_SPACE)
    n, first = len(off) - 1, w.first
    row = np.repeat(np.arange(n), np.diff(first))
    count = np.maximum(1, np.diff(first)).astype(float)
    chars = np.maximum(1, np.diff(off)).astype(float)

    def of_bytes(which: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(which[data], out=total[1:])
        return (total[off[1:]] - total[off[:-1]]) / chars

    h = w.hashes()
    end = data[w.ends - 1] if len(h) else np.zeros(0, np.uint8)
    again = np.zeros(len(h), bool)
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        again[2:] |= (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    by_row = lambda x: np.bincount(row, x, n) / count
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order], fresh, n) / count
    bar = (w.ends - w.starts == 1) & (end == ord("|")) if len(h) else again
    root = np.sqrt  # a junk passage in an otherwise ordinary text should show
    columns = [np.log1p(np.diff(first)), np.log1p(by_row((w.ends - w.starts).astype(float))), root(of_bytes(_UPPER)), root(of_bytes(_SYMBOL)), root(by_row(_SYMBOL[end].astype(float))), root(by_row(bar.astype(float))), root(of_bytes(_DIGIT)), root(by_row(again.astype(float))), np.where(np.diff(first) > 0, distinct, 1.0), of_bytes(_LETTER)]
    return np.stack(columns, axis=1)


class Model:
    def __init__(self, w: np.ndarray, b: float, mean: np.ndarray, scale: np.ndarray, rate: float):
        self.w, self.b, self.mean, self.scale, self.rate = w, b, mean, scale, rate

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b


def _measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in pieces(off):
            x = measures(data[off[i] : off[j]], off[i : j + 1] - off[i])
            flat = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(i, j - i).cast(pa.int32()), flat], ["quality", "x"])


def fit_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. labels: doc_id, quality (1 good, 0 bad; rows of null are left out). Without both labels the
    model has no weights and gives the label's rate."""
    got = labelled(docs, labels, "quality", sample).select("text", "quality").mapInArrow(lean(_measure_rows), "quality int, x array<double>").toPandas()
    y = got["quality"].to_numpy(float)
    k = len(MEASURES)
    rate = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(k), float(np.log(rate / (1 - rate))), np.zeros(k), np.ones(k), float(rate))
    return Model(*fit_dense(np.array(got["x"].tolist()), y, L2), float(rate))


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """docs + _odds: each document's own log odds of being good. Null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in pieces(off):
                odds = shared.value.log_odds(measures(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(odds)], [*columns, "_odds"])

    return docs.mapInArrow(lean(run), widened(docs, "_odds double"))


def _spread(groups: DataFrame, center: str) -> float:
    """Pseudo-documents of the prior over groups (n, s: documents and summed probabilities): beta-binomial, by moments.
    The variance of group means about their center, less what sampling alone gives, is the prior's."""
    p, c = F.col("s") / F.col("n"), F.col(center)
    r = groups.where("n > 1").agg(F.sum(F.col("n") * (p - c) ** 2).alias("between"), F.sum(c * (1 - c)).alias("chance"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * c * (1 - c)).alias("room")).first()
    if not r["k"] or r["n"] <= r["k"] or not r["room"]:
        return MOST
    # E[between] = chance + (n - k) * variance, and variance = c (1 - c) / (weight + 1)
    share = max(0.0, (r["between"] - r["chance"]) / (r["n"] - r["k"])) / (r["room"] / r["n"])
    return MOST if share <= 1 / (MOST + 1) else min(MOST, max(LEAST, 1 / share - 1))


def site_rates(odds: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(_host, _path, _odds) -> a row for each path: _host, _path, host_n, host_s, path_n, path_s (documents, summed
    probabilities), host_rate, path_rate (posterior rates of good documents); and what they shrink by: n and s of all
    documents, host_k and path_k (pseudo-documents of the priors)."""
    good = 1 / (1 + F.exp(-F.col("_odds")))
    paths = stored(odds.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(good).alias("s")), "site-paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = {"n": float(whole["n"] or 0), "s": float(whole["s"] or 0)}
    hosts = hosts.withColumn("center", F.lit(shrunk(prior["s"], prior["n"], 2, 0.5)))
    prior["host_k"] = _spread(hosts, "center")
    hosts = hosts.select("_host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), shrunk(F.col("s"), F.col("n"), prior["host_k"], F.col("center")).alias("host_rate"))
    both = paths.alias("p").join(hosts.alias("h"), F.col("p._host").eqNullSafe(F.col("h._host"))).select("p._host", "_path", "n", "s", "host_n", "host_s", "host_rate")
    prior["path_k"] = _spread(both, "host_rate")
    rate = shrunk(F.col("s"), F.col("n"), prior["path_k"], F.col("host_rate"))
    return both.select("_host", "_path", "host_n", "host_s", F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_rate", rate.alias("path_rate")), prior


def shrunk(s, n, k, center):
    """The rate of s in n, with k pseudo-documents at the center."""
    return (s + k * center) / (n + k)


def rate_of_others(p: Column, prior: dict[str, float]) -> Column:
    """The path's rate without the document of probability p itself, by the same shrinkage at each level."""
    overall = shrunk(F.lit(prior["s"]) - p, F.lit(prior["n"]) - 1, 2, 0.5)
    host = shrunk(F.col("host_s") - p, F.col("host_n") - 1, prior["host_k"], overall)
    return shrunk(F.col("path_s") - p, F.col("path_n") - 1, prior["path_k"], host)


def host_of(source: Column) -> Column:
    return F.split_part(source, F.lit("/"), F.lit(1))


@tidy
def classify(docs: DataFrame, model: Model, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """docs + score (posterior probability of being good), host_rate, path_rate, kept; columns of these names are replaced.
    columns: of docs, those to keep (all). They are written once with each row's evidence, so texts are measured once.

    host, path: where a document is from; if not given, the source up to its first slash, and the whole source with the
    language. Nulls are a site of their own. Null text is empty. Repeated rows each count. No rows give none."""
    docs = without(docs, "score", "host_rate", "path_rate", "kept")
    columns = [c for c in docs.columns if columns is None or c in columns]
    host = host_of(F.col("source")) if host is None else host
    path = F.to_json(F.struct("source", "lang")) if path is None else path
    judged = evidence(docs.withColumn("_host", host).withColumn("_path", path), model)
    judged = stored(judged.select(*[F.col(f"`{c}`") for c in columns], "_host", "_path", "_odds"), "site-evidence")
    rates, prior = site_rates(judged)
    rates = stored(rates, "site-rates")
    if rates.limit(SITES + 1).count() <= SITES:
        rates = F.broadcast(rates)  # few enough: texts stay where they are. Otherwise Spark joins by shuffle.
    both = judged.alias("d").join(rates.alias("r"), F.col("d._host").eqNullSafe(F.col("r._host")) & F.col("d._path").eqNullSafe(F.col("r._path")), "left")
    base = float(np.log(model.rate / (1 - model.rate)))
    prior = F.least(F.greatest(rate_of_others(1 / (1 + F.exp(-F.col("_odds"))), prior), F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("_odds") - base + F.log(prior / (1 - prior))
    out = both.withColumn("_score", 1 / (1 + F.exp(-odds)))
    return out.select(*[F.col(f"d.`{c}`") for c in columns], F.col("_score").alias("score"), "host_rate", "path_rate").withColumn("kept", F.col("score") >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, host_rate, path_rate, kept of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit_model(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model, columns=["doc_id"]).select("doc_id", "score", "host_rate", "path_rate", "kept")
