"""Toxicity by a counterfactual-regularised classifier.

A logistic model over a text's distinct words and the beginnings of words (with how many distinct words share one:
once, twice, three times). It is fitted on a bounded sample of labelled rows. In texts of the sample that mention a
group, the terms are swapped for others of their kind; the fit penalises the squared change of the score, so that
mentions by themselves, rare as they are among the labels, don't become evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import labelled, stored, table, tidy, widened, without
from ._linear import Sparse, fit_sparse, sigmoid
from ._words import ALNUM, Words, mix, pieces, utf8, with_length

#: Labelled rows that the model is fitted on, at most: the first by hash of their ids.
#: FEATURES: of the model, at most.
SAMPLE, FEATURES, PREFIXES, MOST, LEAST_ROWS, LEAST_Z, FAIRNESS, L2, THRESHOLD = 12_000, 20_000, (4, 5, 6, 7, 8, 10), 3, 2, 2.5, 10.0, 0.3, 0.3
#: Terms of one row stand for groups of one kind: English, German, French, Spanish. No term is in two rows.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("gay", "straight", "lesbian", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("immigrant", "native"), ("immigrants", "natives"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("schwule", "lesben", "heteros"), ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten"), ("einwanderer", "einheimische"), ("behinderte", "blinde", "gehörlose"),
    ("femmes", "hommes"), ("femme", "homme"), ("fille", "garçon"), ("homosexuels", "hétérosexuels"), ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques"), ("immigrés", "autochtones"), ("handicapés", "aveugles", "sourds"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niña", "niño"), ("homosexuales", "heterosexuales"), ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos"), ("inmigrantes", "nativos"), ("discapacitados", "ciegos", "sordos"),
)
#: Swapped versions of a text that mentions a group, at most: by the next terms of each row.
SWAPS = 2


def swap_terms(text: str, identities=IDENTITIES, by: int = 1) -> str | None:
    """text with each term replaced by the one `by` places after it in its row (first letters' case kept); None if it has none."""
    following = {t.casefold(): row[(i + by) % len(row)] for row in identities for i, t in enumerate(row)}

    def put(m: re.Match) -> str:
        new = following.get(m[0].casefold(), m[0])
        return new.upper() if len(m[0]) > 1 and m[0].isupper() else new.capitalize() if m[0][0].isupper() else new

    terms = sorted({t for row in identities for t in row}, key=len, reverse=True)
    swapped, n = re.subn(r"(?<!\w)(?:" + "|".join(map(re.escape, terms)) + r")(?!\w)", put, text, flags=re.I)
    return swapped if n else None


def swaps(text: str, identities=IDENTITIES) -> list[str]:
    """The versions of a text that the fit holds against it."""
    made = {swap_terms(text, identities, by) for by in range(1, SWAPS + 1)}
    return sorted(t for t in made if t is not None and t != text)


def _among(x: np.ndarray, known: np.ndarray, marks: np.ndarray) -> np.ndarray:
    out = marks[(x >> np.uint64(46)).astype(np.int64)]
    at = np.flatnonzero(out)
    if len(at):
        y = x[at]
        out[at] = known[np.minimum(np.searchsorted(known, y), len(known) - 1)] == y
    return out


def _marks(known: np.ndarray) -> np.ndarray:
    marks = np.zeros(1 << 18, bool)
    marks[(known >> np.uint64(46)).astype(np.int64)] = True
    return marks


def features(data: np.ndarray, off: np.ndarray, known: np.ndarray | None = None, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every distinct feature of each row; with known (sorted), of those alone."""
    words = Words(data, off, ALNUM)
    row = np.repeat(np.arange(len(off) - 1), np.diff(words.first))
    total = words.sums()
    h = with_length(total[words.ends] - total[words.starts], words.ends - words.starts)
    rows, found = [], []
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    _, first = np.unique(mix(h ^ mix(row.astype(np.uint64) + np.uint64(77))), return_index=True)
    row, h, starts, size = row[first], h[first], words.starts[first], (words.ends - words.starts)[first]

    def keep(r: np.ndarray, f: np.ndarray) -> None:
        if known is not None:
            ok = _among(f, known, marks)
            r, f = r[ok], f[ok]
        rows.append(r)
        found.append(f)

    keep(row, mix(h + np.uint64(1)))
    for n in PREFIXES:
        at = np.flatnonzero(size > n)
        begin = starts[at]
        p = mix(total[begin + n] - total[begin] + np.uint64(n * 1000003))
        r = row[at]
        _, one, count = np.unique(mix(p ^ mix(r.astype(np.uint64) + np.uint64(99))), return_index=True, return_counts=True)
        for times in range(1, MOST + 1):
            more = one[count >= times]
            f = p[more] if times == 1 else mix(p[more] + np.uint64(times))
            keep(r[more], f)
    return np.concatenate(rows), np.concatenate(found)


def _one(text: str, known: np.ndarray | None = None, marks: np.ndarray | None = None) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return features(raw, np.array([0, len(raw)]), known, marks)[1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """f, n, pos: rows and rows of label 1 with a feature, summed for some rows at a time before they leave the worker."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        y = batch.column("toxic").to_numpy(zero_copy_only=False)
        for i, j in pieces(off, 8 << 20):
            row, f = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            known, back, n = np.unique(f, return_inverse=True, return_counts=True)
            pos = np.bincount(back, y[i:j][row], len(known)).astype(np.int64) if len(f) else n
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(pos)], ["f", "n", "pos"])


_TRAIN = "toxic int, plain binary, swapped array<binary>"


def _train_rows(known: np.ndarray, identities):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _marks(known)
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                rows.append((_one(text, known, marks).tobytes(), [_one(x, known, marks).tobytes() for x in swaps(text, identities)]))
            plain, swapped = pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), plain, swapped], ["toxic", "plain", "swapped"])

    return run


class Model:
    """Sorted feature hashes, their weights, an intercept."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, intercept: float):
        self.known, self.weights, self.intercept, self.marks = known, weights, intercept, _marks(known)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, f = features(data, off, self.known, self.marks)
        z = np.bincount(row, self.weights[np.searchsorted(self.known, f)], len(off) - 1) if len(f) else np.zeros(len(off) - 1)
        return sigmoid(z + self.intercept)

    def score_text(self, text: str) -> float:
        raw = np.frombuffer(text.encode(), np.uint8)
        return float(self.scores(raw, np.array([0, len(raw)]))[0])


@tidy
def fit_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, identities=IDENTITIES, fairness: float = FAIRNESS) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic (1 or 0; rows of null are left out). Null text is empty. Without rows of
    both labels the model has no features and says the rate of the label (0.5 without any rows)."""
    rows = stored(labelled(docs, labels, "toxic", sample), "toxic-sample")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("pos")).first()
    n, n1 = size["n"], size["pos"] or 0
    if not 0 < n1 < n:
        p = (n1 + 1) / (n + 2)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p))))
    # Features that tell the labels apart: by the difference of their rates in standard errors.
    c = rows.mapInArrow(_count, "f long, n long, pos long").groupBy("f").agg(F.sum("n").alias("c"), F.sum("pos").alias("c1")).where(F.col("c") >= LEAST_ROWS)
    p = F.col("c") / n
    z = (F.col("c1") / n1 - (F.col("c") - F.col("c1")) / (n - n1)) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / (n - n1)))
    best = c.withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(FEATURES).select("f").toPandas()
    known = np.sort(best["f"].to_numpy(np.int64).view(np.uint64))
    got = rows.mapInArrow(_train_rows(known, identities), _TRAIN).collect()
    y = np.array([r["toxic"] for r in got], float)
    plain = [np.frombuffer(r["plain"], np.uint64) for r in got]
    where = np.repeat(np.arange(len(plain)), [len(p) for p in plain])
    column = np.searchsorted(known, np.concatenate(plain))
    x = Sparse(where, column, np.ones(len(where)), (len(y), len(known)))
    w, b = fit_sparse(x, y, _differences(plain, [r["swapped"] for r in got], known), L2, fairness)
    return Model(known, w, b)


def _differences(plain: list[np.ndarray], swapped: list[list[bytes]], known: np.ndarray) -> Sparse:
    """A row for each pair of a text and a swapped version: 1 for features that the swap takes away, -1 for those it adds."""
    rows, columns, values, n = [], [], [], 0
    for a, versions in zip(plain, swapped, strict=True):
        for s in versions if len(known) else ():
            b = np.frombuffer(s, np.uint64)
            for f, sign in ((np.setdiff1d(a, b), 1.0), (np.setdiff1d(b, a), -1.0)):
                at = np.searchsorted(known, f)
                hit = known[np.minimum(at, len(known) - 1)] == f
                columns.append(at[hit])
                rows.append(np.full(int(hit.sum()), n))
                values.append(np.full(int(hit.sum()), sign))
            n += 1
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return Sparse(join(rows, int), join(columns, int), join(values, float), (n, len(known)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs + score, predicted of every whole text; columns of these names are replaced. Null text is empty and scores
    what an empty text does."""
    docs = without(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the features of `sample` rows
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in pieces(off):
                part = batch.slice(i, j - i)
                s = shared.value.scores(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(s)], [*columns, "score"])

    out = docs.mapInArrow(run, widened(docs, "score double"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; no label of a held-out row is seen."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    seen = labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    model = fit_model(docs, seen)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
