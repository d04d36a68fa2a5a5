"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors of a label are one class from the start. Centroids are fitted on a bounded sample of the classes; every
class gets a home cell, the one with the greatest dot product. Two unit vectors of cosine t are at most
d = sqrt(2 - 2t) apart. So if x has home c and y has home e, they differ along c - e by at most d: only those x and y meet
that lie within d of the plane between their cells, whichever the centroids are, and the search is exact. Each class is
written once, with its neighbours, to a segment of a file in the shared folder; a task reads the two segments of a pair
and multiplies what meets, in blocks. It emits a count for each row and the edges of a spanning forest, never the pairs.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, stored, table, tidy, work_path
from .components import components

COSINE, SAMPLE, CELL, CELLS, BLOCK, ROUNDS = 0.98, 20_000, 1000, 1024, 1024, 8
#: Bytes of vectors in a segment, at most (a longer vector is one by itself).
SEGMENT = 6 << 20


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of spherical k-means, from k vectors at even steps."""
    x = _unit(vectors)
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


_ASSIGNED = "grp long, part int, cell int, id long, copies long, dim int, vec binary"


def _packed(raw: np.ndarray) -> pa.Array:
    """Rows of a matrix as bytes."""
    offsets = (np.arange(len(raw) + 1) * raw.shape[1] * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _rows_of(dim: int, item: int, segment: int) -> int:
    return max(1, segment // (dim * item))


def _assign(shared, cell: int, segment: int):
    """Home cells; cells of one part, together about a segment, go to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column("embedding")).to_numpy()
            for dim in np.unique(dims).tolist():
                for rows in _slices(batch.filter(pa.array(dims == dim)), 1024):
                    raw = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
                    own = (_unit(raw.astype(np.float64)) @ centroids.get(dim, np.ones((1, dim))).T).argmax(axis=1).astype(np.int32)
                    part = own // max(1, _rows_of(dim, raw.itemsize, segment) // cell)
                    columns = [rows.column("grp"), pa.array(part), pa.array(own), rows.column("id"), rows.column("copies"), pa.array(np.full(len(own), dim, np.int32)), _packed(raw)]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ASSIGNED.split(", ")])

    return run


def _slices(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)


_INDEX = "grp long, seg string, file string, at long, n long, dim int"


def _write(folder: str, item: int, segment: int):
    """Rows of a grp lie together, by cell: a segment after the other in a file of the task's own. A segment is its ids,
    copies, cells and vectors, each in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, out, at, held = uuid.uuid4().hex, None, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal out, at, held
            t = pa.Table.from_batches(held).combine_chunks()
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            pieces = [t.column(c).to_numpy().tobytes() for c in ("id", "copies", "cell")] + [b"".join(t.column("vec").to_pylist())]
            out.write(b"".join(pieces))
            row = [t.column("grp")[0].as_py(), f"{name}-{at}", name, at, len(t), t.column("dim")[0].as_py()]
            at, held = at + sum(map(len, pieces)), []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], [c.split()[0] for c in _INDEX.split(", ")])

        now, n = None, 0
        for batch in batches:
            grp, dim = batch.column("grp").to_numpy(), batch.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                while lo < hi:
                    most = _rows_of(int(dim[lo]), item, segment)
                    if held and (grp[lo] != now or n >= most):
                        yield flush()
                    if not held:
                        now, n = grp[lo], 0
                    k = min(hi - lo, most - n)
                    held.append(batch.slice(lo, k))
                    lo, n = lo + k, n + k
        if held:
            yield flush()
        if out:
            out.close()

    return run


class _Segment:
    """Rows by cell: ids, copies, first rows of cells, unit vectors in single precision; in double for chosen rows."""

    def __init__(self, data: bytes, n: int, dim: int, kind: type):
        self.id, self.copies, cell = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, np.int32, n, 16 * n)
        self.raw = np.frombuffer(data, kind, n * dim, 20 * n).reshape(n, dim)
        self.cells, starts = np.unique(cell, return_index=True)
        self.bounds, self.own = [*starts.tolist(), n], cell
        self.x = np.concatenate([self.unit(slice(i, i + 4096)) for i in range(0, n, 4096)], dtype=np.float32, casting="same_kind")

    def unit(self, rows) -> np.ndarray:
        return _unit(self.raw[rows].astype(np.float64))


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph between rows and columns."""
    rows, columns, edges = np.ones(links.shape[0], bool), np.ones(links.shape[1], bool), []
    for start in range(len(rows)):
        if not rows[start]:
            continue
        rows[start], queue = False, [start]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(links[i] & columns)
            columns[new] = False
            edges += [(i, j) for j in new.tolist()]
            for j in new.tolist():
                more = np.flatnonzero(links[:, j] & rows)
                rows[more] = False
                edges += [(k, j) for k in more.tolist()]
                queue += more.tolist()
    return edges


def _root(parent: dict[int, int], v: int) -> int:
    while (up := parent.get(v, v)) != v:
        parent[v] = parent.get(up, up)
        v = up
    return v


def _linked(a: _Segment, i: np.ndarray, b: _Segment, j: np.ndarray, cosine: float) -> np.ndarray:
    """Rows i of a against rows j of b. What single precision can't tell is worked out in double, by a sum that doesn't
    depend on the order of operands."""
    s, slack = a.x[i] @ b.x[j].T, 1e-6 + 2e-7 * a.raw.shape[1]
    out = s >= cosine + slack
    p, q = np.nonzero((s >= cosine - slack) & ~out)
    for at in range(0, len(p), 4096):
        k, m = p[at : at + 4096], q[at : at + 4096]
        out[k, m] = (a.unit(i[k]) * b.unit(j[m])).sum(axis=1) >= cosine
    return out


def _meeting(a: _Segment, b: _Segment, centroids: np.ndarray, distance: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of a and of b that may be within the distance, and whether they are the same rows."""
    c = centroids.astype(np.float32)
    # How much nearer a row is to its own centroid than to the other segment's: its distance from the plane between, by
    # the centroids' distance. A hair is added for rounding: a visit too many costs time, one too few a link.
    ahead = [np.einsum("nd,nd->n", s.x, c[s.own])[:, None] - s.x @ c[o.cells].T for s, o in ((a, b), (b, a))]
    for k, cell in enumerate(a.cells):
        mine = np.arange(a.bounds[k], a.bounds[k + 1])
        for m, other in enumerate(b.cells):
            if same and m < k:
                continue
            theirs = np.arange(b.bounds[m], b.bounds[m + 1])
            if cell == other:
                yield mine, theirs, same
                continue
            u, v = ahead[0][mine, m], ahead[1][theirs, k]
            most = distance * np.sqrt(((centroids[cell] - centroids[other]) ** 2).sum()) + 1e-5 * sqrt(c.shape[1])
            # Both distances together are no more than that between the rows.
            near, far = u + v.min() <= most, v + u.min() <= most
            if near.any() and far.any():
                yield mine[near], theirs[far], False


_FOUND = "id long, n long, other long"


def _products(folder: str, shared, cosine: float, block: int, kind: type):
    """For each pair of segments a count for each row, and edges (other given)."""
    distance = sqrt(2 - 2 * cosine)

    def product(a: _Segment, b: _Segment, same: bool) -> pa.RecordBatch:
        dim, edges, parent = a.raw.shape[1], [], {}
        counts = [np.zeros(len(a.id)), np.zeros(len(b.id))]
        for mine, theirs, diagonal in _meeting(a, b, shared.value.get(dim, np.ones((1, dim))), distance, same):
            for i in (mine[at : at + block] for at in range(0, len(mine), block)):
                for j in (theirs[at : at + 4 * block] for at in range(0, len(theirs), 4 * block)):
                    links = _linked(a, i, b, j, cosine)
                    if diagonal:
                        links &= i[:, None] != j[None, :]
                    rows, columns = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
                    if not len(rows):
                        continue
                    few, i2, j2 = links[np.ix_(rows, columns)], i[rows], j[columns]
                    counts[0][i2] += few @ b.copies[j2].astype(np.float64)
                    if not diagonal:
                        counts[1][j2] += few.T @ a.copies[i2].astype(np.float64)
                    for p, q in _forest(few):
                        u, v = int(a.id[i2[p]]), int(b.id[j2[q]])
                        x, y = _root(parent, u), _root(parent, v)
                        if x != y:
                            parent[x] = y
                            edges.append((u, v))
        at = [np.flatnonzero(n) for n in counts]
        ids = np.concatenate([a.id[at[0]], b.id[at[1]], np.array([e[0] for e in edges], np.int64)])
        n = np.concatenate([counts[0][at[0]], counts[1][at[1]], np.zeros(len(edges))]).astype(np.int64)
        other = [None] * (len(ids) - len(edges)) + [e[1] for e in edges]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(other, pa.int64())], ["id", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)

        def load(r: dict, side: str) -> _Segment:
            n, dim = r[f"n{side}"], r["dim"]
            with fs.open_input_file(f"{root}/{r[f'file{side}']}") as f:
                return _Segment(f.read_at(n * (20 + dim * np.dtype(kind).itemsize), r[f"at{side}"]), n, dim, kind)

        name, a = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["seg1"] != name:
                    name, a = r["seg1"], load(r, "1")
                same = r["seg2"] == name
                yield product(a, a if same else load(r, "2"), same)

    return run


def _collect_garbage(spark: SparkSession) -> None:
    """Has the driver forget finished jobs, so that their shuffle files, copies of all vectors, are deleted."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@tidy
def near_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, cell: int = CELL, cells: int = CELLS, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label; more are ignored).

    Rows with equal labels and vectors of equal length are linked if their cosine is at least `cosine`. A null label, a
    null or empty vector, one with a null, NaN or infinite component and the zero vector link with nothing: n_links 0,
    own component, kept. Rows that share a vec_id are one vertex; n_links counts the other rows. A null vec_id with a
    usable vector is counted by others, but its own component is null. An empty table gives no rows.

    sample: rows that centroids are fitted on, by hash of the vector; cell: classes a cell should have; cells: most cells;
    block: rows of a product; segment: bytes of vectors that are read together.
    """
    big = F.lit(1.7976931348623157e308)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("embedding"), "label")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= big)) & F.exists("embedding", lambda x: x != 0)
    wide = F.col("embedding").cast("array<double>")
    v = v.withColumn("ok", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))
    v = v.withColumn("h1", F.when(F.col("ok"), F.xxhash64(wide))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(7), wide)))
    usable = v.where("ok")
    classes = usable.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = classes.withColumn("id", F.coalesce("least", F.xxhash64("label", "h1", "h2"))).withColumn("dim", F.size("embedding"))
    classes = stored(classes.withColumn("grp", F.xxhash64("label", "dim")), "vec-classes")

    spark = vectors.sparkSession
    _collect_garbage(spark)

    # One sample for vectors of all lengths; those of a length that isn't in it are one cell.
    # Each task sends its own least rows to the driver, so rows that can hardly be in the sample are left out before.
    share = (2 * sample + 1000) / max(1, classes.count())
    few = classes if share >= 1 else classes.where(F.col("h1") < int((share - 0.5) * 2**64))
    drawn = few.orderBy("h1", "h2").limit(sample).select("dim", "embedding").collect()
    by: dict[int, list] = {}
    for r in drawn:
        by.setdefault(r["dim"], []).append(r["embedding"])
    most = classes.where(F.col("dim").isin(list(by))).groupBy("dim", "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    centroids = {r["dim"]: fit(np.array(by[r["dim"]]), max(1, min(cells, r["n"] // cell + 1, len(by[r["dim"]])))) for r in most}
    shared = spark.sparkContext.broadcast(centroids)  # no more vectors than the sample has
    tasks, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), work_path(spark, "vec-segments")
    assigned = classes.select("grp", "id", "copies", "embedding").mapInArrow(_assign(shared, cell, segment), _ASSIGNED)
    dealt = assigned.repartition(tasks, "grp", "part").sortWithinPartitions("grp", "cell")
    index = stored(dealt.mapInArrow(_write(folder, np.dtype(kind).itemsize, segment), _INDEX), "vec-index")
    _collect_garbage(spark)

    one, two = (index.select("grp", "dim", *(F.col(c).alias(f"{c}{k}") for c in ("seg", "file", "at", "n"))) for k in "12")
    pairs = one.join(two.drop("dim"), "grp").where("seg1 <= seg2").drop("grp")
    pairs = pairs.repartition(tasks, "seg1", F.pmod(F.xxhash64("seg2"), F.lit(8))).sortWithinPartitions("seg1", "seg2")
    found = stored(pairs.mapInArrow(_products(folder, shared, cosine, block, kind), _FOUND), "vec-found")
    discard(spark, folder)

    counts = found.groupBy("id").agg(F.sum("n").alias("links"))
    edges = found.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v"))
    # Rows that share a vec_id across classes are one vertex.
    member = usable.where("vec_id is not null").select("vec_id", "label", "h1", "h2").distinct()
    twice = member.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    same = member.join(twice, "vec_id").join(classes.select("label", "h1", "h2", "id"), ["label", "h1", "h2"]).select(F.col("vec_id").alias("u"), F.col("id").alias("v"))
    labels = components(edges.unionByName(same))
    named = classes.join(counts, "id", "left").join(labels, F.col("id") == F.col("u"), "left")
    named = named.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("v", "id").alias("component"))
    out = v.select("vec_id", "label", "h1", "h2", "ok").join(named, ["label", "h1", "h2"], "left")
    component = F.when(F.col("ok") & F.col("vec_id").isNotNull(), F.col("component")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def oracle(source: str = "embeddings", cosine: float = COSINE) -> str:
    """The query as DuckDB SQL: all pairs of a label, then a recursive walk of the links."""
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM {source} WHERE label IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda y: coalesce(isfinite(y), FALSE))) AND list_bool_or(list_transform(embedding, lambda y: y <> 0))),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {cosine}),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
m AS (SELECT u, min(v) AS v FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT t.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(t.vec_id, coalesce(m.v, t.vec_id)) AS component_id, t.vec_id <= coalesce(m.v, t.vec_id) AS kept
FROM {source} t LEFT JOIN n ON t.vec_id = n.u LEFT JOIN m ON t.vec_id = m.u"""
