"""Which bins touch which, and how often in which direction; how scattered each coarse bin is.

Both work on bands of rows. A band's rows lie together, with the row below the band as a halo, so that every neighbour
is found by window functions after one shuffle of the pixels, and no image is ever larger than a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DIRECTIONS
from ..functions import color as C
from .groups import by_group

BAND = 64
#: Forward steps: direction, its opposite, columns, and the coordinate that is constant along it.
_STEPS = (("right", "left", 0, 1, "y"), ("below", "above", 1, 0, "x"), ("down_right", "up_left", 1, 1, "x - y"), ("down_left", "up_right", 1, -1, "x + y"))


def bands(bins: DataFrame) -> DataFrame:
    """image_id, band, halo, y, x, fine, coarse, in partitions by (image_id, band)."""
    own = F.expr(f"y div {BAND}")
    copies = F.when((F.col("y") % BAND == 0) & (F.col("y") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    b = bins.select("image_id", "y", "x", "fine", "coarse", F.posexplode(copies).alias("n", "band"))
    return b.select("image_id", "band", (F.col("n") > 0).alias("halo"), "y", "x", "fine", "coarse").repartition("image_id", "band")


def directional(banded: DataFrame) -> DataFrame:
    """image_id, src, nbr, and for each of DIRECTIONS how many pixels of src have one of nbr there. src and nbr differ."""
    steps = []
    for ahead, _, dy, dx, line in _STEPS:
        w = Window.partitionBy("image_id", "band", F.expr(line)).orderBy("x" if dy == 0 else "y")
        there = (F.lead("y").over(w) == F.col("y") + dy) & (F.lead("x").over(w) == F.col("x") + dx)
        steps.append(F.when(there & ~F.col("halo"), F.lead("fine").over(w)).alias(ahead))
    near = banded.select("image_id", "fine", *steps)
    each = F.array(*(F.struct(F.lit(i).alias("d"), F.col(ahead).alias("nbr")) for i, (ahead, *_) in enumerate(_STEPS)))
    edges = near.select("image_id", F.col("fine").alias("src"), F.explode(F.filter(each, lambda e: e["nbr"] != F.col("fine"))).alias("e"))
    counted = edges.groupBy("image_id", "src", F.col("e.nbr").alias("nbr"), F.col("e.d").alias("d")).agg(F.count("*").alias("n"))
    # The same edge seen from its other end goes the other way.
    seen = counted.select("image_id", F.explode(F.array(
        F.struct(F.col("src").alias("src"), F.col("nbr").alias("nbr"), F.col("d").alias("d"), F.lit(True).alias("ahead"), F.col("n").alias("n")),
        F.struct(F.col("nbr").alias("src"), F.col("src").alias("nbr"), F.col("d").alias("d"), F.lit(False).alias("ahead"), F.col("n").alias("n")),
    )).alias("e")).select("image_id", "e.*")
    name = {ahead: (i, True) for i, (ahead, *_) in enumerate(_STEPS)} | {back: (i, False) for i, (_, back, *_) in enumerate(_STEPS)}
    sums = [F.sum(F.when((F.col("d") == name[d][0]) & (F.col("ahead") == name[d][1]), F.col("n")).otherwise(0)).alias(d) for d in DIRECTIONS]
    return seen.groupBy("image_id", "src", "nbr").agg(*sums)


def adjacency(directed: DataFrame) -> DataFrame:
    """image_id, b1, b2, cnt: edges between two bins, counted from both ends."""
    total = sum((F.col(d) for d in DIRECTIONS[1:]), F.col(DIRECTIONS[0]))
    return directed.where("src < nbr").select("image_id", F.col("src").alias("b1"), F.col("nbr").alias("b2"), (total * 2).alias("cnt"))


def neighbours(adjacent: DataFrame) -> DataFrame:
    """image_id, coarse, other: distinct pairs of coarse bins that touch, both ways."""
    p = adjacent.select("image_id", C.coarse_of(F.col("b1")).alias("c1"), C.coarse_of(F.col("b2")).alias("c2")).where("c1 <> c2")
    both = F.array(F.struct(F.col("c1").alias("coarse"), F.col("c2").alias("other")), F.struct(F.col("c2").alias("coarse"), F.col("c1").alias("other")))
    return p.select("image_id", F.explode(both).alias("e")).select("image_id", "e.*").distinct()


def neighbour_metrics(coarse: DataFrame, near: DataFrame) -> DataFrame:
    """image_id, coarse, n_neighbours, local_contrast (mean distance to neighbours' centres), isolation."""
    from ..constants import COARSE

    far = C.delta_e(C.centre(F.col("coarse"), COARSE), C.centre(F.col("other"), COARSE))
    n = near.groupBy("image_id", "coarse").agg(F.count("*").alias("n_neighbours"), F.avg(far).alias("local_contrast"))
    m = coarse.select("image_id", "coarse").join(n, ["image_id", "coarse"], "left").fillna({"n_neighbours": 0, "local_contrast": 0.0})
    most = F.max("n_neighbours").over(Window.partitionBy("image_id"))
    return m.select("image_id", "coarse", "n_neighbours", F.round("local_contrast", 9).alias("local_contrast"), (1 - F.col("n_neighbours") / (most + 1)).alias("isolation"))


def changes(*columns: np.ndarray) -> np.ndarray:
    """A number for each row that grows by one wherever any of the columns changes."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def touching(y: np.ndarray, code: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of one code, in rows one after the other, that have pixels in touch (also by corners). Runs are in
    order of (code, y, x0)."""
    rank = changes(code)
    rows, wide = y - y.min(), int(x1.max() - x0.min()) + 4
    base = (rank * (int(rows.max()) + 2) + rows) * wide - x0.min() + 1  # with room beside each row, and a row below each code
    low, high = np.searchsorted(base + x1, base + wide + x0 - 1, side="left"), np.searchsorted(base + x0, base + wide + x1 + 1, side="right")
    n = np.maximum(0, high - low)
    above = np.repeat(np.arange(len(y)), n)
    return above, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each one's component, of 0 .. n - 1 with edges a, b: greater roots are hung below lesser ones, and
    paths are cut short, until no edge joins two components."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = low != high
        if not live.any():
            return root
        a, b = a[live], b[live]
        np.minimum.at(root, high[live], low[live])
        while (root[root] != root).any():
            root = root[root]


_PARTS = "image_id long, coarse long, y long, x0 long, x1 long, part long, size long, pixels long"


def _label_bands(rows: int):
    """Of bands of so many rows, in order of (y, x): a row for each run at a seam to another band, with its component (of an
    image, no two have the same number) and that one's size, and a row (y null) for each bin of a band, with the size of its
    largest component away from seams and its pixels."""

    def run(t: pa.Table) -> pa.RecordBatch:
        image, band, y, x, code = (t.column(c).to_numpy() for c in ("image_id", "band", "y", "x", "coarse"))
        group = changes(image, band)
        broken = np.zeros(len(x), np.int64)
        broken[1:] = np.cumsum(x[1:] != x[:-1] + 1)
        begin = np.flatnonzero(np.diff(changes(group, y, code, broken), prepend=-1))
        x1 = x[np.append(begin[1:], len(x)) - 1]
        order = np.lexsort((x[begin], y[begin], code[begin], group[begin]))
        image, band, y, x0, code, group = (v[begin][order] for v in (image, band, y, x, code, group))
        x1 = x1[order]
        bin_ = changes(group, code)
        part = joined(len(y), *touching(y, bin_, x0, x1))
        length = x1 - x0 + 1
        size = np.bincount(part, length, len(y)).astype(np.int64)[part]
        seam = ((y == band * rows) & (y > 0)) | (y == band * rows + rows - 1)
        open_ = np.zeros(len(y), bool)
        open_[part[seam]] = True
        cuts = np.flatnonzero(np.diff(bin_, prepend=-1))
        inner = np.maximum.reduceat(np.where(open_[part], 0, size), cuts)
        pixels = np.add.reduceat(length, cuts)
        at, none = np.flatnonzero(seam), np.zeros(len(cuts), np.int64)
        number = part[at].astype(np.int64) + (band[at] << 32)
        both = lambda v, w: np.concatenate([v, w])
        columns = [both(image[at], image[cuts]), both(code[at], code[cuts]), *(both(v[at], none) for v in (y, x0, x1)), both(number, none), both(size[at], inner), both(np.zeros(len(at), np.int64), pixels)]
        made = [pa.array(c, pa.int64()) for c in columns]
        made[2] = pa.array(columns[2], pa.int64(), mask=np.arange(len(columns[2])) >= len(at))
        return pa.RecordBatch.from_arrays(made, [c.split()[0] for c in _PARTS.split(", ")])

    return run


def _join_seams(t: pa.Table) -> pa.RecordBatch:
    """Bins of images: the largest component of each, with those of bands joined across seams, and all pixels."""
    whole = t.column("y").is_null().to_numpy()
    image, code, y, x0, x1, part, size, pixels = (t.column(c).fill_null(0).to_numpy() for c in ("image_id", "coarse", "y", "x0", "x1", "part", "size", "pixels"))
    group = changes(image, code)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    largest = np.zeros(len(first), np.int64)
    np.maximum.at(largest, group[whole], size[whole])
    total = np.bincount(group, pixels, len(first)).astype(np.int64)
    at = np.flatnonzero(~whole)
    if len(at):
        at = at[np.lexsort((x0[at], y[at], group[at]))]
        a, b = touching(y[at], group[at], x0[at], x1[at])
        # Components of bands are what is joined: their numbers hold within an image.
        by = np.lexsort((part[at], group[at]))
        node = np.empty(len(at), np.int64)
        node[by] = changes(group[at][by], part[at][by])
        one = at[by][np.flatnonzero(np.diff(node[by], prepend=-1))]
        root = joined(len(one), node[a], node[b])
        np.maximum.at(largest, group[one], np.bincount(root, size[one], len(one)).astype(np.int64)[root])
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (image[first], code[first], largest, total)], ["image_id", "coarse", "largest", "pixels"])


def coherence(bins: DataFrame) -> DataFrame:
    """image_id, coarse, coherence: the share of a bin's pixels in its largest 8-connected component.

    Components are found in bands of rows, by whole arrays; what meets at seams between bands is then joined for each bin
    of an image. A task holds a band, or the runs of one bin along seams (one row in 32), never an image."""
    b = bins.select("image_id", F.expr(f"y div {BAND}").alias("band"), "y", "x", "coarse").repartition("image_id", "band").sortWithinPartitions("image_id", "band", "y", "x")
    parts = b.mapInArrow(by_group(_label_bands(BAND), "image_id", "band"), _PARTS)
    parts = parts.repartition("image_id", "coarse").sortWithinPartitions("image_id", "coarse")
    found = parts.mapInArrow(by_group(_join_seams, "image_id", "coarse"), "image_id long, coarse long, largest long, pixels long")
    return found.select("image_id", "coarse", (F.col("largest") / F.col("pixels")).alias("coherence"))


def color_metrics(coarse: DataFrame, near: DataFrame, coherent: DataFrame) -> DataFrame:
    """Coarse bins with local_contrast, isolation, coherence."""
    keys = ["image_id", "coarse"]
    return coarse.join(near.select(*keys, "local_contrast", "isolation"), keys).join(coherent, keys)
