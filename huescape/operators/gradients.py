"""Gradients: chains of fine bins that follow each other in one direction of the image."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DIRECTIONS, FINE, HUE_RANGE, MAX_TURN, MIN_ASYMMETRY, MIN_CHAIN, MIN_EDGES, MIN_SPAN, MOST, SEEDS, STOP_CHROMA
from ..functions import color as C

#: Axes: direction if the flow is positive, direction if negative.
AXES = {"h": ("right", "left"), "v": ("below", "above"), "dr": ("down_right", "up_left"), "dl": ("down_left", "up_right")}


def flow(directed: DataFrame, min_edges: int = MIN_EDGES) -> DataFrame:
    """image_id, src, nbr, total, and for each axis its flow and asymmetry (one count of smoothing)."""
    f = directed.withColumn("total", sum((F.col(d) for d in DIRECTIONS[1:]), F.col(DIRECTIONS[0]))).where(F.col("total") >= min_edges)
    columns = []
    for axis, (ahead, back) in AXES.items():
        difference, both = F.col(ahead) - F.col(back), F.col(ahead) + F.col(back)
        columns += [difference.alias(f"{axis}_flow"), F.when(both > 0, F.abs(difference) / (both + 1)).otherwise(0.0).alias(f"{axis}_asymmetry")]
    return f.select("image_id", "src", "nbr", "total", *columns)


def flow_edges(flows: DataFrame, coherent: DataFrame, min_asymmetry: float = MIN_ASYMMETRY) -> DataFrame:
    """image_id, src, dir, nbr, weight, total: one-sided flows, weighted by both bins' coherence (their coarse bins')."""
    axis = [F.struct(F.col(f"{a}_flow").alias("flow"), F.col(f"{a}_asymmetry").alias("asymmetry"), F.lit(p).alias("ahead"), F.lit(n).alias("back")) for a, (p, n) in AXES.items()]
    e = flows.select("image_id", "src", "nbr", "total", F.explode(F.filter(F.array(*axis), lambda x: x["asymmetry"] > min_asymmetry)).alias("x"))
    for end in ("src", "nbr"):
        e = e.withColumn("coarse", C.coarse_of(F.col(end))).join(coherent.withColumnRenamed("coherence", f"c_{end}"), ["image_id", "coarse"], "left").drop("coarse")
    both = F.coalesce("c_src", F.lit(1.0)) * F.coalesce("c_nbr", F.lit(1.0))
    way = F.when(F.col("x.flow") > 0, F.col("x.ahead")).otherwise(F.col("x.back"))
    return e.select("image_id", "src", way.alias("dir"), "nbr", F.round(F.abs("x.flow") * F.sqrt(both), 9).alias("weight"), "total")


def flow_lists(edges: DataFrame) -> DataFrame:
    """image_id, dir, src, nbrs: neighbours by weight (greatest first), then code."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("nbr").alias("nbr"))))
    return edges.groupBy("image_id", "dir", "src").agg(F.transform(order, lambda x: x["nbr"]).alias("nbrs"))


def lab_extremes(fine: DataFrame) -> DataFrame:
    """image_id, fine: bins that are least or greatest in L, a or b; of equal ones that of the smallest code."""
    axes = dict(zip("lab", C.decode(F.col("fine")), strict=True))
    ends = [F.min_by("fine", F.struct(sign * v, F.col("fine"))) for v in axes.values() for sign in (1, -1)]
    return fine.groupBy("image_id").agg(F.array(*ends).alias("e")).select("image_id", F.explode(F.array_distinct("e")).alias("fine"))


def seed_scores(fine: DataFrame, coarse: DataFrame, edges: DataFrame, extremes: DataFrame, coherent: DataFrame) -> DataFrame:
    """image_id, fine, cnt, total, contrast, is_extreme, coherence, score, seed_rank (from 0). Without any flow contrast is 0."""
    far = C.delta_e(C.centre(F.col("src")), C.centre(F.col("nbr")))
    pairs = edges.select("image_id", "src", "nbr").distinct()
    contrast = pairs.groupBy("image_id", F.col("src").alias("fine")).agg(F.round(F.avg(far), 9).alias("contrast"))
    totals = coarse.select("image_id", "total").distinct()
    s = fine.join(totals, "image_id").join(contrast, ["image_id", "fine"], "left").fillna({"contrast": 0.0})
    s = s.join(extremes.withColumn("is_extreme", F.lit(True)), ["image_id", "fine"], "left").fillna({"is_extreme": False})
    s = s.join(coherent, ["image_id", "coarse"], "left").withColumn("coherence", F.coalesce("coherence", F.lit(0.5)))
    most = F.max("contrast").over(Window.partitionBy("image_id"))
    share = F.when(most > 0, F.col("contrast") / most).otherwise(0.0)
    score = (F.col("cnt") / F.col("total") * 10 + share * 0.3 + F.when(F.col("is_extreme"), 0.2).otherwise(0.0)) * F.col("coherence")
    s = s.withColumn("score", F.round(score, 9))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "fine")) - 1
    return s.select("image_id", "fine", "cnt", "total", "contrast", "is_extreme", "coherence", "score", rank.alias("seed_rank"))


_BOUNDS = [f"{c}_{n}" for c in "lab" for n in ("lo", "hi")]
_CHAINS = "image_id long, dir_rank int, seed_rank int, chain array<long>, length long, covered long, coverage double, score long, cand_rank int, kept boolean, " + ", ".join(f"{b} long" for b in _BOUNDS)


def _inside(lo: int, hi: int, lo2: int, hi2: int) -> bool:
    """Whether at least half of [lo, hi] lies in [lo2, hi2]; of a point, whether it does."""
    return lo2 <= lo <= hi2 if hi == lo else max(0, min(hi, hi2) - max(lo, lo2)) * 2 >= hi - lo


def _walk(most_seeds: int, min_length: int, most: int):
    """One image a row: from each seed in each direction on to the strongest neighbour that was not yet visited. Chains
    are ranked by length times pixels, then direction, then seed; kept: the first `most` in order of rank that no kept
    one before covers by half in L, a and b alike."""

    def image(row: dict) -> list[tuple]:
        graph = {(x["dir"], x["src"]): x["nbrs"] for x in row["lists"]}
        pixels = {x["fine"]: (x["cnt"], x["l"], x["a"], x["b"]) for x in row["bins"]}
        made = []
        for d, name in enumerate(DIRECTIONS):
            for rank, seed in enumerate(row["seeds"][:most_seeds]):
                chain, seen, now = [seed["fine"]], {seed["fine"]}, seed["fine"]
                while (now := next((n for n in graph.get((name, now), ()) if n not in seen), None)) is not None:
                    chain.append(now)
                    seen.add(now)
                if len(chain) >= min_length:
                    cnt, *axes = zip(*(pixels[c] for c in chain), strict=True)
                    made.append((-len(chain) * sum(cnt), d, rank, chain, sum(cnt), [f(v) for v in axes for f in (min, max)]))
        out, taken = [], []
        for place, (score, d, rank, chain, covered, bounds) in enumerate(sorted(made, key=lambda x: x[:3]), 1):
            inside = any(all(_inside(*bounds[k : k + 2], *other[k : k + 2]) for k in (0, 2, 4)) for other in taken)
            kept = len(taken) < most and not inside
            taken += [bounds] if kept else []
            out.append((row["image_id"], d, rank, chain, len(chain), covered, covered / row["total"], -score, place, kept, *bounds))
        return out

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                out = image(batch.slice(at, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _CHAINS.split(", ")])

    return run


def flow_chains(lists: DataFrame, seeds: DataFrame, most_seeds: int = SEEDS, min_length: int = MIN_CHAIN, most: int = MOST) -> DataFrame:
    """image_id, dir_rank, seed_rank, chain, length, covered (pixels), coverage, score, cand_rank (from 1), kept, lo and
    hi of L, a and b in bins. seeds: all bins of an image with their ranks.

    What an image brings to the walk is bounded by its bins and their one-sided edges."""
    graph = lists.groupBy("image_id").agg(F.collect_list(F.struct("dir", "src", "nbrs")).alias("lists"))
    axes = dict(zip("lab", C.decode(F.col("fine")), strict=True))
    ranked = F.array_sort(F.collect_list(F.when(F.col("seed_rank") < most_seeds, F.struct("seed_rank", "fine"))))
    each = F.collect_list(F.struct("fine", "cnt", *(v.cast("long").alias(c) for c, v in axes.items())))
    bins = seeds.groupBy("image_id").agg(ranked.alias("seeds"), each.alias("bins"), F.first("total").alias("total"))
    return graph.join(bins, "image_id").repartition("image_id").mapInArrow(_walk(most_seeds, min_length, most), _CHAINS)


def deduped(chains: DataFrame) -> DataFrame:
    """The chains that are kept."""
    return chains.where("kept")


def mean_turn(chain: Column) -> Column:
    """The mean angle in degrees between steps of a chain; null if it has fewer than three bins. A bin occurs once, so no
    step has length 0."""
    points = F.transform(chain, lambda c: F.struct(*(v.alias(n) for n, v in zip("lab", C.centre(c), strict=True))))

    def angle(p: Column, i: Column) -> Column:
        a, b, c = F.get(p, i), F.get(p, i + 1), F.get(p, i + 2)
        u, v = [b[x] - a[x] for x in "lab"], [c[x] - b[x] for x in "lab"]
        dot = lambda s, t: s[0] * t[0] + s[1] * t[1] + s[2] * t[2]
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / (F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)))))))

    angles = F.get(F.transform(F.array(points), lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 3), lambda i: angle(p, i))), F.lit(0))
    mean = F.aggregate(angles, F.lit(0.0), lambda x, y: x + y) / F.size(angles)
    return F.when(F.size(chain) >= 3, mean)


def gradients(kept: DataFrame) -> DataFrame:
    """Of deduped chains, those with two stops or more, enough span and a smooth course: image_id, gradient_idx (from 0),
    direction, chain, stops (distinct coarse bins in order), coverage, mean_turn, lo and hi of L, a, b in bins."""
    way = F.element_at(F.array(*(F.lit(x) for x in ("horizontal", "horizontal", "vertical", "vertical", "diagonal", "anti-diagonal", "anti-diagonal", "diagonal"))), F.col("dir_rank") + 1)
    g = kept.withColumn("stops", F.array_distinct(F.transform("chain", C.coarse_of))).withColumn("mean_turn", F.round(mean_turn(F.col("chain")), 9))
    span = (F.col("l_hi") - F.col("l_lo") + F.col("a_hi") - F.col("a_lo") + F.col("b_hi") - F.col("b_lo")) * FINE
    g = g.where((F.size("stops") >= 2) & (F.round(span, 9) >= MIN_SPAN) & (F.col("mean_turn").isNull() | (F.col("mean_turn") < MAX_TURN)))
    idx = F.row_number().over(Window.partitionBy("image_id").orderBy("cand_rank")) - 1
    return g.select("image_id", idx.alias("gradient_idx"), way.alias("direction"), "chain", "stops", "coverage", "mean_turn", *(f"{c}_{n}" for c in "lab" for n in ("lo", "hi")))


def gradient_membership(found: DataFrame) -> DataFrame:
    """image_id, coarse, gradient_count, gradients (indices)."""
    stops = found.select("image_id", "gradient_idx", F.explode("stops").alias("coarse"))
    return stops.groupBy("image_id", "coarse").agg(F.count("*").alias("gradient_count"), F.array_sort(F.collect_list("gradient_idx")).alias("gradients"))


def family_span(found: DataFrame, coarse: DataFrame, fams: DataFrame) -> DataFrame:
    """image_id, gradient_idx, family_span: for each stop of enough chroma the first chromatic family within HUE_RANGE."""
    stops = found.select("image_id", "gradient_idx", F.explode("stops").alias("coarse"))
    near = fams.where(~F.col("is_neutral")).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("family_idx", "hue_center"))).alias("fams"))
    s = stops.join(coarse.select("image_id", "coarse", "chroma", "hue"), ["image_id", "coarse"]).join(near, "image_id", "left")
    hit = F.array_min(F.transform(F.filter("fams", lambda f: C.hue_distance(f["hue_center"], F.col("hue")) <= HUE_RANGE), lambda f: f["family_idx"]))
    s = s.withColumn("hit", F.when(F.col("chroma") >= STOP_CHROMA, hit))
    return s.groupBy("image_id", "gradient_idx").agg(F.array_sort(F.collect_set("hit")).alias("family_span"))
