"""Pixels to bins, and what follows from bins alone: stability, chroma statistics, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COARSE, FINE, HUE_RANGE
from ..functions import color as C
from ..functions.names import Names, nearest_name


def binned(pixels: DataFrame) -> DataFrame:
    """image_id, y, x, fine, coarse, and lab_l, lab_a, lab_b, of pixels(image_id, y, x, r, g, b)."""
    p = C.with_lab(pixels.select("image_id", "y", "x", "r", "g", "b")).drop("r", "g", "b")
    codes = {name: C.encode(*(C.quantise(F.col(f"lab_{c}"), size) for c in "lab")) for name, size in (("fine", FINE), ("coarse", COARSE))}
    return p.withColumns(codes)


def images(bins: DataFrame) -> DataFrame:
    """image_id, height, width, total_pixels."""
    size = lambda c: (F.max(c) - F.min(c) + 1).alias
    return bins.groupBy("image_id").agg(size("y")("height"), size("x")("width"), F.count("*").alias("total_pixels"))


def fine_bins(bins: DataFrame) -> DataFrame:
    """image_id, fine, coarse, cnt. One shuffle of partial counts; all later steps on bins start from here. (A fine bin
    lies in one coarse bin, so grouping by both is grouping by the fine one.)"""
    return bins.groupBy("image_id", "fine", "coarse").agg(F.count("*").alias("cnt"))


def coarse_bins(fine: DataFrame) -> DataFrame:
    """image_id, coarse, cnt, total, coverage, lab_l, lab_a, lab_b (of the bin's centre), chroma, hue."""
    c = fine.groupBy("image_id", "coarse").agg(F.sum("cnt").alias("cnt"))
    total = c.groupBy("image_id").agg(F.sum("cnt").alias("total"))
    l, a, b = C.centre(F.col("coarse"), COARSE)  # noqa: E741
    c = c.join(total, "image_id").select("image_id", "coarse", "cnt", "total", (F.col("cnt") / F.col("total")).alias("coverage"), l.alias("lab_l"), a.alias("lab_a"), b.alias("lab_b"))
    return c.withColumn("chroma", C.chroma(F.col("lab_a"), F.col("lab_b"))).withColumn("hue", C.hue(F.col("lab_a"), F.col("lab_b")))


def named(bins: DataFrame, names: Names | None = None) -> DataFrame:
    """bins (lab_l, lab_a, lab_b) + r, g, b, hex, name."""
    lab = tuple(F.col(f"lab_{c}") for c in "lab")
    return C.with_rgb(bins).withColumn("hex", C.to_hex(F.col("r"), F.col("g"), F.col("b"))).withColumn("name", nearest_name(*lab, names))


def stability(fine: DataFrame) -> DataFrame:
    """image_id, coarse, stability_type, fine_count, fine_variance, dominant_axis (null but for gradients).

    Up to two fine bins are an anchor. Of more, the population variances of their centres decide: an axis with over half
    of the sum makes a gradient. (Along a sorted axis differences never fall, so that test of the rule always holds.)"""
    l, a, b = C.centre(F.col("fine"))  # noqa: E741
    g = fine.withColumns({"l": l, "a": a, "b": b}).groupBy("image_id", "coarse").agg(F.count("*").alias("fine_count"), *(F.var_pop(c).alias(f"v{c}") for c in "lab"))
    total = F.round(F.col("vl") + F.col("va") + F.col("vb"), 9)
    most = F.greatest("vl", "va", "vb")
    axis = F.when(F.round(F.col("vl"), 9) >= F.round(most, 9), "L").when(F.round(F.col("va"), 9) >= F.round(most, 9), "a").otherwise("b")
    many = F.col("fine_count") > 2
    steep = many & (F.round(most / (total + 1e-10), 9) > 0.5)
    kind = F.when(~many, "anchor").when(steep, "gradient").otherwise("texture")
    return g.select("image_id", "coarse", kind.alias("stability_type"), "fine_count", F.when(many, total).otherwise(0.0).alias("fine_variance"), F.when(steep, axis).alias("dominant_axis"))


def chroma_stats(coarse: DataFrame) -> DataFrame:
    """image_id, median_chroma, chroma_iqr, chroma_floor (of families), and ranges of lightness and chroma."""
    q = F.percentile("chroma", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = coarse.groupBy("image_id").agg(q.alias("q"), *(f(c).alias(f"{c.removeprefix('lab_')}_{n}") for c in ("lab_l", "chroma") for n, f in (("min", F.min), ("max", F.max))))
    median = F.col("q")[1]
    return s.select("image_id", median.alias("median_chroma"), (F.col("q")[2] - F.col("q")[0]).alias("chroma_iqr"), F.greatest(F.lit(10.0), median * 0.5).alias("chroma_floor"), "l_min", "l_max", "chroma_min", "chroma_max")


def family_members(coarse: DataFrame, stats: DataFrame) -> DataFrame:
    """coarse bins + family_idx and seed_hue (null for the neutral family, which is last).

    Chromatic bins by coverage, then code: one that no earlier seed is within HUE_RANGE of becomes a seed, the others go
    to the earliest such seed. Seeds come from a left fold over each image's bins: there can't be more than 13 of them."""
    c = coarse.join(stats.select("image_id", "chroma_floor"), "image_id").withColumn("neutral", F.col("chroma") < F.col("chroma_floor"))

    def fold(seeds: Column, x: Column) -> Column:
        taken = F.exists(seeds, lambda s: C.hue_distance(s, x["hue"]) <= HUE_RANGE)
        return F.when(taken, seeds).otherwise(F.concat(seeds, F.array(x["hue"])))

    by_size = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("k"), F.col("coarse").alias("code"), F.col("hue").alias("hue"))))
    seeds = c.where(~F.col("neutral")).groupBy("image_id").agg(by_size.alias("order"))
    seeds = seeds.select("image_id", F.aggregate("order", F.array().cast("array<double>"), fold).alias("seeds"))
    m = c.join(seeds, "image_id", "left").withColumn("seeds", F.coalesce("seeds", F.array().cast("array<double>")))
    near = F.transform("seeds", lambda s, i: F.when(C.hue_distance(s, F.col("hue")) <= HUE_RANGE, i))
    idx = F.when(F.col("neutral"), F.size("seeds")).otherwise(F.array_min(near))
    m = m.withColumn("family_idx", idx.cast("int"))
    return m.withColumn("seed_hue", F.when(~F.col("neutral"), F.get("seeds", F.col("family_idx")))).drop("seeds", "chroma_floor")


def families(members: DataFrame) -> DataFrame:
    """image_id, family_idx, is_neutral, hue_center, l_min, l_max, chroma_min, chroma_max, coverage, members."""
    radians = F.radians("hue")
    center = F.pmod(F.degrees(F.atan2(F.sum(F.sin(radians)), F.sum(F.cos(radians)))), F.lit(360.0))
    return members.groupBy("image_id", "family_idx", F.col("neutral").alias("is_neutral")).agg(
        F.when(F.first("neutral"), 0.0).otherwise(center).alias("hue_center"), F.min("lab_l").alias("l_min"), F.max("lab_l").alias("l_max"),
        F.min("chroma").alias("chroma_min"), F.max("chroma").alias("chroma_max"), (F.sum("cnt") / F.first("total")).alias("coverage"), F.array_sort(F.collect_list("coarse")).alias("members"),
    )
