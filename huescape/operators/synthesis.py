"""From metrics to a palette: significance, selection, roles, pairs, scheme, distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ANCHOR, CONTRAST_L, HARMONY_CHROMA, HUE_RANGE, MIN_SHARE, MOST, PAIRS, PENALTY, SIMILAR
from ..functions import color as C
from ..functions.names import Names
from .bins import named

KEYS = ["image_id", "coarse"]


def significance(metrics: DataFrame, stable: DataFrame, stats: DataFrame) -> DataFrame:
    """metrics + stability_type, significance, is_accent, coverage_rank (from 0)."""
    m = metrics.join(stable.select(*KEYS, "stability_type"), KEYS, "left").fillna({"stability_type": "texture"})
    m = m.join(stats.select("image_id", "median_chroma", "chroma_iqr"), "image_id")
    above = F.col("chroma") - F.col("median_chroma")
    vivid = F.when((F.col("chroma_iqr") > 0) & (above > 0), F.least(F.lit(5.0), above / (F.col("chroma_iqr") + 1) * 2)).otherwise(0.0)
    alone = F.when(F.col("coverage") > 0.001, F.col("isolation") * 3).otherwise(0.0)
    steady = F.when(F.col("stability_type") == "anchor", 3.0).when(F.col("stability_type") == "gradient", 1.0).otherwise(0.0)
    score = F.round(F.col("coverage") * 100 + vivid + alone + F.col("coherence") * 5 + steady, 9)
    accent = (F.col("chroma") > F.col("median_chroma") + F.col("chroma_iqr")) & (F.col("coverage") < 0.05) & (F.col("coverage") > 0.001) & (F.col("isolation") > 0.3)
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("cnt"), "coarse")) - 1
    return m.withColumn("significance", score).withColumn("is_accent", accent).withColumn("coverage_rank", rank).drop("median_chroma", "chroma_iqr")


def selected(scored: DataFrame) -> DataFrame:
    """image_id, coarse, position (from 0): by significance, then code, each colour whose significance, less a penalty
    for being like a selected one, reaches the threshold; MOST at most. A left fold over each image's coarse bins."""
    kind = "array<struct<coarse:bigint,l:double,a:double,b:double>>"

    def fold(x: Column, floor: Column, kept: Column) -> Column:
        lab = (x["l"], x["a"], x["b"])
        nearest = F.array_min(F.transform(kept, lambda k: C.delta_e(lab, (k["l"], k["a"], k["b"]))))
        alike = F.greatest(F.lit(0.0), 1 - nearest / SIMILAR)
        penalty = F.coalesce(alike * (1 - F.least(F.lit(1.0), x["coverage"] / ANCHOR)) * PENALTY, F.lit(0.0))
        good = (F.size(kept) < MOST) & (F.round(x["score"] - penalty, 9) >= floor)
        mine = F.struct(x["coarse"].alias("coarse"), x["l"].alias("l"), x["a"].alias("a"), x["b"].alias("b"))
        return F.when(good, F.concat(kept, F.array(mine))).otherwise(kept)

    entry = F.struct((-F.col("significance")).alias("k"), F.col("coarse"), F.col("significance").alias("score"), "coverage", F.col("lab_l").alias("l"), F.col("lab_a").alias("a"), F.col("lab_b").alias("b"))
    order = scored.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("order"), F.greatest(F.lit(1.0), F.round(F.max("significance") * MIN_SHARE, 9)).alias("floor"))
    kept = F.aggregate("order", F.array().cast(kind), lambda kept, x: fold(x, F.col("floor"), kept))
    return order.select("image_id", F.posexplode(kept).alias("position", "k")).select("image_id", F.col("k.coarse").alias("coarse"), "position")


def role() -> Column:
    return (
        F.when(F.col("is_accent"), "accent").when(F.col("coverage_rank") == 0, "dominant").when(F.col("coverage_rank") <= 2, "secondary")
        .when(F.col("lab_l") < 30, "dark").when(F.col("lab_l") > 70, "light").otherwise("secondary")
    )


def characteristics() -> Column:
    parts = [
        F.when(F.col("role") == "dominant", "Largest coverage, anchors the palette").when(F.col("role") == "accent", "High chroma focal point"),
        F.when((F.col("role") == "accent") & (F.col("isolation") > 0.7), "spatially isolated"),
        F.when(F.col("stability_type") == "anchor", "Stable across scales").when(F.col("stability_type") == "texture", "Textured/varied region"),
        F.when(F.col("coherence") > 0.7, "Forms coherent region").when(F.col("coherence") < 0.3, "Scattered distribution"),
        F.when(F.col("gradient_count") > 0, F.format_string("Part of %d gradient(s)", F.col("gradient_count"))),
    ]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def notable_colors(scored: DataFrame, chosen: DataFrame, membership: DataFrame, names: Names | None = None) -> DataFrame:
    """image_id, pos (from 0), coarse, lab, rgb, hex, name, role, coverage, chroma, hue, significance, characteristics,
    gradients (indices): dominant, secondary, dark, light, accent; then by coverage, then in order of selection."""
    n = named(scored.join(chosen, KEYS), names).join(membership, KEYS, "left").fillna({"gradient_count": 0})
    n = n.withColumn("gradients", F.coalesce("gradients", F.array().cast("array<int>"))).withColumn("role", role())
    n = n.withColumn("characteristics", characteristics())
    order = F.element_at(F.create_map(*(F.lit(x) for p in zip(("dominant", "secondary", "dark", "light", "accent"), range(5), strict=True) for x in p)), F.col("role"))
    pos = F.row_number().over(Window.partitionBy("image_id").orderBy(order, F.desc("cnt"), "position")) - 1
    return n.select("image_id", pos.alias("pos"), "coarse", "lab_l", "lab_a", "lab_b", "r", "g", "b", "hex", "name", "role", "cnt", "coverage", "chroma", "hue", "significance", "characteristics", "gradient_count", "gradients")


def _pairs(notable: DataFrame, condition: Column) -> DataFrame:
    """Pairs of an image's notable colours in order; there are at most MOST of them, so 45 pairs an image."""
    return notable.alias("p").join(notable.alias("q"), (F.col("p.image_id") == F.col("q.image_id")) & (F.col("p.pos") < F.col("q.pos")) & condition)


def contrast_pairs(notable: DataFrame) -> DataFrame:
    """image_id, pair (from 0), color_a, color_b, delta_l, ratio, wcag_level: the greatest contrasts."""
    far = F.abs(F.col("p.lab_l") - F.col("q.lab_l"))
    p = _pairs(notable, far > CONTRAST_L)
    ratio = F.round(C.contrast_ratio(*(tuple(F.col(f"{s}.{c}") for c in "rgb") for s in "pq")), 9)
    p = p.select("p.image_id", F.col("p.pos").alias("i"), F.col("q.pos").alias("j"), F.col("p.name").alias("color_a"), F.col("q.name").alias("color_b"), far.alias("delta_l"), ratio.alias("ratio"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("ratio"), "i", "j")) - 1
    return p.withColumn("pair", rank).where(F.col("pair") < PAIRS).select("image_id", "pair", "color_a", "color_b", "delta_l", "ratio", C.wcag_level(F.col("ratio")).alias("wcag_level"))


def harmonic_pairs(notable: DataFrame) -> DataFrame:
    """image_id, pair (from 0), color_a, color_b, hue_difference: the first pairs of like hue and different names."""
    far = C.hue_distance(F.col("p.hue"), F.col("q.hue"))
    p = _pairs(notable.where(F.col("chroma") >= HARMONY_CHROMA), (F.col("p.name") != F.col("q.name")) & (far < HUE_RANGE))
    p = p.select("p.image_id", F.col("p.pos").alias("i"), F.col("q.pos").alias("j"), F.col("p.name").alias("color_a"), F.col("q.name").alias("color_b"), far.alias("hue_difference"))
    first = F.row_number().over(Window.partitionBy("image_id", F.least("color_a", "color_b"), F.greatest("color_a", "color_b")).orderBy("i", "j"))
    p = p.withColumn("n", first).where("n = 1")
    p = p.withColumn("pair", F.row_number().over(Window.partitionBy("image_id").orderBy("i", "j")) - 1)
    return p.where(F.col("pair") < PAIRS).select("image_id", "pair", "color_a", "color_b", "hue_difference")


def distribution(notable: DataFrame) -> DataFrame:
    """image_id, n_colors, accents, distribution."""
    pct = F.col("coverage") * 100
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("cnt"), "pos"))
    n = notable.withColumn("rank", rank).groupBy("image_id").agg(
        F.count("*").alias("n_colors"), F.count_if(F.col("role") == "accent").alias("accents"), F.round(F.max(pct), 9).alias("d"),
        F.round(F.coalesce(F.sum(F.when(F.col("role") == "accent", pct)), F.lit(0.0)), 9).alias("a"),
        F.round(F.coalesce(F.sum(F.when(F.col("role") != "accent", pct)), F.lit(0.0)), 9).alias("s"), F.round(F.sum(F.when(F.col("rank") <= 3, pct)), 9).alias("top3"),
    )
    rest = F.round(F.col("s") - F.col("d"), 9)
    text = (
        F.when((F.col("d") >= 15) & (F.col("a") < 1), F.format_string("Dominant-led: %s%% primary, %s%% supporting", C.fixed0(F.col("d")), C.fixed0(rest)))
        .when(F.col("d") >= 15, F.format_string("Structured: %s%% dominant, %s%% secondary, %s%% accent", C.fixed0(F.col("d")), C.fixed0(rest), C.fixed1(F.col("a"))))
        .when(F.col("top3") >= 40, F.format_string("Tiered: Top 3 colors cover %s%% of image", C.fixed0(F.col("top3"))))
        .otherwise(F.format_string("Distributed: %d colors share coverage", F.col("n_colors")))
    )
    return n.select("image_id", "n_colors", "accents", text.alias("distribution"))


def scheme(fams: DataFrame, stats: DataFrame, dist: DataFrame) -> DataFrame:
    """image_id, scheme_type, scheme_description, n_colors, distribution, ranges of lightness and chroma: the summary."""
    hues = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_neutral"), F.struct("family_idx", "hue_center")))), lambda x: x["hue_center"])
    f = fams.groupBy("image_id").agg(hues.alias("h"), F.coalesce(F.max(F.when(F.col("is_neutral"), F.col("coverage"))), F.lit(0.0)).alias("grey"))
    s = stats.join(f, "image_id", "left").join(dist, "image_id", "left").fillna({"n_colors": 0, "accents": 0, "distribution": "No significant colors detected"})
    h, n, accents = F.coalesce("h", F.array().cast("array<double>")), F.size(F.coalesce("h", F.array().cast("array<double>"))), F.col("accents") > 0
    up = F.array_sort(h)
    one, two = C.fixed0(F.get(h, F.lit(0))), C.fixed0(F.get(h, F.lit(1)))
    apart = C.hue_distance(F.get(h, F.lit(0)), F.get(h, F.lit(1)))
    least = C.hue_distance(F.get(up, F.lit(0)), F.get(up, F.lit(1)))
    at = lambda i: F.get(up, F.lit(i))
    third = lambda d: (d > 80) & (d < 160)
    rules = [
        (n == 0, "achromatic", F.lit("Grayscale palette with no chromatic content")),
        ((n == 1) & accents & (F.col("grey") > 0.5), "neutral_accent", F.format_string("Neutral base with %s° accent", one)),
        (n == 1, "monochromatic", F.format_string("Single hue family around %s°", one)),
        ((n == 2) & (apart < 60), "analogous", F.format_string("Adjacent hues (%s° and %s°)", one, two)),
        ((n == 2) & (apart > 150) & (apart < 210), "complementary", F.format_string("Opposing hues (%s° and %s°)", one, two)),
        ((n == 3) & third(at(1) - at(0)) & third(at(2) - at(1)) & third(at(0) + 360 - at(2)), "triadic", F.lit("Three hues roughly 120° apart")),
        ((n >= 2) & (least < 60) & accents, "analogous_accent", F.lit("Analogous base with contrasting accent")),
    ]
    kind, text = F.lit("complex"), F.format_string("Multi-hue palette with %d color families", n)
    for condition, name, description in reversed(rules):
        kind, text = F.when(condition, name).otherwise(kind), F.when(condition, description).otherwise(text)
    return s.select("image_id", kind.alias("scheme_type"), text.alias("scheme_description"), "n_colors", "distribution", "l_min", "l_max", "chroma_min", "chroma_max")
