"""Queries by name, and their SQL. Doubles are rounded to six decimals on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.names import css_names
from ..sources import images
from ..sources.fixtures import MORE, further, pixels, widened, write_images, write_odd
from ..store import discard, stored, tidy, work_path
from .oracle import sql
from .palette import Palette

LAB = "lab_l lab_a lab_b"
BOUNDS = "l_lo l_hi a_lo a_hi b_lo b_hi"
#: query: relation of Palette, its columns (those of doubles with a mark), relation of the SQL
TABLES: dict[str, tuple[str, str, str]] = {
    "lab_pixels": ("lab_pixels", "image_id y x ~lab_l ~lab_a ~lab_b fine coarse", "px"),
    "images": ("images", "image_id height width total_pixels", "(SELECT image_id, max(y) - min(y) + 1 AS height, max(x) - min(x) + 1 AS width, count(*) AS total_pixels FROM px GROUP BY image_id)"),
    "fine_bins": ("fine_bins", "image_id fine cnt", "fb"),
    "fine_to_coarse": ("fine_bins", "image_id fine coarse", "fb"),
    "coarse_bins": ("coarse_bins", "image_id coarse cnt total ~coverage ~lab_l ~lab_a ~lab_b ~chroma ~hue", "cb"),
    "color_names": ("color_names", "image_id coarse r g b hex name", "(SELECT image_id, coarse, n.* FROM cb JOIN named n USING (lab_l, lab_a, lab_b))"),
    "scale_stability": ("stability", "image_id coarse stability_type fine_count ~fine_variance dominant_axis", "stab"),
    "chroma_stats": ("chroma_stats", "image_id ~median_chroma ~chroma_iqr ~chroma_floor ~l_min ~l_max ~chroma_min ~chroma_max", "stats"),
    "family_members": ("family_members", "image_id coarse family_idx neutral", "fmem"),
    "color_families": ("families", "image_id family_idx is_neutral ~hue_center ~l_min ~l_max ~chroma_min ~chroma_max ~coverage members", "fam"),
    "directional": ("directional", "image_id src nbr right left below above down_right down_left up_right up_left", "dirs"),
    "adjacency": ("adjacency", "image_id b1 b2 cnt", "adj"),
    "neighbours": ("neighbours", "image_id coarse other", "near"),
    "neighbor_metrics": ("neighbour_metrics", "image_id coarse n_neighbours ~local_contrast ~isolation", "nm"),
    "coherence": ("coherence", "image_id coarse ~coherence", "coh"),
    "color_metrics": ("color_metrics", "image_id coarse cnt ~coverage ~chroma ~hue ~local_contrast ~coherence ~isolation", "met"),
    "gradient_flow": ("flow", "image_id src nbr total h_flow ~h_asymmetry v_flow ~v_asymmetry dr_flow ~dr_asymmetry dl_flow ~dl_asymmetry", """(SELECT image_id, src, nbr, total, """ + ", ".join(f'"{p}" - "{n}" AS {a}_flow, CASE WHEN "{p}" + "{n}" > 0 THEN abs("{p}" - "{n}") / ("{p}" + "{n}" + 1)::DOUBLE ELSE 0 END AS {a}_asymmetry' for a, (p, n) in {"h": ("right", "left"), "v": ("below", "above"), "dr": ("down_right", "up_left"), "dl": ("down_left", "up_right")}.items()) + " FROM flow0)"),
    "flow_edges": ("flow_edges", "image_id src dir nbr ~weight total", "fe"),
    "flow_lists": ("flow_lists", "image_id dir src nbrs", "fl"),
    "lab_extremes": ("lab_extremes", "image_id fine", "ext"),
    "seed_scores": ("seed_scores", "image_id fine cnt ~contrast is_extreme ~coherence ~score seed_rank", "seed"),
    "flow_chains": ("flow_chains", f"image_id dir_rank seed_rank chain length covered ~coverage score cand_rank {BOUNDS}", "chains"),
    "deduped_chains": ("deduped_chains", "image_id cand_rank chain", "dd"),
    "gradients": ("gradients", f"image_id gradient_idx direction chain stops ~coverage ~mean_turn {BOUNDS}", "gr"),
    "gradient_membership": ("gradient_membership", "image_id coarse gradient_count gradients", "gm"),
    "family_span": ("family_span", "image_id gradient_idx family_span", "fspan"),
    "significance": ("significance", "image_id coarse stability_type ~significance is_accent coverage_rank", "sig"),
    "accents": ("significance", "image_id coarse ~coverage", "(SELECT * FROM sig WHERE is_accent)"),
    "selected_colors": ("selected", "image_id coarse position", "chosen"),
    "notable_colors": ("notable_colors", "image_id pos coarse ~lab_l ~lab_a ~lab_b r g b hex name role ~coverage ~chroma ~significance characteristics gradient_count gradients", "nc"),
    "contrast_pairs": ("contrast_pairs", "image_id pair color_a color_b ~delta_l ~ratio wcag_level", "cp"),
    "harmonic_pairs": ("harmonic_pairs", "image_id pair color_a color_b ~hue_difference", "hp"),
    "distribution": ("distribution", "image_id n_colors accents distribution", "dist"),
    "palette_summary": ("summary", "image_id scheme_type scheme_description n_colors distribution ~l_min ~l_max ~chroma_min ~chroma_max", "summ"),
}
#: Integers that DuckDB and Spark would make of different widths.
_LONG = {"cnt", "total", "n_neighbours", "fine_count", "total_pixels", "height", "width", "position", "pos", "pair", "gradient_idx", "gradient_count", "cand_rank", "seed_rank", "dir_rank", "coverage_rank", "length", "score", "n_colors", "accents", "family_idx", "r", "g", "b", *BOUNDS.split()}
_LONGS = {"gradients", "family_span", "nbrs", "stops", "chain", "members"}


#: Relations that rest on many others, so what these share is stored.
DEEP = {"family_members", "families", "neighbour_metrics", "color_metrics", "flow_edges", "flow_lists", "seed_scores", "flow_chains", "deduped_chains", "gradients", "gradient_membership", "family_span", "significance", "selected", "notable_colors", "contrast_pairs", "harmonic_pairs", "distribution", "summary", "prose", "html"}


def _query(relation: str, columns: str) -> Callable[[SparkSession, str], DataFrame]:
    @tidy
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(Palette(pixels(spark, sf_dir), keep=relation in DEEP).prepare(relation), relation)
        if columns == TABLES["accents"][1]:
            df = df.where("is_accent")
        out = []
        for c in columns.split():
            name = c.lstrip("~")
            out.append(F.round(name, 6).alias(name) if c[0] == "~" else F.col(name).cast("long").alias(name) if name in _LONG else F.col(name).cast("array<long>").alias(name) if name in _LONGS else F.col(name))
        return df.select(*out)

    return run


def _select(columns: str, relation: str) -> str:
    out = []
    for c in columns.split():
        name = c.lstrip("~")
        out.append(f"round({name}::DOUBLE, 6) AS {name}" if c[0] == "~" else f"{name}::BIGINT AS {name}" if name in _LONG else f"{name}::BIGINT[] AS {name}" if name in _LONGS else f'"{name}"')
    return f"SELECT {', '.join(out)} FROM {relation}"


def color_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions on a lattice of channels made from part: to CIELAB, the colour of the coarse bin and its hue, contrast with white, ink."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS k", "CAST(p_partkey * 7 % 256 AS BIGINT) AS r", "CAST(p_partkey * 13 % 256 AS BIGINT) AS g", "CAST(p_partkey * 29 % 256 AS BIGINT) AS b")
    lab = C.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    p = p.withColumns(dict(zip(("l", "a", "lb"), lab, strict=True)))
    ratio = F.round(C.contrast_ratio((F.col("r"), F.col("g"), F.col("b")), (F.lit(255), F.lit(255), F.lit(255))), 9)
    p = p.withColumn("coarse", C.encode(*(C.quantise(F.col(c), 11.5) for c in ("l", "a", "lb"))))
    p = p.withColumns(dict(zip(("cl", "ca", "cb"), C.centre(F.col("coarse"), 11.5), strict=True)))
    p = p.withColumn("hue", C.hue(F.col("ca"), F.col("cb")))
    p = p.withColumns({"back": C.lab_to_hex(F.col("cl"), F.col("ca"), F.col("cb")), "escaped": C.escape_html(F.format_string("<a href='%d'>&\"</a>", "k")), "far": C.hue_distance(F.col("hue"), F.lit(300.0)), "de": C.delta_e((F.col("l"), F.col("a"), F.col("lb")), (F.col("cl"), F.col("ca"), F.col("cb")))})
    return p.select("k", "coarse", "back", "escaped", F.round("hue", 6).alias("hue"), F.round("far", 6).alias("hue_distance"), F.round("de", 6).alias("delta_e"), F.round("l", 6).alias("l"), F.round("a", 6).alias("a"), F.round("lb", 6).alias("lb"), C.to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"), F.round(C.chroma(F.col("a"), F.col("lb")), 6).alias("chroma"),
        C.encode(*(C.quantise(F.col(c), 2.3) for c in ("l", "a", "lb"))).alias("fine"), F.round(ratio, 6).alias("contrast"), C.wcag_level(ratio).alias("level"), C.text_on(F.col("l")).alias("ink"))


def _report(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return tidy(lambda spark, sf_dir: getattr(Palette(pixels(spark, sf_dir), keep=True).prepare(kind), kind))


def name_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default name table."""
    return spark.createDataFrame([(i, n, r, g, b) for i, (n, r, g, b) in enumerate(css_names())], "idx long, name string, r long, g long, b long")


@tidy
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in a folder of images, of files that claim too great a size and of texts, and why a file is refused."""
    folder, px = work_path(spark, "images"), pixels(spark, sf_dir)
    write_images(px, f"{folder}/whole")
    write_odd(px, f"{folder}/odd")
    paths = [f"{folder}/whole", f"{folder}/odd"]
    found = images.inspect(spark, paths).join(images.checked(spark, paths), "path")
    out = stored(found.select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("name"), "kind", "width", "height", "reason"), "image_files")
    discard(spark, folder)
    return out


def _read_back(scaled: bool) -> Callable[[SparkSession, str], DataFrame]:
    @tidy
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, px = work_path(spark, "images"), pixels(spark, sf_dir)
        write_images(widened(px) if scaled else px, folder)
        found, paths = images.read_images(spark, f"{folder}/*.png", downscale=scaled, layers=further(folder))
        names = paths.select(F.col("image_id").alias("hash"), F.regexp_extract("path", "([0-9]+)[.]png$", 1).cast("long").alias("image_id"))
        out = stored(found.withColumnRenamed("image_id", "hash").join(names, "hash").select("image_id", "y", "x", "r", "g", "b"), "image_pixels")
        discard(spark, folder)
        discard(spark, f"{folder}{MORE}")
        return out

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(relation, columns) for name, (relation, columns, _) in TABLES.items()}
QUERIES |= {"color_functions": color_functions, "name_table": name_table, "prose_report": _report("prose"), "html_report": _report("html"), "image_files": image_files, "image_pixels": _read_back(False), "image_scaled": _read_back(True)}


def _functions_sql() -> str:
    from .oracle import TO_XYZ, WHITE, _apart, _bin, _centre, _code, _f, _hue, _lin, _lum, _rgb

    return f"""WITH p AS (SELECT p_partkey AS k, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b FROM part),
lin AS (SELECT *, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM p),
f AS (SELECT *, {_f(TO_XYZ[0], WHITE[0])} AS fx, {_f(TO_XYZ[1], WHITE[1])} AS fy, {_f(TO_XYZ[2], WHITE[2])} AS fz FROM lin),
x AS (SELECT k, r, g, b, fy * 116 - 16 AS l, (fx - fy) * 500 AS a, (fy - fz) * 200 AS lb, round(1.05e0 / ({_lum('f')} + 0.05e0), 9) AS ratio FROM f),
c AS (SELECT *, {_code(*(_bin(c, 11.5) for c in ('l', 'a', 'lb')))} AS coarse FROM x),
d AS (SELECT *, {', '.join(f'{v} AS {n}' for v, n in zip(_centre('coarse', 11.5), ('cl', 'ca', 'cb'), strict=True))} FROM c),
e AS (SELECT *, {_hue('ca', 'cb')} AS hue, {', '.join(f'{v} AS {n}' for v, n in zip(_rgb('cl', 'ca', 'cb'), ('br', 'bg', 'bb'), strict=True))} FROM d)
SELECT k, coarse, printf('#%02x%02x%02x', br, bg, bb) AS back, '&lt;a href=&#x27;' || k || '&#x27;&gt;&amp;&quot;&lt;/a&gt;' AS escaped, round(hue, 6) AS hue, round({_apart('hue', '300e0')}, 6) AS hue_distance,
    round(sqrt((l - cl) * (l - cl) + (a - ca) * (a - ca) + (lb - cb) * (lb - cb)), 6) AS delta_e, round(l, 6) AS l, round(a, 6) AS a, round(lb, 6) AS lb, printf('#%02x%02x%02x', r, g, b) AS hex, round(sqrt(a * a + lb * lb), 6) AS chroma, {_code(*(_bin(c, 2.3) for c in ('l', 'a', 'lb')))} AS fine,
    round(ratio, 6) AS contrast, CASE WHEN ratio >= 7 THEN 'AAA' WHEN ratio >= 4.5 THEN 'AA' WHEN ratio >= 3 THEN 'AA-large' ELSE 'fail' END AS level, CASE WHEN l > 50 THEN '#000' ELSE '#fff' END AS ink FROM e"""


def oracle_sql() -> dict[str, str]:
    out = {name: sql(_select(columns, relation)) for name, (_, columns, relation) in TABLES.items()}
    names = ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, (n, r, g, b) in enumerate(css_names()))
    out["name_table"] = f"SELECT idx::BIGINT AS idx, name, r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b FROM (VALUES {names}) t(idx, name, r, g, b)"
    return out | {"color_functions": _functions_sql(), "prose_report": sql("SELECT image_id, report FROM prose"), "html_report": sql("SELECT image_id, html FROM html"), "image_files": sql("SELECT name, kind, width, height, reason FROM ifiles"),
        "image_pixels": sql("SELECT image_id, y, x, r, g, b FROM pixels"), "image_scaled": sql("SELECT image_id, y, x, r, g, b FROM iscaled")}
