"""Micro-images with results worked out by hand, properties, and equality with SQL."""

import math

import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from huescape.functions import color as C
from huescape.functions.names import css_names, nearest_name, read_names
from huescape.operators import gradients as G
from huescape.plans import catalogue
from huescape.plans.palette import Palette
from huescape.sources.fixtures import pixels

SF = "/root/testdata/sf0.001"
RED, BLUE, WHITE, GREY = (255, 0, 0), (0, 0, 255), (255, 255, 255), (128, 128, 128)


def image(spark, *grids):
    rows = [(i, y, x, *c) for i, grid in enumerate(grids) for y, row in enumerate(grid) for x, c in enumerate(row)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_lab_of_anchors_and_back(spark):
    df = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (255, 0, 0)], "r int, g int, b int")
    lab = C.with_lab(df).collect()
    assert [round(x["lab_l"], 1) for x in lab] == [0.0, 100.0, 53.2]
    assert abs(lab[2]["lab_a"] - 80.1) < 0.1 and abs(lab[2]["lab_b"] - 67.2) < 0.1
    back = C.with_rgb(C.with_lab(df).drop("r", "g", "b")).collect()
    assert all(abs(p - q) <= 1 for x, y in zip(back, df.collect(), strict=True) for p, q in zip(x[3:], y, strict=True))
    same = C.with_lab(df).select(*(F.abs(v - F.col(f"lab_{c}")).alias(c) for v, c in zip(C.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")), "lab", strict=True)))
    assert all(max(r) < 1e-9 for r in same.collect())
    assert [tuple(r) for r in C.with_lab(df).select(*C.lab_to_rgb(*(F.col(f"lab_{c}") for c in "lab"))).collect()] == [tuple(r[3:]) for r in back]


def test_scalars(spark):
    lit = F.lit
    r = one(
        spark, C.quantise(lit(0.5), 1.0).alias("a"), C.quantise(lit(1.5), 1.0).alias("b"), C.quantise(lit(-2.5), 1.0).alias("c"), C.hue(lit(0.0), lit(0.0)).alias("h0"), C.hue(lit(0.0), lit(-1.0)).alias("h1"),
        C.hue_distance(lit(350.0), lit(10.0)).alias("d"), C.contrast_ratio((lit(0),) * 3, (lit(255),) * 3).alias("k"), C.fixed0(lit(2.5)).alias("f0"), C.fixed1(lit(0.25)).alias("f1"),
        C.escape_html(lit("<a b='&\">")).alias("e"), C.to_hex(lit(1), lit(171), lit(255)).alias("x"), C.text_on(lit(50.0)).alias("t"),
    )
    assert (r.a, r.b, r.c, r.h0, r.h1, r.d) == (0, 2, -2, 0.0, 270.0, 20.0)
    assert math.isclose(r.k, 21.0) and (r.f0, r.f1, r.x, r.t) == ("2", "0.2", "#01abff", "#fff")
    assert r.e == "&lt;a b=&#x27;&amp;&quot;&gt;"


def test_codes_round_trip(spark):
    df = spark.range(0, 20000, 7).select(((F.col("id") % 100)).alias("l"), (F.col("id") % 255 - 128).alias("a"), (F.col("id") * 3 % 255 - 128).alias("b"))
    back = df.withColumn("code", C.encode(F.col("l"), F.col("a"), F.col("b")))
    parts = C.decode(F.col("code"))
    assert back.where((parts[0] != F.col("l")) | (parts[1] != F.col("a")) | (parts[2] != F.col("b"))).count() == 0


def test_names(spark, tmp_path):
    assert len(css_names()) == 148
    assert one(spark, nearest_name(F.lit(53.2), F.lit(80.1), F.lit(67.2)).alias("n")).n == "Red"
    (tmp_path / "n.txt").write_text("# License\nbrick red\t#8f1402\nsky\t#82cafc\n")
    own = read_names(spark, str(tmp_path / "n.txt"))
    assert own == [("Brick Red", 0x8F, 0x14, 0x02), ("Sky", 0x82, 0xCA, 0xFC)]
    assert one(spark, nearest_name(F.lit(80.0), F.lit(-8.0), F.lit(-30.0), own).alias("n")).n == "Sky"


def test_flat_image(spark):
    p = Palette(image(spark, [[RED] * 4] * 4), keep=True)
    m = p.color_metrics.collect()
    assert [(r.coverage, r.coherence, r.isolation, r.local_contrast) for r in m] == [(1.0, 1.0, 1.0, 0.0)]
    assert p.gradients.count() == 0 and p.directional.count() == 0
    assert p.summary.first().scheme_type == "monochromatic"
    assert "Notable colors: 1" in p.prose.first().report
    p.release()


def test_halves_checkerboard_and_blobs(spark):
    halves = [[RED] * 2 + [BLUE] * 2] * 4
    checker = [[RED, BLUE], [BLUE, RED]]
    blobs = [[RED, RED, RED, WHITE, WHITE, RED]]
    p = Palette(image(spark, halves, checker, blobs))
    by = {}
    for r in p.color_metrics.collect():
        by.setdefault(r.image_id, []).append((round(r.coherence, 4), r.isolation))
    assert sorted(by[0]) == [(1.0, 0.5), (1.0, 0.5)]
    assert sorted(by[1]) == [(1.0, 0.5), (1.0, 0.5)]
    assert sorted(by[2]) == [(0.75, 0.5), (1.0, 0.5)]


def test_adjacency_parity_and_directions(spark):
    p = Palette(image(spark, [[RED, BLUE]], [[RED], [BLUE]]))
    a = p.adjacency.collect()
    assert [r.cnt for r in a] == [2, 2]
    d = {(r.image_id, r.src): r for r in p.directional.collect()}
    codes = sorted({k[1] for k in d})
    sides = {(i, c): [n for n in ("right", "left", "below", "above") if d[(i, c)][n]] for i in (0, 1) for c in codes}
    assert sorted(map(tuple, (sides[(0, c)] for c in codes))) == [("left",), ("right",)]
    assert sorted(map(tuple, (sides[(1, c)] for c in codes))) == [("above",), ("below",)]


def test_bands_do_not_matter(spark, monkeypatch):
    from huescape.operators import adjacency

    grid = [[(x * 20 % 256, y * 9 % 256, (x * y) % 256) for x in range(9)] for y in range(11)]
    whole = sorted(map(tuple, Palette(image(spark, grid)).directional.collect()))
    monkeypatch.setattr(adjacency, "BAND", 3)
    p = Palette(image(spark, grid))
    assert sorted(map(tuple, p.directional.collect())) == whole
    assert len(whole) > 20


def test_partitions_do_not_matter(spark):
    few = sorted(map(str, Palette(pixels(spark, SF), keep=True).notable_colors.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        more = sorted(map(str, Palette(pixels(spark, SF).repartition(5), keep=True).notable_colors.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert few == more


def test_components_by_bands(spark, monkeypatch):
    """Coherence against a flood fill, with bands of few rows, spirals and noise."""
    import random

    from huescape.operators import adjacency

    rnd = random.Random(4)
    spiral = [[WHITE] * 15 for _ in range(15)]
    y, x, dy, dx, left = 0, 0, 0, 1, 110
    while left:
        spiral[y][x] = RED
        ahead, two = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
        free = lambda p: 0 <= p[0] < 15 and 0 <= p[1] < 15
        if not free(ahead) or spiral[ahead[0]][ahead[1]] == RED or (free(two) and spiral[two[0]][two[1]] == RED):
            dy, dx = dx, -dy
            if spiral[y + dy][x + dx] == RED:
                break
        y, x, left = y + dy, x + dx, left - 1
    grids = [spiral, *([[rnd.choice([RED, BLUE, WHITE]) for _ in range(11)] for _ in range(13)] for _ in range(4))]
    for band in (1, 2, 5, 64):
        monkeypatch.setattr(adjacency, "BAND", band)
        rows = Palette(image(spark, *grids)).coherence.collect()
        for i, grid in enumerate(grids):
            cells, want = {(y, x): c for y, r in enumerate(grid) for x, c in enumerate(r)}, []
            for color in {c for r in grid for c in r}:
                left, sizes = {p for p, c in cells.items() if c == color}, []
                total = len(left)
                while left:
                    queue, n = [left.pop()], 0
                    while queue:
                        y, x = queue.pop()
                        n += 1
                        near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                        left -= near
                        queue += near
                    sizes.append(n)
                want.append(max(sizes) / total)
            assert sorted(r.coherence for r in rows if r.image_id == i) == pytest.approx(sorted(want))


def test_components_of_noise_in_bounded_memory():
    """A band of an image 10,000 wide, all noise: labelled by whole arrays, far below a gigabyte."""
    import time
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from huescape.operators import adjacency

    n = adjacency.BAND * 10_000
    t = pa.table({"image_id": np.zeros(n, np.int64), "band": np.ones(n, np.int64), "y": np.repeat(np.arange(adjacency.BAND) + adjacency.BAND, 10_000), "x": np.tile(np.arange(10_000), adjacency.BAND), "coarse": np.random.default_rng(0).integers(0, 3, n)})
    began = time.perf_counter()
    tracemalloc.start()
    out = adjacency._label_bands(adjacency.BAND)(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20 and time.perf_counter() - began < 20
    assert sum(v or 0 for v in out.column("pixels").to_pylist()) == n and 19_000 > sum(v is not None for v in out.column("y").to_pylist()) > 10_000


def test_relations_leave_nothing(spark):
    import os

    from huescape.store import roots, work_path

    folder = work_path(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    for name in ("gradients", "palette_summary", "prose_report"):
        out = catalogue.QUERIES[name](spark, SF)
        assert set(os.listdir(folder)) - before <= roots(out)
        before = set(os.listdir(folder))


def test_greys_are_achromatic(spark):
    p = Palette(image(spark, [[(v, v, v) for v in (0, 60, 120, 200)]] * 3), keep=True)
    assert p.summary.first().scheme_type == "achromatic"


def test_empty_relation(spark):
    p = Palette(image(spark, []), keep=True)
    assert p.notable_colors.count() == 0 and p.prose.count() == 0 and p.html.count() == 0


def test_turns(spark):
    df = spark.createDataFrame([([8487039, 8487040, 8487041],), ([8487039, 8487040],)], "chain array<long>")
    assert [r[0] for r in df.select(G.mean_turn(F.col("chain"))).collect()] == [0.0, None]


def test_properties(spark):
    p = Palette(pixels(spark, SF), keep=True)
    total = {r.image_id: r.total_pixels for r in p.images.collect()}
    assert {r.image_id: r.n for r in p.fine_bins.groupBy("image_id").agg(F.sum("cnt").alias("n")).collect()} == total
    assert p.fine_bins.where(C.coarse_of(F.col("fine")) != F.col("coarse")).count() == 0
    m = p.color_metrics
    assert m.where("coherence <= 0 or coherence > 1 or isolation <= 0 or isolation > 1").count() == 0
    assert p.adjacency.where("cnt % 2 <> 0").count() == 0
    d = p.directional
    swapped = d.select("image_id", F.col("nbr").alias("src"), F.col("src").alias("nbr"), F.col("left").alias("right"))
    assert d.select("image_id", "src", "nbr", "right").exceptAll(swapped).count() == 0
    assert p.notable_colors.groupBy("image_id").count().where("count > 10").count() == 0
    assert p.contrast_pairs.where("ratio < 1 or ratio > 21 or pair > 4").count() == 0
    assert p.family_members.where("family_idx is null").count() == 0
    page = p.html.first().html
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</html>") and "linear-gradient" in page


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, SF), con, catalogue.oracle_sql()[name])


def test_constants_are_those_of_the_sql():
    """The SQL has its own copy of every fixed value, so that a slip on one side shows."""
    from huescape import constants
    from huescape.functions import color
    from huescape.plans import oracle

    for name in ("HUE_RANGE", "SEEDS", "MIN_EDGES", "MIN_ASYMMETRY", "MIN_CHAIN", "MIN_SPAN", "MAX_TURN", "STOP_CHROMA", "MOST", "MIN_SHARE", "SIMILAR", "ANCHOR", "PENALTY", "CONTRAST_L", "HARMONY_CHROMA", "PAIRS", "DIRECTIONS"):
        assert getattr(constants, name) == getattr(oracle, name), name
    for name in ("TO_XYZ", "TO_RGB", "WHITE", "EPSILON", "KAPPA"):
        assert getattr(color, name) == getattr(oracle, name), name
