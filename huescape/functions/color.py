"""Colour arithmetic as column expressions; all of it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FINE

#: sRGB and CIELAB by D65, as they are defined.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
EPSILON, KAPPA = 0.008856, 903.3


def _double(c: Column) -> Column:
    return c.cast("double")


def _linear(v: Column) -> Column:
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a and b of channels from 0 to 255."""
    r, g, b = (_linear(_double(c) / 255.0) for c in (r, g, b))

    def f(row: tuple[float, float, float], white: float) -> Column:
        t = (r * row[0] + g * row[1] + b * row[2]) / white
        return F.when(t > EPSILON, F.pow(t, F.lit(1 / 3))).otherwise((t * KAPPA + 16) / 116)

    fx, fy, fz = (f(row, white) for row, white in zip(TO_XYZ, WHITE, strict=True))
    return fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200


def lab_to_rgb(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """Channels from 0 to 255, cut off, not rounded."""
    fy = (l + 16) / 116
    fx, fz = a / 500 + fy, fy - b / 200
    cube = lambda t: t * t * t
    back = lambda t: F.when(cube(t) > EPSILON, cube(t)).otherwise((t * 116 - 16) / KAPPA)
    x, z = back(fx) * WHITE[0], back(fz) * WHITE[2]
    y = F.when(l > KAPPA * EPSILON, cube(fy)).otherwise(l / KAPPA)

    def channel(row: tuple[float, float, float]) -> Column:
        v = x * row[0] + y * row[1] + z * row[2]
        v = F.when(v > 0.0031308, F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055).otherwise(v * 12.92)
        return F.floor(F.least(F.greatest(v * 255, F.lit(0.0)), F.lit(255.0))).cast("int")

    return tuple(channel(row) for row in TO_RGB)


def with_lab(df: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """df + lab_l, lab_a, lab_b. The same as rgb_to_lab, but in steps: each power is worked out once and the optimizer
    keeps the steps apart, where one expression would hold it many times over."""
    columns = df.columns
    df = df.withColumns({f"_{c}": _linear(_double(F.col(c)) / 255.0) for c in (r, g, b)})
    df = df.withColumns({f"_t{i}": (F.col(f"_{r}") * row[0] + F.col(f"_{g}") * row[1] + F.col(f"_{b}") * row[2]) / w for i, (row, w) in enumerate(zip(TO_XYZ, WHITE, strict=True))})
    df = df.withColumns({f"_f{i}": F.when(F.col(f"_t{i}") > EPSILON, F.pow(f"_t{i}", F.lit(1 / 3))).otherwise((F.col(f"_t{i}") * KAPPA + 16) / 116) for i in range(3)})
    f = [F.col(f"_f{i}") for i in range(3)]
    return df.select(*columns, (f[1] * 116 - 16).alias("lab_l"), ((f[0] - f[1]) * 500).alias("lab_a"), ((f[1] - f[2]) * 200).alias("lab_b"))


def with_rgb(df: DataFrame) -> DataFrame:
    """df (lab_l, lab_a, lab_b) + r, g, b: lab_to_rgb in steps."""
    columns = df.columns
    df = df.withColumn("_fy", (F.col("lab_l") + 16) / 116)
    df = df.withColumns({"_fx": F.col("lab_a") / 500 + F.col("_fy"), "_fz": F.col("_fy") - F.col("lab_b") / 200})
    df = df.withColumns({f"_c{v}": F.col(f"_f{v}") * F.col(f"_f{v}") * F.col(f"_f{v}") for v in "xyz"})
    back = lambda v: F.when(F.col(f"_c{v}") > EPSILON, F.col(f"_c{v}")).otherwise((F.col(f"_f{v}") * 116 - 16) / KAPPA)
    df = df.withColumns({"_x": back("x") * WHITE[0], "_y": F.when(F.col("lab_l") > KAPPA * EPSILON, F.col("_cy")).otherwise(F.col("lab_l") / KAPPA), "_z": back("z") * WHITE[2]})
    df = df.withColumns({f"_v{c}": F.col("_x") * row[0] + F.col("_y") * row[1] + F.col("_z") * row[2] for c, row in zip("rgb", TO_RGB, strict=True)})
    df = df.withColumns({f"_p{c}": F.when(F.col(f"_v{c}") > 0.0031308, F.pow(F.greatest(f"_v{c}", F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055).otherwise(F.col(f"_v{c}") * 12.92) for c in "rgb"})
    return df.select(*columns, *(F.floor(F.least(F.greatest(F.col(f"_p{c}") * 255, F.lit(0.0)), F.lit(255.0))).cast("int").alias(c) for c in "rgb"))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def lab_to_hex(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    return to_hex(*lab_to_rgb(l, a, b))


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue(a: Column, b: Column) -> Column:
    """Degrees from 0 to 360; 0 for grey."""
    return F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))


def hue_distance(h1: Column, h2: Column) -> Column:
    d = F.abs(h1 - h2)
    return F.least(d, 360.0 - d)


def delta_e(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(one[1:], two[1:], strict=True)), (one[0] - two[0]) * (one[0] - two[0])))


def quantise(v: Column, size: float) -> Column:
    """The bin of a value; ties go to the even bin."""
    return F.rint(v / size).cast("long")


def encode(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """Three bins as one number that sorts like them."""
    return ((l + 128) * 65536 + (a + 128) * 256 + (b + 128)).cast("long")


def decode(code: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(code, 16) - 128, F.shiftright(code, 8) % 256 - 128, code % 256 - 128


def centre(code: Column, size: float = FINE) -> tuple[Column, Column, Column]:
    """L, a and b of a bin's centre."""
    return tuple(_double(v) * size for v in decode(code))


def coarse_of(fine: Column) -> Column:
    """The coarse bin of a fine one: five fine bins to a coarse, ties to even. The two nest."""
    return encode(*(F.rint(_double(v) / 5).cast("long") for v in decode(fine)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    def part(c: Column) -> Column:
        v = _double(c) / 255.0
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return part(r) * 0.2126 + part(g) * 0.7152 + part(b) * 0.0722


def contrast_ratio(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    """WCAG contrast of two sets of channels."""
    p, q = luminance(*one), luminance(*two)
    return (F.greatest(p, q) + 0.05) / (F.least(p, q) + 0.05)


def wcag_level(ratio: Column) -> Column:
    return F.when(ratio >= 7, "AAA").when(ratio >= 4.5, "AA").when(ratio >= 3, "AA-large").otherwise("fail")


def text_on(l: Column) -> Column:  # noqa: E741
    """Black or white, whichever reads better on a background of this lightness."""
    return F.when(l > 50, "#000").otherwise("#fff")


def escape_html(s: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(plain), F.lit(safe))
    return s


def fixed0(v: Column) -> Column:
    """A number without decimals; ties to even."""
    return F.format_string("%.0f", F.rint(v))


def fixed1(v: Column) -> Column:
    """A number with one decimal; ties to even."""
    return F.format_string("%.1f", F.bround(v, 1))
