"""Reports of a palette, a row for each image, put together from arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FINE
from ..functions import color as C
from ..functions.names import Names, nearest_name


def _lines(df: DataFrame, order: str, *lines: Column, name: str = "lines") -> DataFrame:
    """image_id and the lines of all its rows in order (null lines left out)."""
    each = F.filter(F.array(*lines), lambda x: x.isNotNull())
    rows = df.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), each.alias("x")))).alias("rows"))
    return rows.select("image_id", F.flatten(F.transform("rows", lambda r: r["x"])).alias(name))


def _triple(*v: Column, round_: bool = True) -> Column:
    return F.format_string("(%s, %s, %s)", *(C.fixed0(x) if round_ else x.cast("string") for x in v))


def _lab(*v: Column) -> Column:
    return _triple(*v)


def _rgb(*v: Column) -> Column:
    return _triple(*v, round_=False)


def stop_table(found: DataFrame, names: Names | None = None) -> DataFrame:
    """image_id, gradient_idx, stop (from 0), lab, rgb, hex, name of each gradient's stops."""
    from ..constants import COARSE
    from .bins import named

    s = found.select("image_id", "gradient_idx", F.posexplode("stops").alias("stop", "coarse"))
    return named(s.withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), C.centre(F.col("coarse"), COARSE), strict=True))), names)


def _per_gradient(found: DataFrame, stops: DataFrame, line: Column) -> DataFrame:
    s = stops.groupBy("image_id", "gradient_idx").agg(F.array_sort(F.collect_list(F.struct("stop", "name", line.alias("line")))).alias("s"))
    s = s.select("image_id", "gradient_idx", F.transform("s", lambda x: x["name"]).alias("stop_names"), F.transform("s", lambda x: x["line"]).alias("stop_lines"))
    return found.join(s, ["image_id", "gradient_idx"])


def _text(*lines: str) -> Column:
    return F.array(*(F.lit(x) for x in lines))


def _when_any(lines: str, head: Column, tail: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    body = F.coalesce(lines, none)
    return F.when(F.size(body) > 0, F.concat(head, body, *([tail] if tail is not None else []))).otherwise(none)


def prose(summary: DataFrame, notable: DataFrame, found: DataFrame, contrast: DataFrame, harmony: DataFrame, names: Names | None = None) -> DataFrame:
    """image_id, report: the palette as plain text."""
    lab, rgb = tuple(F.col(f"lab_{c}") for c in "lab"), tuple(F.col(c) for c in "rgb")
    pct = F.col("coverage") * 100
    share = F.when(pct >= 0.1, F.concat(C.fixed1(pct), F.lit("%"))).otherwise("<0.1%")
    colors = _lines(
        notable, "pos", F.format_string("[%s] %s", F.initcap("role"), F.col("name")),
        F.format_string("  Hex: %s | RGB: %s | LAB: %s", F.col("hex"), _rgb(*rgb), _lab(*lab)), F.format_string("  Coverage: %s | Chroma: %s", share, C.fixed0(F.col("chroma"))),
        F.when(F.size("characteristics") > 0, F.concat(F.lit("  "), F.array_join("characteristics", ". "), F.lit("."))), F.lit(""), name="color_lines",
    )
    line = F.format_string("    %d. %s %s / RGB%s / LAB%s", F.col("stop") + 1, F.col("name"), F.col("hex"), _rgb(*rgb), _lab(*lab))
    g = _per_gradient(found, stop_table(found, names), line)
    lo, hi = F.col("l_lo") * FINE, F.col("l_hi") * FINE
    head = F.array(F.array_join("stop_names", " → "), F.lit("  Stops:"))
    tail = F.array(F.format_string("  Direction: %s | Coverage: %s%%", F.col("direction"), C.fixed1(F.col("coverage") * 100)), F.format_string("  Lightness span: %s (L %s → %s)", C.fixed0(hi - lo), C.fixed0(lo), C.fixed0(hi)), F.lit(""))
    g = g.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("gradient_idx", F.concat(head, "stop_lines", tail).alias("x")))).alias("rows"))
    g = g.select("image_id", F.flatten(F.transform("rows", lambda r: r["x"])).alias("gradient_lines"))
    c = _lines(contrast, "pair", F.format_string("  - %s / %s: Ratio %s:1 (WCAG %s) | ΔL=%s", F.col("color_a"), F.col("color_b"), C.fixed1(F.col("ratio")), F.col("wcag_level"), C.fixed0(F.col("delta_l"))), name="contrast_lines")
    h = _lines(harmony, "pair", F.format_string("  - %s and %s: Similar hue (%s° apart)", F.col("color_a"), F.col("color_b"), C.fixed0(F.col("hue_difference"))), name="harmony_lines")
    s = summary
    for part in (colors, g, c, h):
        s = s.join(part, "image_id", "left")
    overview = F.array(
        F.lit("OVERVIEW:"), F.lit("The palette's scheme, from its hues, and how far lightness (L) and chroma reach."), F.lit(""),
        F.format_string("Scheme: %s", F.col("scheme_type")), F.format_string("  %s", F.col("scheme_description")),
        F.format_string("Lightness range: %s-%s | Chroma range: %s-%s", *(C.fixed0(F.col(x)) for x in ("l_min", "l_max", "chroma_min", "chroma_max"))),
        F.format_string("Notable colors: %d", F.col("n_colors")), F.format_string("Distribution: %s", F.col("distribution")), F.lit(""),
    )
    parts = F.concat(
        overview, _text("COLORS:", "By prominence: dominant, secondary, dark and light, then accents.", ""), F.coalesce("color_lines", F.array().cast("array<string>")),
        _when_any("gradient_lines", _text("GRADIENTS:", "Smooth transitions between colors, with the axis along which they run.", "")),
        _text("RELATIONSHIPS:", "Contrast by WCAG (AAA from 7:1, AA from 4.5:1, AA-large from 3:1); harmony by hue.", ""),
        _when_any("contrast_lines", _text("Contrast pairs (high separation):"), _text("")), _when_any("harmony_lines", _text("Harmonic pairs (similar hue):")),
    )
    return s.select("image_id", F.array_join(parts, "\n").alias("report"))


STYLE = (
    "body{font:15px/1.5 system-ui,sans-serif;max-width:52rem;margin:2rem auto;padding:0 1rem;color:#222}"
    ".strip{display:flex;height:5rem;border-radius:.5rem;overflow:hidden}.strip>*,.chip{display:flex;align-items:end;padding:.4rem;font:12px monospace}"
    ".row{display:flex;gap:1rem;margin:.8rem 0;align-items:center}.chip{width:6rem;height:4rem;border-radius:.4rem}.bar{height:3rem;border-radius:.4rem}"
    ".muted{color:#666;font-size:13px}.level{border:1px solid;border-radius:.3rem;padding:0 .3rem;font-size:12px}"
)


def css_stops(chain: Column, most: int = 20) -> Column:
    """At most `most` of a chain's bins at even steps, as stops of a CSS gradient."""
    n = F.size(chain)
    taken = F.when(n > most, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(chain, F.floor(i * (n - 1) / (most - 1)).cast("int")))).otherwise(chain)
    last = F.greatest(F.least(n, F.lit(most)) - 1, F.lit(1))
    return F.array_join(F.transform(taken, lambda c, i: F.concat(C.lab_to_hex(*C.centre(c)), F.lit(" "), C.fixed0(i / last * 100), F.lit("%"))), ", ")


def html(summary: DataFrame, notable: DataFrame, found: DataFrame, contrast: DataFrame, harmony: DataFrame, paths: DataFrame | None = None, names: Names | None = None) -> DataFrame:
    """image_id, html: the palette as a page of its own. paths: image_id, path (escaped), else the image_id is its title."""
    lab = tuple(F.col(f"lab_{c}") for c in "lab")
    total = F.sum("coverage").over(Window.partitionBy("image_id"))
    n = notable.withColumn("ink", C.text_on(F.col("lab_l"))).withColumn("flex", C.fixed1(F.greatest(F.lit(5.0), F.col("coverage") / total * 100)))
    strip = _lines(n, "pos", F.format_string('<div style="background:%s;color:%s;flex:%s">%s</div>', "hex", "ink", "flex", "hex"), name="strip")
    share = F.when(F.col("coverage") >= 0.001, F.concat(C.fixed1(F.col("coverage") * 100), F.lit("%"))).otherwise("&lt;0.1%")
    traits = F.when(F.size("characteristics") > 0, F.concat(F.lit("<br>"), C.escape_html(F.array_join("characteristics", ". ")), F.lit("."))).otherwise("")
    cards = _lines(n, "pos", F.format_string(
        '<div class="row"><div class="chip" style="background:%s;color:%s">%s</div><div><b>%s</b> %s<div class="muted">RGB%s · LAB%s<br>Coverage %s · Chroma %s%s</div></div></div>',
        "hex", "ink", "hex", "role", C.escape_html(F.col("name")), _rgb(*(F.col(c) for c in "rgb")), _lab(*lab), share, C.fixed0(F.col("chroma")), traits), name="cards")
    stop = F.format_string('<span class="row"><span class="chip" style="background:%s"></span>%s</span>', "hex", C.escape_html(F.col("name")))
    g = _per_gradient(found, stop_table(found, names), stop)
    bars = _lines(g, "gradient_idx", F.format_string(
        '<div class="bar" style="background:linear-gradient(to right, %s)"></div><div class="row">%s</div><p class="muted">Direction %s · Coverage %s%% · Lightness span %s</p>',
        css_stops(F.col("chain")), F.array_join("stop_lines", ""), "direction", C.fixed1(F.col("coverage") * 100), C.fixed0((F.col("l_hi") - F.col("l_lo")) * FINE)), name="bars")
    # A name that several colours share stands for the last of them.
    last = n.groupBy("image_id", "name").agg(F.max_by("hex", "pos").alias("hex"), F.max_by("ink", "pos").alias("ink"))

    def look(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(last.select("image_id", F.col("name").alias(f"color_{side}"), F.col("hex").alias(f"hex_{side}"), F.col("ink").alias(f"ink_{side}")), ["image_id", f"color_{side}"], "left")
        return pairs.fillna({"hex_a": "#888", "ink_a": "#fff", "ink_b": "#fff"})

    pair = C.escape_html(F.concat_ws(" / ", "color_a", "color_b"))
    c = _lines(look(contrast).fillna({"hex_b": "#fff"}), "pair", F.format_string('<div class="row"><div class="chip" style="background:%s;color:%s">Aa</div>%s: %s:1 <span class="level">%s</span></div>', "hex_a", "hex_b", pair, C.fixed1(F.col("ratio")), "wcag_level"), name="contrasts")
    swatch = '<div class="chip" style="background:%s;color:%s">%s</div>'
    h = _lines(look(harmony).fillna({"hex_b": "#888"}), "pair", F.format_string(f'<div class="row">{swatch}{swatch}%s: %s° apart</div>', "hex_a", "ink_a", "hex_a", "hex_b", "ink_b", "hex_b", pair, C.fixed0(F.col("hue_difference"))), name="harmonies")
    s = summary
    for part in (strip, cards, bars, c, h):
        s = s.join(part, "image_id", "left")
    if paths is not None:
        s = s.join(paths.select("image_id", "path"), "image_id", "left")
    title = C.escape_html(F.coalesce(F.col("path"), F.col("image_id").cast("string")) if paths is not None else F.col("image_id").cast("string"))
    none = F.array().cast("array<string>")
    section = lambda name, text: _when_any(name, _text(f"<h2>{text}</h2>"))
    parts = F.concat(
        F.array(F.lit('<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><meta name="viewport" content="width=device-width, initial-scale=1">'), F.concat(F.lit("<title>Palette: "), title, F.lit(f"</title><style>{STYLE}</style></head><body>")),
            F.concat(F.lit("<h1>"), F.col("scheme_type"), F.lit("</h1><p>"), F.col("scheme_description"), F.lit('</p><p class="muted">Source: '), title, F.lit("<br>"),
                F.format_string("Lightness %s–%s · Chroma %s–%s · %d colors<br>", *(C.fixed0(F.col(x)) for x in ("l_min", "l_max", "chroma_min", "chroma_max")), F.col("n_colors")), F.col("distribution"), F.lit("</p>"))),
        _text('<div class="strip">'), F.coalesce("strip", none), _text("</div>"), section("cards", "Colors"), section("bars", "Gradients"),
        section("contrasts", "Contrast pairs"), section("harmonies", "Harmonic pairs"), _text("</body></html>"),
    )
    return s.select("image_id", F.array_join(parts, "\n").alias("html"))
