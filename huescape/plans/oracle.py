"""The relations of the analysis as DuckDB SQL, written apart from the DataFrame plans that they check."""

from __future__ import annotations

from ..functions.names import css_names
from ..operators.render import STYLE

# Fixed values of the analysis, written out again: a wrong one in the plans must not be wrong here too.
HUE_RANGE, SEEDS, MIN_EDGES, MIN_ASYMMETRY, MIN_CHAIN = 30.0, 50, 10, 0.3, 3
MIN_SPAN, MAX_TURN, STOP_CHROMA, MOST, MIN_SHARE = 40.0, 74.0, 8.0, 10, 0.05
SIMILAR, ANCHOR, PENALTY, CONTRAST_L, HARMONY_CHROMA, PAIRS = 25.0, 0.05, 30.0, 30.0, 15.0, 5
DIRECTIONS = ("right", "left", "below", "above", "down_right", "down_left", "up_right", "up_left")
# sRGB and CIELAB by D65, as they are defined.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE, EPSILON, KAPPA = (0.95047, 1.0, 1.08883), 0.008856, 903.3


def _d(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def _lin(v: str) -> str:
    return f"CASE WHEN {v} / 255e0 > 0.04045e0 THEN pow(({v} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) ELSE {v} / 255e0 / 12.92e0 END"


def _f(row: tuple, white: float) -> str:
    t = f"((lr * {_d(row[0])} + lg * {_d(row[1])} + lb * {_d(row[2])}) / {_d(white)})"
    return f"CASE WHEN {t} > {_d(EPSILON)} THEN pow({t}, {_d(1 / 3)}) ELSE ({t} * {_d(KAPPA)} + 16) / 116e0 END"


def _code(*v: str) -> str:
    return f"(({v[0]} + 128) * 65536 + ({v[1]} + 128) * 256 + ({v[2]} + 128))"


def _bin(v: str, size: float) -> str:
    return f"round_even({v} / {_d(size)}, 0)::BIGINT"


def _parts(c: str) -> tuple[str, str, str]:
    return f"(({c} >> 16) - 128)", f"((({c} >> 8) % 256) - 128)", f"(({c} % 256) - 128)"


def _coarse(c: str) -> str:
    return _code(*(f"round_even({p}::DOUBLE / 5, 0)::BIGINT" for p in _parts(c)))


def _dist(a: tuple, b: tuple) -> str:
    sq = [f"({p} - {q}) * ({p} - {q})" for p, q in zip(a, b, strict=True)]
    return f"sqrt({sq[0]} + {sq[1]} + {sq[2]})"


def _centre(c: str, size: float = 2.3) -> tuple[str, ...]:
    return tuple(f"({p}::DOUBLE * {_d(size)})" for p in _parts(c))


def _hue(a: str, b: str) -> str:
    h = f"degrees(atan2({b}, {a}))"
    return f"(({h} % 360e0) + 360e0) % 360e0"


def _apart(x: str, y: str) -> str:
    return f"least(abs({x} - {y}), 360e0 - abs({x} - {y}))"


def _rgb(l: str, a: str, b: str) -> tuple[str, str, str]:  # noqa: E741
    fy = f"(({l} + 16) / 116e0)"
    fx, fz = f"({a} / 500e0 + {fy})", f"({fy} - {b} / 200e0)"
    back = lambda t: f"(CASE WHEN {t} * {t} * {t} > {_d(EPSILON)} THEN {t} * {t} * {t} ELSE ({t} * 116 - 16) / {_d(KAPPA)} END)"
    x, z = f"({back(fx)} * {_d(WHITE[0])})", f"({back(fz)} * {_d(WHITE[2])})"
    y = f"(CASE WHEN {l} > {_d(KAPPA * EPSILON)} THEN {fy} * {fy} * {fy} ELSE {l} / {_d(KAPPA)} END)"

    def channel(row: tuple) -> str:
        v = f"({x} * {_d(row[0])} + {y} * {_d(row[1])} + {z} * {_d(row[2])})"
        return f"floor(least(greatest((CASE WHEN {v} > 0.0031308e0 THEN pow(greatest({v}, 0), {_d(1 / 2.4)}) * 1.055e0 - 0.055e0 ELSE {v} * 12.92e0 END) * 255, 0), 255))::INTEGER"

    return tuple(channel(row) for row in TO_RGB)


def _lum(s: str) -> str:
    part = lambda c: f"(CASE WHEN {s}.{c} / 255e0 <= 0.03928e0 THEN {s}.{c} / 255e0 / 12.92e0 ELSE pow(({s}.{c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END)"
    return f"({part('r')} * 0.2126e0 + {part('g')} * 0.7152e0 + {part('b')} * 0.0722e0)"


def _axis_edges() -> str:
    out = []
    for ahead, back in (("right", "left"), ("below", "above"), ("down_right", "up_left"), ("down_left", "up_right")):
        p, n = f'"{ahead}"', f'"{back}"'
        out.append(f"SELECT image_id, src, nbr, total, {p} - {n} AS fl, CASE WHEN {p} + {n} > 0 THEN abs({p} - {n}) / ({p} + {n} + 1)::DOUBLE ELSE 0 END AS asym, '{ahead}' AS p, '{back}' AS n FROM flow0")
    return " UNION ALL ".join(out)


_ALL = [f'"{d}"' for d in DIRECTIONS]
_STEP = {"right": (0, 1), "left": (0, -1), "below": (1, 0), "above": (-1, 0), "down_right": (1, 1), "down_left": (1, -1), "up_right": (-1, 1), "up_left": (-1, -1)}
_IN = lambda v: f"CASE WHEN {v}_hi = {v}_lo THEN k.{v}_lo <= {v}_lo AND {v}_lo <= k.{v}_hi ELSE greatest(0, least({v}_hi, k.{v}_hi) - greatest({v}_lo, k.{v}_lo)) * 2 >= {v}_hi - {v}_lo END"
_F0 = lambda v: f"printf('%.0f', round_even({v}, 0))"

CTES = {
    "pixels": """SELECT image_id, y, x, (CASE image_id % 3 WHEN 0 THEN x * 255 // 49 WHEN 1 THEN y * 255 // 29 ELSE CASE WHEN x < 25 THEN 200 ELSE 30 END END)::BIGINT AS r,
        (CASE image_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 255 - y * 255 // 29 ELSE CASE WHEN y < 15 THEN 40 ELSE 180 END END)::BIGINT AS g,
        (CASE image_id % 3 WHEN 0 THEN 255 - x * 255 // 49 WHEN 1 THEN 128 ELSE CASE WHEN s = 'P' THEN 255 ELSE 60 END END)::BIGINT AS b
        FROM (SELECT o_orderkey // 1500 AS image_id, (o_orderkey % 1500) // 50 AS y, o_orderkey % 50 AS x, o_orderstatus AS s FROM orders)
        UNION ALL SELECT 1000 + event_id // 1000, (event_id % 1000) // 40, event_id % 40, floor(value)::BIGINT % 256, user_id * 37 % 256, length(event_type) * 23 % 256 FROM events""",
    "lin": f"SELECT image_id, y, x, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM pixels",
    "fxyz": f"SELECT image_id, y, x, {_f(TO_XYZ[0], WHITE[0])} AS fx, {_f(TO_XYZ[1], WHITE[1])} AS fy, {_f(TO_XYZ[2], WHITE[2])} AS fz FROM lin",
    "lab": "SELECT image_id, y, x, fy * 116 - 16 AS lab_l, (fx - fy) * 500 AS lab_a, (fy - fz) * 200 AS lab_b FROM fxyz",
    "px": f"SELECT *, {_code(*(_bin(f'lab_{c}', 2.3) for c in 'lab'))} AS fine, {_code(*(_bin(f'lab_{c}', 11.5) for c in 'lab'))} AS coarse FROM lab",
    "fb": f"SELECT image_id, fine, {_coarse('fine')} AS coarse, count(*) AS cnt FROM px GROUP BY ALL",
    "cb0": "SELECT image_id, coarse, sum(cnt)::BIGINT AS cnt, (sum(sum(cnt)) OVER (PARTITION BY image_id))::BIGINT AS total FROM fb GROUP BY image_id, coarse",
    "cb1": "SELECT *, cnt / total AS coverage, {} AS lab_l, {} AS lab_a, {} AS lab_b FROM cb0".format(*_centre("coarse", 11.5)),
    "cb": f"SELECT *, sqrt(lab_a * lab_a + lab_b * lab_b) AS chroma, {_hue('lab_a', 'lab_b')} AS hue FROM cb1",
    "names0": "SELECT idx, name, {} AS lr, {} AS lg, {} AS lb FROM (VALUES ".format(*map(_lin, "rgb")) + ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, (n, r, g, b) in enumerate(css_names())) + ") t(idx, name, r, g, b)",
    "names1": f"SELECT idx, name, {_f(TO_XYZ[0], WHITE[0])} AS fx, {_f(TO_XYZ[1], WHITE[1])} AS fy, {_f(TO_XYZ[2], WHITE[2])} AS fz FROM names0",
    "names": "SELECT idx, name, fy * 116 - 16 AS nl, (fx - fy) * 500 AS na, (fy - fz) * 200 AS nb FROM names1",
    "labs": "SELECT DISTINCT lab_l, lab_a, lab_b FROM cb",
    "named0": "SELECT lab_l, lab_a, lab_b, {} AS r, {} AS g, {} AS b FROM labs".format(*_rgb("lab_l", "lab_a", "lab_b")),
    "named": """SELECT n.*, printf('#%02x%02x%02x', r, g, b) AS hex, (SELECT arg_min(name, {'d': (nl - lab_l) * (nl - lab_l) + (na - lab_a) * (na - lab_a) + (nb - lab_b) * (nb - lab_b), 'i': idx}) FROM names) AS name FROM named0 n""",
    "stab0": "SELECT image_id, coarse, count(*) AS n, var_pop({}) AS vl, var_pop({}) AS va, var_pop({}) AS vb FROM fb GROUP BY image_id, coarse".format(*_centre("fine")),
    "stab1": "SELECT *, round(vl + va + vb, 9) AS total, greatest(vl, va, vb) AS most FROM stab0",
    "stab": """SELECT image_id, coarse, n AS fine_count, CASE WHEN n > 2 THEN total ELSE 0 END AS fine_variance,
        CASE WHEN n <= 2 THEN 'anchor' WHEN round(most / (total + 1e-10), 9) > 0.5 THEN 'gradient' ELSE 'texture' END AS stability_type,
        CASE WHEN n > 2 AND round(most / (total + 1e-10), 9) > 0.5 THEN CASE WHEN round(vl, 9) >= round(most, 9) THEN 'L' WHEN round(va, 9) >= round(most, 9) THEN 'a' ELSE 'b' END END AS dominant_axis FROM stab1""",
    "stats": """SELECT image_id, quantile_cont(chroma, 0.5) AS median_chroma, quantile_cont(chroma, 0.75) - quantile_cont(chroma, 0.25) AS chroma_iqr, greatest(10e0, quantile_cont(chroma, 0.5) * 0.5) AS chroma_floor,
        min(lab_l) AS l_min, max(lab_l) AS l_max, min(chroma) AS chroma_min, max(chroma) AS chroma_max FROM cb GROUP BY image_id""",
    "chrom": "SELECT cb.*, chroma < chroma_floor AS neutral FROM cb JOIN stats USING (image_id)",
    "ford": "SELECT image_id, hue, row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, coarse) AS rn FROM chrom WHERE NOT neutral",
    "ffold(image_id, rn, seeds)": f"""SELECT DISTINCT image_id, 0::BIGINT, []::DOUBLE[] FROM cb UNION ALL
        SELECT f.image_id, o.rn, CASE WHEN len(list_filter(f.seeds, lambda s: {_apart('s', 'o.hue')} <= {_d(HUE_RANGE)})) > 0 THEN f.seeds ELSE list_append(f.seeds, o.hue) END FROM ffold f JOIN ord_ o ON o.image_id = f.image_id AND o.rn = f.rn + 1""".replace("ord_", "ford"),
    "fseeds": "SELECT image_id, arg_max(seeds, rn) AS seeds FROM ffold GROUP BY image_id",
    "fmem": f"SELECT c.*, CASE WHEN neutral THEN len(seeds) ELSE list_min(list_transform(range(len(seeds)), lambda i: CASE WHEN {_apart('seeds[i + 1]', 'hue')} <= {_d(HUE_RANGE)} THEN i END)) END::INTEGER AS family_idx, seeds FROM chrom c JOIN fseeds USING (image_id)",
    "fam": """SELECT image_id, family_idx, neutral AS is_neutral, CASE WHEN neutral THEN 0 ELSE ((degrees(atan2(sum(sin(radians(hue))), sum(cos(radians(hue))))) % 360e0) + 360e0) % 360e0 END AS hue_center,
        min(lab_l) AS l_min, max(lab_l) AS l_max, min(chroma) AS chroma_min, max(chroma) AS chroma_max, sum(cnt) / any_value(total) AS coverage, list(coarse ORDER BY coarse) AS members FROM fmem GROUP BY image_id, family_idx, neutral""",
    "offs": "SELECT * FROM (VALUES " + ", ".join(f"('{d}', {_STEP[d][0]}, {_STEP[d][1]})" for d in DIRECTIONS) + ") t(d, dy, dx)",
    "edges": "SELECT a.image_id, a.fine AS src, b.fine AS nbr, d FROM px a, offs o, px b WHERE b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx AND a.fine <> b.fine",
    "dirs": "SELECT image_id, src, nbr, " + ", ".join(f"count(*) FILTER (WHERE d = '{d}') AS \"{d}\"" for d in DIRECTIONS) + " FROM edges GROUP BY image_id, src, nbr",
    "adj": "SELECT image_id, least(src, nbr) AS b1, greatest(src, nbr) AS b2, count(*) AS cnt FROM edges GROUP BY ALL",
    "near": f"SELECT DISTINCT image_id, c1 AS coarse, c2 AS other FROM (SELECT image_id, {_coarse('src')} AS c1, {_coarse('nbr')} AS c2 FROM edges) WHERE c1 <> c2",
    "nm0": "SELECT image_id, coarse, count(*) AS n, avg({}) AS lc FROM near GROUP BY image_id, coarse".format(_dist(_centre("coarse", 11.5), _centre("other", 11.5))),
    "nm": "SELECT image_id, coarse, coalesce(n, 0) AS n_neighbours, round(coalesce(lc, 0), 9) AS local_contrast, 1 - coalesce(n, 0) / (max(coalesce(n, 0)) OVER (PARTITION BY image_id) + 1)::DOUBLE AS isolation FROM cb LEFT JOIN nm0 USING (image_id, coarse)",
    "runs": "SELECT image_id, coarse, y, min(x) AS x0, max(x) AS x1, row_number() OVER () AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y, coarse ORDER BY x) AS isle FROM px) GROUP BY image_id, coarse, y, isle",
    "redges": "SELECT a.id AS u, b.id AS v FROM runs a JOIN runs b ON a.image_id = b.image_id AND a.coarse = b.coarse AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1",
    "reach(id, root)": "SELECT id, id FROM runs UNION SELECT e.v, r.root FROM reach r JOIN redges e ON e.u = r.id",
    "comp": "SELECT id, min(root) AS root FROM reach GROUP BY id",
    "csize": "SELECT image_id, coarse, root, sum(x1 - x0 + 1) AS n FROM runs JOIN comp USING (id) GROUP BY ALL",
    "coh": "SELECT image_id, coarse, max(n) / any_value(cnt)::DOUBLE AS coherence FROM csize JOIN cb USING (image_id, coarse) GROUP BY image_id, coarse",
    "met": "SELECT cb.*, n_neighbours, local_contrast, isolation, coherence FROM cb JOIN nm USING (image_id, coarse) JOIN coh USING (image_id, coarse)",
    "flow0": "SELECT *, {} AS total FROM dirs WHERE {} >= {}".format(" + ".join(_ALL), " + ".join(_ALL), MIN_EDGES),
    "flow1": _axis_edges(),
    "fe": f"""SELECT f.image_id, src, CASE WHEN fl > 0 THEN p ELSE n END AS dir, nbr, round(abs(fl) * sqrt(coalesce(a.coherence, 1) * coalesce(b.coherence, 1)), 9) AS weight, total
        FROM flow1 f LEFT JOIN coh a ON a.image_id = f.image_id AND a.coarse = {_coarse('src')} LEFT JOIN coh b ON b.image_id = f.image_id AND b.coarse = {_coarse('nbr')} WHERE asym > {_d(MIN_ASYMMETRY)}""",
    "fl": "SELECT image_id, dir, src, list(nbr ORDER BY weight DESC, nbr) AS nbrs FROM fe GROUP BY image_id, dir, src",
    "ext": "SELECT DISTINCT image_id, unnest([{}]) AS fine FROM fb GROUP BY image_id".format(", ".join(f"arg_min(fine, {{'v': {s}{p}, 'f': fine}})" for p in _parts("fine") for s in ("", "-"))),
    "con": "SELECT image_id, src AS fine, round(avg({}), 9) AS contrast FROM (SELECT DISTINCT image_id, src, nbr FROM fe) GROUP BY image_id, src".format(_dist(_centre("src"), _centre("nbr"))),
    "seed0": """SELECT fb.image_id, fb.fine, fb.cnt, total, coalesce(contrast, 0) AS contrast, e.fine IS NOT NULL AS is_extreme, coalesce(coherence, 0.5) AS coherence FROM fb
        JOIN (SELECT DISTINCT image_id, total FROM cb) USING (image_id) LEFT JOIN con USING (image_id, fine) LEFT JOIN ext e ON e.image_id = fb.image_id AND e.fine = fb.fine LEFT JOIN coh ON coh.image_id = fb.image_id AND coh.coarse = fb.coarse""",
    "seed1": "SELECT *, max(contrast) OVER (PARTITION BY image_id) AS most FROM seed0",
    "seed2": "SELECT *, round((cnt / total::DOUBLE * 10 + CASE WHEN most > 0 THEN contrast / most ELSE 0 END * 0.3e0 + CASE WHEN is_extreme THEN 0.2e0 ELSE 0 END) * coherence, 9) AS score FROM seed1",
    "seed": "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, fine) - 1 AS seed_rank FROM seed2",
    "dnum": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{d}')" for i, d in enumerate(DIRECTIONS)) + ") t(dir_rank, dir)",
    "walk(image_id, dir_rank, dir, seed_rank, cur, path)": f"""SELECT image_id, dir_rank, dir, seed_rank, fine, [fine] FROM seed, dnum WHERE seed_rank < {SEEDS} AND image_id IN (SELECT image_id FROM fl) UNION ALL
        SELECT image_id, dir_rank, dir, seed_rank, nxt, list_append(path, nxt) FROM (SELECT w.*, list_filter(l.nbrs, lambda n: NOT list_contains(w.path, n))[1] AS nxt FROM walk w JOIN fl l ON l.image_id = w.image_id AND l.dir = w.dir AND l.src = w.cur) WHERE nxt IS NOT NULL""",
    "ch0": f"SELECT image_id, dir_rank, seed_rank, arg_max(path, len(path)) AS chain FROM walk GROUP BY image_id, dir_rank, seed_rank HAVING max(len(path)) >= {MIN_CHAIN}",
    "ch1": "SELECT image_id, dir_rank, seed_rank, unnest(chain) AS fine FROM ch0",
    "ch2": "SELECT image_id, dir_rank, seed_rank, sum(cnt)::BIGINT AS covered, {} FROM ch1 JOIN fb USING (image_id, fine) GROUP BY image_id, dir_rank, seed_rank".format(", ".join(f"min({p}) AS {c}_lo, max({p}) AS {c}_hi" for c, p in zip("lab", _parts("fine"), strict=True))),
    "ch3": "SELECT ch0.*, covered, l_lo, l_hi, a_lo, a_hi, b_lo, b_hi, len(chain) AS length, covered / total::DOUBLE AS coverage, len(chain) * covered AS score FROM ch0 JOIN ch2 USING (image_id, dir_rank, seed_rank) JOIN (SELECT DISTINCT image_id, total FROM cb) USING (image_id)",
    "chains": "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, dir_rank, seed_rank) AS cand_rank FROM ch3",
    "dfold(image_id, cand_rank, kept)": f"""SELECT DISTINCT image_id, 0::BIGINT, []::STRUCT(cand_rank BIGINT, l_lo BIGINT, l_hi BIGINT, a_lo BIGINT, a_hi BIGINT, b_lo BIGINT, b_hi BIGINT)[] FROM chains UNION ALL
        SELECT f.image_id, c.cand_rank, CASE WHEN len(f.kept) >= {MOST} OR len(list_filter(f.kept, lambda k: ({_IN('l')}) AND ({_IN('a')}) AND ({_IN('b')}))) > 0 THEN f.kept
        ELSE list_append(f.kept, {{'cand_rank': c.cand_rank, 'l_lo': l_lo, 'l_hi': l_hi, 'a_lo': a_lo, 'a_hi': a_hi, 'b_lo': b_lo, 'b_hi': b_hi}}) END FROM dfold f JOIN chains c ON c.image_id = f.image_id AND c.cand_rank = f.cand_rank + 1""",
    "dkept": "SELECT image_id, unnest(kept).cand_rank AS cand_rank FROM (SELECT image_id, arg_max(kept, cand_rank) AS kept FROM dfold GROUP BY image_id)",
    "dd": "SELECT chains.* FROM chains JOIN dkept USING (image_id, cand_rank)",
    "pts": "SELECT image_id, cand_rank, i, {} FROM (SELECT image_id, cand_rank, unnest(chain) AS c, unnest(range(len(chain))) AS i FROM dd)".format(", ".join(f"{p} AS {n}" for n, p in zip("lab", _centre("c"), strict=True))),
    "vec": "SELECT image_id, cand_rank, i, lead(l) OVER w - l AS l, lead(a) OVER w - a AS a, lead(b) OVER w - b AS b FROM pts WINDOW w AS (PARTITION BY image_id, cand_rank ORDER BY i)",
    "turn0": "SELECT image_id, cand_rank, CASE WHEN lead(l) OVER w IS NOT NULL THEN degrees(acos(greatest(-1, least(1, (l * lead(l) OVER w + a * lead(a) OVER w + b * lead(b) OVER w) / (sqrt(l * l + a * a + b * b) * sqrt(lead(l) OVER w * lead(l) OVER w + lead(a) OVER w * lead(a) OVER w + lead(b) OVER w * lead(b) OVER w)))))) END AS t FROM vec WHERE l IS NOT NULL WINDOW w AS (PARTITION BY image_id, cand_rank ORDER BY i)",
    "turns": "SELECT image_id, cand_rank, round(avg(t), 9) AS mean_turn FROM turn0 WHERE t IS NOT NULL GROUP BY image_id, cand_rank",
    "stops0": f"SELECT image_id, cand_rank, coarse, min(i) AS i FROM (SELECT image_id, cand_rank, i, {_coarse('c')} AS coarse FROM (SELECT image_id, cand_rank, unnest(chain) AS c, unnest(range(len(chain))) AS i FROM dd)) GROUP BY image_id, cand_rank, coarse",
    "stops": "SELECT image_id, cand_rank, list(coarse ORDER BY i) AS stops FROM stops0 GROUP BY image_id, cand_rank",
    "gr0": f"""SELECT dd.*, stops, mean_turn FROM dd JOIN stops USING (image_id, cand_rank) LEFT JOIN turns USING (image_id, cand_rank)
        WHERE len(stops) >= 2 AND round((l_hi - l_lo + a_hi - a_lo + b_hi - b_lo) * 2.3e0, 9) >= {_d(MIN_SPAN)} AND (mean_turn IS NULL OR mean_turn < {_d(MAX_TURN)})""",
    "gr": "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cand_rank) - 1 AS gradient_idx, CASE WHEN dir_rank IN (0, 1) THEN 'horizontal' WHEN dir_rank IN (2, 3) THEN 'vertical' WHEN dir_rank IN (4, 7) THEN 'diagonal' ELSE 'anti-diagonal' END AS direction FROM gr0",
    "gs": "SELECT image_id, gradient_idx, unnest(stops) AS coarse FROM gr",
    "gm": "SELECT image_id, coarse, count(*) AS gradient_count, list(gradient_idx ORDER BY gradient_idx) AS gradients FROM gs GROUP BY image_id, coarse",
    "fspan": f"""SELECT gs.image_id, gradient_idx, list_sort(list_filter(list(DISTINCT CASE WHEN chroma >= {_d(STOP_CHROMA)} THEN (SELECT min(family_idx) FROM fam WHERE fam.image_id = gs.image_id AND NOT is_neutral AND {_apart('hue_center', 'cb.hue')} <= {_d(HUE_RANGE)}) END), lambda x: x IS NOT NULL)) AS family_span
        FROM gs JOIN cb ON cb.image_id = gs.image_id AND cb.coarse = gs.coarse GROUP BY gs.image_id, gradient_idx""",
    "sig0": "SELECT met.*, coalesce(stability_type, 'texture') AS stability_type, median_chroma, chroma_iqr FROM met LEFT JOIN stab USING (image_id, coarse) JOIN stats USING (image_id)",
    "sig": """SELECT *, round(coverage * 100 + CASE WHEN chroma_iqr > 0 AND chroma > median_chroma THEN least(5, (chroma - median_chroma) / (chroma_iqr + 1) * 2) ELSE 0 END + CASE WHEN coverage > 0.001e0 THEN isolation * 3 ELSE 0 END
        + coherence * 5 + CASE stability_type WHEN 'anchor' THEN 3 WHEN 'gradient' THEN 1 ELSE 0 END, 9) AS significance, chroma > median_chroma + chroma_iqr AND coverage < 0.05e0 AND coverage > 0.001e0 AND isolation > 0.3e0 AS is_accent,
        row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, coarse) - 1 AS coverage_rank FROM sig0""",
    "sord": f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY significance DESC, coarse) AS rn, greatest(1e0, round(max(significance) OVER (PARTITION BY image_id) * {_d(MIN_SHARE)}, 9)) AS floor_ FROM sig",
    "sfold(image_id, rn, kept)": f"""SELECT DISTINCT image_id, 0::BIGINT, []::STRUCT(coarse BIGINT, l DOUBLE, a DOUBLE, b DOUBLE)[] FROM cb UNION ALL
        SELECT image_id, rn, CASE WHEN len(kept) < {MOST} AND round(significance - coalesce(greatest(0e0, 1 - nearest / {_d(SIMILAR)}) * (1 - least(1e0, coverage / {_d(ANCHOR)})) * {_d(PENALTY)}, 0), 9) >= floor_ THEN list_append(kept, {{'coarse': coarse, 'l': lab_l, 'a': lab_a, 'b': lab_b}}) ELSE kept END
        FROM (SELECT s.*, f.kept, list_min(list_transform(f.kept, lambda k: sqrt((s.lab_l - k.l) * (s.lab_l - k.l) + (s.lab_a - k.a) * (s.lab_a - k.a) + (s.lab_b - k.b) * (s.lab_b - k.b)))) AS nearest FROM sfold f JOIN sord s ON s.image_id = f.image_id AND s.rn = f.rn + 1)""",
    "chosen": "SELECT image_id, unnest(kept).coarse AS coarse, unnest(range(len(kept))) AS position FROM (SELECT image_id, arg_max(kept, rn) AS kept FROM sfold GROUP BY image_id)",
    "nc0": """SELECT s.*, position, r, g, b, hex, name, coalesce(gradient_count, 0) AS gradient_count, coalesce(gradients, []) AS gradients,
        CASE WHEN is_accent THEN 'accent' WHEN coverage_rank = 0 THEN 'dominant' WHEN coverage_rank <= 2 THEN 'secondary' WHEN s.lab_l < 30 THEN 'dark' WHEN s.lab_l > 70 THEN 'light' ELSE 'secondary' END AS role
        FROM sig s JOIN chosen USING (image_id, coarse) JOIN named n ON n.lab_l = s.lab_l AND n.lab_a = s.lab_a AND n.lab_b = s.lab_b LEFT JOIN gm USING (image_id, coarse)""",
    "nc": """SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE role WHEN 'dominant' THEN 0 WHEN 'secondary' THEN 1 WHEN 'dark' THEN 2 WHEN 'light' THEN 3 ELSE 4 END, cnt DESC, position) - 1 AS pos,
        list_filter([CASE role WHEN 'dominant' THEN 'Largest coverage, anchors the palette' WHEN 'accent' THEN 'High chroma focal point' END, CASE WHEN role = 'accent' AND isolation > 0.7 THEN 'spatially isolated' END,
        CASE stability_type WHEN 'anchor' THEN 'Stable across scales' WHEN 'texture' THEN 'Textured/varied region' END, CASE WHEN coherence > 0.7 THEN 'Forms coherent region' WHEN coherence < 0.3 THEN 'Scattered distribution' END,
        CASE WHEN gradient_count > 0 THEN 'Part of ' || gradient_count || ' gradient(s)' END], lambda x: x IS NOT NULL) AS characteristics FROM nc0""",
    "cp0": f"SELECT p.image_id, p.pos AS i, q.pos AS j, p.name AS color_a, q.name AS color_b, abs(p.lab_l - q.lab_l) AS delta_l, round((greatest({_lum('p')}, {_lum('q')}) + 0.05e0) / (least({_lum('p')}, {_lum('q')}) + 0.05e0), 9) AS ratio FROM nc p JOIN nc q ON p.image_id = q.image_id AND p.pos < q.pos AND abs(p.lab_l - q.lab_l) > {_d(CONTRAST_L)}",
    "cp1": "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ratio DESC, i, j) - 1 AS pair FROM cp0",
    "cp": f"SELECT image_id, pair, color_a, color_b, delta_l, ratio, CASE WHEN ratio >= 7 THEN 'AAA' WHEN ratio >= 4.5 THEN 'AA' WHEN ratio >= 3 THEN 'AA-large' ELSE 'fail' END AS wcag_level FROM cp1 WHERE pair < {PAIRS}",
    "hp0": f"SELECT p.image_id, p.pos AS i, q.pos AS j, p.name AS color_a, q.name AS color_b, {_apart('p.hue', 'q.hue')} AS hue_difference FROM nc p JOIN nc q ON p.image_id = q.image_id AND p.pos < q.pos AND p.name <> q.name AND p.chroma >= {_d(HARMONY_CHROMA)} AND q.chroma >= {_d(HARMONY_CHROMA)} AND {_apart('p.hue', 'q.hue')} < {_d(HUE_RANGE)}",
    "hp1": "SELECT *, row_number() OVER (PARTITION BY image_id, least(color_a, color_b), greatest(color_a, color_b) ORDER BY i, j) AS n FROM hp0",
    "hp": f"SELECT * FROM (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY i, j) - 1 AS pair, color_a, color_b, hue_difference FROM hp1 WHERE n = 1) WHERE pair < {PAIRS}",
    "di0": "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, pos) AS rank FROM nc",
    "di": "SELECT image_id, count(*) AS n_colors, count(*) FILTER (WHERE role = 'accent') AS accents, round(max(coverage * 100), 9) AS d, round(coalesce(sum(coverage * 100) FILTER (WHERE role = 'accent'), 0), 9) AS a, round(coalesce(sum(coverage * 100) FILTER (WHERE role <> 'accent'), 0), 9) AS s, round(sum(coverage * 100) FILTER (WHERE rank <= 3), 9) AS top3 FROM di0 GROUP BY image_id",
    "dist": f"""SELECT image_id, n_colors, accents, CASE WHEN d >= 15 AND a < 1 THEN 'Dominant-led: ' || {_F0('d')} || '% primary, ' || {_F0('round(s - d, 9)')} || '% supporting'
        WHEN d >= 15 THEN 'Structured: ' || {_F0('d')} || '% dominant, ' || {_F0('round(s - d, 9)')} || '% secondary, ' || printf('%.1f', round_even(a, 1)) || '% accent' WHEN top3 >= 40 THEN 'Tiered: Top 3 colors cover ' || {_F0('top3')} || '% of image'
        ELSE 'Distributed: ' || n_colors || ' colors share coverage' END AS distribution FROM di""",
    "sc0": "SELECT image_id, coalesce(list(hue_center ORDER BY family_idx) FILTER (WHERE NOT is_neutral), []) AS h, coalesce(max(coverage) FILTER (WHERE is_neutral), 0) AS grey FROM fam GROUP BY image_id",
    "sc": "SELECT *, len(h) AS n, list_sort(h) AS up, accents > 0 AS acc FROM stats JOIN sc0 USING (image_id) JOIN dist USING (image_id)",
    "summary": f"""SELECT *, CASE WHEN n = 0 THEN 'achromatic' WHEN n = 1 AND acc AND grey > 0.5 THEN 'neutral_accent' WHEN n = 1 THEN 'monochromatic' WHEN n = 2 AND {_apart('h[1]', 'h[2]')} < 60 THEN 'analogous'
        WHEN n = 2 AND {_apart('h[1]', 'h[2]')} > 150 AND {_apart('h[1]', 'h[2]')} < 210 THEN 'complementary' WHEN n = 3 AND up[2] - up[1] > 80 AND up[2] - up[1] < 160 AND up[3] - up[2] > 80 AND up[3] - up[2] < 160 AND up[1] + 360 - up[3] > 80 AND up[1] + 360 - up[3] < 160 THEN 'triadic'
        WHEN n >= 2 AND {_apart('up[1]', 'up[2]')} < 60 AND acc THEN 'analogous_accent' ELSE 'complex' END AS scheme_type FROM sc""",
    "summ": f"""SELECT *, CASE scheme_type WHEN 'achromatic' THEN 'Grayscale palette with no chromatic content' WHEN 'neutral_accent' THEN 'Neutral base with ' || {_F0('h[1]')} || '° accent' WHEN 'monochromatic' THEN 'Single hue family around ' || {_F0('h[1]')} || '°'
        WHEN 'analogous' THEN 'Adjacent hues (' || {_F0('h[1]')} || '° and ' || {_F0('h[2]')} || '°)' WHEN 'complementary' THEN 'Opposing hues (' || {_F0('h[1]')} || '° and ' || {_F0('h[2]')} || '°)' WHEN 'triadic' THEN 'Three hues roughly 120° apart'
        WHEN 'analogous_accent' THEN 'Analogous base with contrasting accent' ELSE 'Multi-hue palette with ' || n || ' color families' END AS scheme_description FROM summary""",
}


_NL = "chr(10)"
_F1 = lambda v: f"printf('%.1f', round_even({v}, 1))"
_LAB3 = f"{_F0('lab_l')} || ', ' || {_F0('lab_a')} || ', ' || {_F0('lab_b')}"
_RGB3 = "r || ', ' || g || ', ' || b"
CTES |= {
    "pcol": f"""SELECT image_id, string_agg('[' || upper(role[1]) || role[2:] || '] ' || name || {_NL} || '  Hex: ' || hex || ' | RGB: (' || {_RGB3} || ') | LAB: (' || {_LAB3} || ')' || {_NL}
        || '  Coverage: ' || CASE WHEN coverage * 100 >= 0.1e0 THEN {_F1('coverage * 100')} || '%' ELSE '<0.1%' END || ' | Chroma: ' || {_F0('chroma')} || {_NL}
        || CASE WHEN len(characteristics) > 0 THEN '  ' || array_to_string(characteristics, '. ') || '.' || {_NL} ELSE '' END, {_NL} ORDER BY pos) AS t FROM nc GROUP BY image_id""",
    "pst0": "SELECT gr.image_id, gradient_idx, unnest(stops) AS coarse, unnest(range(len(stops))) AS i FROM gr",
    "pst": f"""SELECT p.image_id, gradient_idx, string_agg(name, ' → ' ORDER BY i) AS names, string_agg('    ' || (i + 1) || '. ' || name || ' ' || hex || ' / RGB(' || {_RGB3} || ') / LAB(' || {_LAB3} || ')', {_NL} ORDER BY i) AS t
        FROM pst0 p JOIN cb ON cb.image_id = p.image_id AND cb.coarse = p.coarse JOIN named USING (lab_l, lab_a, lab_b) GROUP BY p.image_id, gradient_idx""",
    "pgr": f"""SELECT image_id, string_agg(names || {_NL} || '  Stops:' || {_NL} || t || {_NL} || '  Direction: ' || direction || ' | Coverage: ' || {_F1('coverage * 100')} || '%' || {_NL}
        || '  Lightness span: ' || {_F0('l_hi * 2.3e0 - l_lo * 2.3e0')} || ' (L ' || {_F0('l_lo * 2.3e0')} || ' → ' || {_F0('l_hi * 2.3e0')} || ')' || {_NL}, {_NL} ORDER BY gradient_idx) AS t FROM gr JOIN pst USING (image_id, gradient_idx) GROUP BY image_id""",
    "pcp": f"SELECT image_id, string_agg('  - ' || color_a || ' / ' || color_b || ': Ratio ' || {_F1('ratio')} || ':1 (WCAG ' || wcag_level || ') | ΔL=' || {_F0('delta_l')}, {_NL} ORDER BY pair) AS t FROM cp GROUP BY image_id",
    "php": f"SELECT image_id, string_agg('  - ' || color_a || ' and ' || color_b || ': Similar hue (' || {_F0('hue_difference')} || '° apart)', {_NL} ORDER BY pair) AS t FROM hp GROUP BY image_id",
    "prose": f"""SELECT s.image_id, array_to_string(list_filter(['OVERVIEW:', 'The palette''s scheme, from its hues, and how far lightness (L) and chroma reach.', '', 'Scheme: ' || scheme_type, '  ' || scheme_description,
        'Lightness range: ' || {_F0('l_min')} || '-' || {_F0('l_max')} || ' | Chroma range: ' || {_F0('chroma_min')} || '-' || {_F0('chroma_max')}, 'Notable colors: ' || n_colors, 'Distribution: ' || distribution, '',
        'COLORS:', 'By prominence: dominant, secondary, dark and light, then accents.', '', pcol.t,
        'GRADIENTS:' || {_NL} || 'Smooth transitions between colors, with the axis along which they run.' || {_NL} || {_NL} || pgr.t,
        'RELATIONSHIPS:', 'Contrast by WCAG (AAA from 7:1, AA from 4.5:1, AA-large from 3:1); harmony by hue.', '',
        'Contrast pairs (high separation):' || {_NL} || pcp.t || {_NL}, 'Harmonic pairs (similar hue):' || {_NL} || php.t], lambda x: x IS NOT NULL), {_NL}) AS report
        FROM summ s LEFT JOIN pcol USING (image_id) LEFT JOIN pgr USING (image_id) LEFT JOIN pcp USING (image_id) LEFT JOIN php USING (image_id)""",
}


def _esc(s: str) -> str:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        s = f"replace({s}, '{plain}', '{safe}')"
    return s


def _glue(*parts: str) -> str:
    """Texts and, in braces, expressions, as one expression."""
    out = []
    for p in parts:
        out.append(p[1:-1] if p[0] == "{" else "'" + p.replace("'", "''") + "'")
    return " || ".join(out)


def _chip(side: str) -> str:
    return _glue('<div class="chip" style="background:', f"{{hex_{side}}}", ";color:", f"{{ink_{side}}}", '">', f"{{hex_{side}}}", "</div>")


_HEAD = '<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><meta name="viewport" content="width=device-width, initial-scale=1">'
_PAIR = "{" + _esc("color_a || ' / ' || color_b") + "}"
_SIDES = "FROM {} p LEFT JOIN hlast x ON x.image_id = p.image_id AND x.name = color_a LEFT JOIN hlast z ON z.image_id = p.image_id AND z.name = color_b"
CTES |= {
    "hn": f"SELECT *, CASE WHEN lab_l > 50 THEN '#000' ELSE '#fff' END AS ink, {_F1('greatest(5, coverage / sum(coverage) OVER (PARTITION BY image_id) * 100)')} AS flex FROM nc",
    "hstrip": f"""SELECT image_id, string_agg({_glue('<div style="background:', '{hex}', ';color:', '{ink}', ';flex:', '{flex}', '">', '{hex}', '</div>')}, {_NL} ORDER BY pos) AS t FROM hn GROUP BY image_id""",
    "htrait": f"""SELECT *, CASE WHEN coverage >= 0.001e0 THEN {_F1('coverage * 100')} || '%' ELSE '&lt;0.1%' END AS share,
        CASE WHEN len(characteristics) > 0 THEN '<br>' || {_esc("array_to_string(characteristics, '. ')")} || '.' ELSE '' END AS traits FROM hn""",
    "hcard": "SELECT image_id, string_agg({}, {} ORDER BY pos) AS t FROM htrait GROUP BY image_id".format(_glue('<div class="row"><div class="chip" style="background:', "{hex}", ";color:", "{ink}", '">', "{hex}", "</div><div><b>", "{role}", "</b> ", "{" + _esc("name") + "}",
        '<div class="muted">RGB(', "{" + _RGB3 + "}", ") · LAB(", "{" + _LAB3 + "}", ")<br>Coverage ", "{share}", " · Chroma ", "{" + _F0("chroma") + "}", "{traits}", "</div></div></div>"), _NL),
    "hcss0": "SELECT image_id, gradient_idx, least(len(chain), 20) AS n, unnest(range(least(len(chain), 20))) AS i, chain FROM gr",
    "hcss1": "SELECT image_id, gradient_idx, n, i, chain[1 + CASE WHEN len(chain) > 20 THEN i * (len(chain) - 1) // 19 ELSE i END] AS c FROM hcss0",
    "hcss2": "SELECT image_id, gradient_idx, n, i, {} AS lab_l, {} AS lab_a, {} AS lab_b FROM hcss1".format(*_centre("c")),
    "hcss3": "SELECT image_id, gradient_idx, n, i, {} AS r, {} AS g, {} AS b FROM hcss2".format(*_rgb("lab_l", "lab_a", "lab_b")),
    "hcss": f"SELECT image_id, gradient_idx, string_agg(printf('#%02x%02x%02x', r, g, b) || ' ' || {_F0('i / greatest(n - 1, 1)::DOUBLE * 100')} || '%', ', ' ORDER BY i) AS css FROM hcss3 GROUP BY image_id, gradient_idx",
    "hstop": "SELECT p.image_id, gradient_idx, string_agg({}, '' ORDER BY i) AS t FROM pst0 p JOIN cb ON cb.image_id = p.image_id AND cb.coarse = p.coarse JOIN named USING (lab_l, lab_a, lab_b) GROUP BY p.image_id, gradient_idx".format(
        _glue('<span class="row"><span class="chip" style="background:', "{hex}", '"></span>', "{" + _esc("name") + "}", "</span>")),
    "hbar": "SELECT image_id, string_agg({}, {} ORDER BY gradient_idx) AS t FROM gr JOIN hcss USING (image_id, gradient_idx) JOIN hstop USING (image_id, gradient_idx) GROUP BY image_id".format(_glue('<div class="bar" style="background:linear-gradient(to right, ', "{css}", ')"></div><div class="row">', "{t}",
        '</div><p class="muted">Direction ', "{direction}", " · Coverage ", "{" + _F1("coverage * 100") + "}", "% · Lightness span ", "{" + _F0("(l_hi - l_lo) * 2.3e0") + "}", "</p>"), _NL),
    "hlast": "SELECT image_id, name, arg_max(hex, pos) AS hex, arg_max(ink, pos) AS ink FROM hn GROUP BY image_id, name",
    "hcp0": "SELECT p.*, coalesce(x.hex, '#888') AS hex_a, coalesce(z.hex, '#fff') AS hex_b " + _SIDES.format("cp"),
    "hcp": "SELECT image_id, string_agg({}, {} ORDER BY pair) AS t FROM hcp0 GROUP BY image_id".format(_glue('<div class="row"><div class="chip" style="background:', "{hex_a}", ";color:", "{hex_b}", '">Aa</div>', _PAIR, ": ", "{" + _F1("ratio") + "}", ':1 <span class="level">', "{wcag_level}", "</span></div>"), _NL),
    "hhp0": "SELECT p.*, coalesce(x.hex, '#888') AS hex_a, coalesce(z.hex, '#888') AS hex_b, coalesce(x.ink, '#fff') AS ink_a, coalesce(z.ink, '#fff') AS ink_b " + _SIDES.format("hp"),
    "hhp": "SELECT image_id, string_agg({}, {} ORDER BY pair) AS t FROM hhp0 GROUP BY image_id".format(_glue('<div class="row">', "{" + _chip("a") + "}", "{" + _chip("b") + "}", _PAIR, ": ", "{" + _F0("hue_difference") + "}", "° apart</div>"), _NL),
    "html": "SELECT s.image_id, array_to_string(list_filter([{}], lambda x: x IS NOT NULL), {}) AS html FROM summ s LEFT JOIN hstrip USING (image_id) LEFT JOIN hcard USING (image_id) LEFT JOIN hbar USING (image_id) LEFT JOIN hcp USING (image_id) LEFT JOIN hhp USING (image_id)".format(", ".join((
        _glue(_HEAD), _glue("<title>Palette: ", "{s.image_id}", f"</title><style>{STYLE}</style></head><body>"),
        _glue("<h1>", "{scheme_type}", "</h1><p>", "{scheme_description}", '</p><p class="muted">Source: ', "{s.image_id}", "<br>Lightness ", "{" + _F0("l_min") + "}", "–", "{" + _F0("l_max") + "}", " · Chroma ", "{" + _F0("chroma_min") + "}", "–", "{" + _F0("chroma_max") + "}", " · ", "{n_colors}", " colors<br>", "{distribution}", "</p>"),
        _glue('<div class="strip">'), "hstrip.t", _glue("</div>"), *(f"'<h2>{title}</h2>' || {_NL} || {part}.t" for title, part in (("Colors", "hcard"), ("Gradients", "hbar"), ("Contrast pairs", "hcp"), ("Harmonic pairs", "hhp"))), _glue("</body></html>"))), _NL),
}


def _taps(side: str) -> str:
    """For each new pixel along a side the old ones it is made from and their weights: Lanczos of three lobes."""
    sinc = lambda t: f"(CASE WHEN {t} = 0 THEN 1e0 ELSE sin(pi() * {t}) / (pi() * {t}) END)"
    return f"""SELECT image_id, k, old_at, wt / sum(wt) OVER (PARTITION BY image_id, k) AS wt FROM (SELECT image_id, k, old_at, CASE WHEN abs(t) < 3 THEN {sinc('t')} * {sinc('(t / 3)')} ELSE 0 END AS wt FROM (SELECT *, (old_at - c + 0.5e0) / s AS t
        FROM (SELECT *, unnest(range(greatest(0, trunc(c - 3 * s + 0.5e0))::BIGINT, least(old, trunc(c + 3 * s + 0.5e0))::BIGINT)) AS old_at
        FROM (SELECT image_id, old, k, greatest(1e0, old / new::DOUBLE) AS s, (k + 0.5e0) * (old / new::DOUBLE) AS c FROM (SELECT image_id, {side} AS old, n{side} AS new, unnest(range(n{side})) AS k FROM isize)))))"""


def _weighted(taps: str, source: str, new: str, old: str, kept: str) -> str:
    value = ", ".join(f"least(255, greatest(0, floor(sum({c} * wt) + 0.5e0)))::BIGINT AS {c}" for c in "rgb")
    return f"SELECT p.image_id, {kept}, k AS {new}, {value} FROM {source} p JOIN {taps} t ON t.image_id = p.image_id AND t.old_at = p.{old} GROUP BY p.image_id, {kept}, k"


CTES |= {
    "isides": "SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM pixels GROUP BY image_id",
    "iclaim": "SELECT image_id, 9000 + image_id * 531 % 2000 AS width, CASE WHEN image_id % 5 = 0 THEN 10 ELSE 4000 + image_id * 977 % 4000 END AS height FROM isides",
    "ifiles": """SELECT 'whole/' || image_id || '.png' AS name, 'png' AS kind, width::BIGINT AS width, height::BIGINT AS height, NULL::VARCHAR AS reason FROM isides UNION ALL
        SELECT 'odd/' || image_id || '.png', 'png', width::BIGINT, height::BIGINT, CASE WHEN width > 10000 OR height > 10000 OR width * height > 50000000 THEN 'too large: ' || width || ' x ' || height || ' pixels'
        WHEN least(width, height) * (256e0 / greatest(width, height)) < 1 THEN 'too thin to scale down: ' || width || ' x ' || height || ' pixels' END FROM iclaim UNION ALL
        SELECT 'odd/' || image_id || '.txt', NULL, NULL, NULL, 'not an image that can be read' FROM isides""",
    "iwide": "SELECT image_id, y, x * 7 + i AS x, (r + i * 30) % 256 AS r, (g + i * 11) % 256 AS g, (b + i * 50) % 256 AS b FROM pixels, range(7) t(i)",
    "isize": "SELECT image_id, w, h, floor(w * (256e0 / greatest(w, h)))::BIGINT AS nw, floor(h * (256e0 / greatest(w, h)))::BIGINT AS nh FROM (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM iwide GROUP BY image_id)",
    "itapx": _taps("w"),
    "itapy": _taps("h"),
    "iacross": _weighted("itapx", "iwide", "x", "x", "y"),
    "iscaled": _weighted("itapy", "iacross", "y", "y", "x"),
}


_KEPT = {"ford", "redges", "fl", "seed", "chains", "sord"}


def sql(select: str) -> str:
    """A SELECT over the relations above. DuckDB leaves out those that it doesn't need; what a recursion reads is kept."""
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS {'MATERIALIZED ' * (name in _KEPT)}({body})" for name, body in CTES.items()) + "\n" + select
