"""Personal data (native: DataFrame operations only).

Regular expressions propose spans, checksums and value ranges confirm them, and context words nearby adjust a score.
Positions come from splitting a text at the same expression: the lengths of the gaps and of the matches add up to each
match's place in code points.

Base kinds (email, ip, card, phone) are always kept when their own test passes; context only moves their score. The
method adds three kinds: iban (mod-97), id (3-2-4 digits beside a context word) and secret (a key or token beside its
name), kept if their score reaches the threshold.

The expressions match what their plain forms match, but stay linear in the text and need no deep stack: runs are
possessive, and a match may only begin where a run begins or where the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

#: kind, expression on Java's engine, the plain expression
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"),
    ("id", r"(?:\G|(?<![0-9]))[0-9]++(?:-[0-9]++)++", r"[0-9]+(?:-[0-9]+)+"),
    ("secret", r"[A-Za-z0-9_+/=-]{20,}", r"[A-Za-z0-9_+/=-]{20,}"),
]
BASE = ("email", "ip", "card", "phone")
#: Words that raise a span's score when they stand within NEAR characters before or after it.
CONTEXT = {
    "email": "mail|contact|write to|kontakt|courriel|correo",
    "ip": "address|server|host|adresse|direcci",
    "card": "card|visa|mastercard|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "id": "ssn|social security|tax id|national id",
    "secret": "token|api.?key|secret|password|passwd|authorization|bearer",
}
#: score before context; what a context word adds; what a kind outside BASE needs
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "id": 0.3, "secret": 0.2}
BOOST, THRESHOLD, NEAR = 0.4, 0.5, 40


def _char(s: Column, i: Column) -> Column:
    return F.ascii(F.substring(s, i, F.lit(1)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        x = _char(digits, -i) - 48
        return total + F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number (two letters, two check digits, the rest) leaves 1 modulo 97."""
    t = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))

    def add(left: Column, i: Column) -> Column:
        c = _char(t, i)
        return F.when(c >= 65, left * 100 + c - 55).otherwise(left * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), F.lit(0), add) == 1


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        # A part of more than three digits can still be small by leading zeros.
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*[0-9]{1,3}$") & (F.right(F.concat(F.lit("00"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return _let(F.regexp_replace(m, "[^0-9]", ""), lambda d: F.length(d).between(12, 19) & luhn(d))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return _let(F.regexp_replace(m, " ", ""), lambda t: F.length(t).between(15, 34) & mod97(t))
    if kind == "id":
        return m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


_RUN = 256
_SPAN = "array<struct<start:int,rank:int,end:int,match:string,score:double,kept:boolean>>"


def _kind_spans(text: Column, rank: int, kind: str, pattern: str) -> Column:
    """_SPAN of one kind. A match starts at the lengths of all gaps and matches before it: whole runs of _RUN of them by
    a table of sums, the rest one by one, which keeps thousands of matches in one text cheap."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def lengths(s: Column) -> Column:
        steps = F.zip_with(s["found"], s["gaps"], lambda m, g: F.coalesce(F.length(m), F.lit(0)) + F.length(g))
        return F.struct(s["found"].alias("found"), s["gaps"].alias("gaps"), steps.alias("steps"))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def sums(s: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(s["found"]) / _RUN).cast("int")), lambda r: total(F.slice(s["steps"], r * _RUN + 1, _RUN)))
        return _let(runs, lambda r: F.struct(s["found"].alias("found"), s["gaps"].alias("gaps"), s["steps"].alias("steps"), F.transform(r, lambda _, i: total(F.slice(r, F.lit(1), i))).alias("runs")))

    def span(s: Column, m: Column, i: Column) -> Column:
        run = F.floor(i / _RUN).cast("int")
        start = F.get(s["runs"], run) + total(F.slice(s["steps"], run * _RUN + 1, i - run * _RUN)) + F.length(F.get(s["gaps"], i))
        near = F.concat(F.right(F.get(s["gaps"], i), F.lit(NEAR)), F.lit(" "), F.substring(F.get(s["gaps"], i + 1), 1, NEAR))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike("(?i)" + CONTEXT[kind]), F.lit(BOOST)).otherwise(F.lit(0.0))
        ok = F.lit(True) if kind in BASE else score >= THRESHOLD
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("end"), m.alias("match"), F.least(score, F.lit(1.0)).alias("score"), (_passes(kind, m) & ok).alias("kept"))

    def spans(s: Column) -> Column:
        return _let(lengths(s), lambda t: _let(sums(t), lambda u: F.filter(F.transform(u["found"], lambda m, i: span(u, m, i)), lambda x: x["kept"])))

    made = _let(F.struct(found.alias("found"), gaps.alias("gaps")), spans)
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def detect(docs: DataFrame) -> DataFrame:
    """docs + spans: array<struct<kind, start, end, match, score>> that pass, in order of start, then of KINDS; start and
    end in code points, end exclusive.

    One pass over each whole text and no shuffle: a row carries its own spans, so repeated rows and ids don't matter.
    Null and empty texts have none. A column of docs named spans is replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = F.array_sort(F.concat(*[_kind_spans(text, rank, kind, pattern) for rank, (kind, pattern, _) in enumerate(KINDS)]))
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return docs.withColumn("spans", F.transform(out, lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), s["score"].alias("score"))))


def redact(docs: DataFrame) -> DataFrame:
    """detect(docs) with `redacted`: the text with each span (of overlapping ones, the first) replaced by its kind."""
    d = detect(docs)

    def step(a: Column, s: Column) -> Column:
        add = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= a["at"], F.struct(add.alias("out"), s["end"].alias("at"))).otherwise(a)

    last = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return d.withColumn("redacted", last)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document; n_all: spans of all kinds."""
    d = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE]
    return d.select("doc_id", *counts, F.size("spans").cast("long").alias("n_all"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql_test(kind: str) -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    if kind == "ip":
        return "list_bool_and(list_transform(string_split(m, '.'), lambda p: regexp_full_match(p, '0*[0-9]{1,3}') AND right('00' || p, 3)::INT <= 255))"
    if kind == "card":
        x = "ascii(substr(%s, length(%s) + 1 - i, 1)) - 48" % (digits, digits)
        return f"length({digits}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {x} ELSE ({x}) * 2 - CASE WHEN {x} > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    if kind == "iban":
        t = "replace(m, ' ', '')"
        y = f"({t}[5:] || {t}[:4])"
        code = f"ascii(substr({y}, i, 1))"
        return f"length({t}) BETWEEN 15 AND 34 AND list_reduce(list_concat([0::BIGINT], list_transform(range(1, length({t}) + 1), lambda i: {code}::BIGINT)), lambda a, c: CASE WHEN c >= 65 THEN a * 100 + c - 55 ELSE a * 10 + c - 48 END % 97) = 1"
    if kind == "id":
        return "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"
    return "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')" if kind == "secret" else "TRUE"


def oracle(source: str = "documents") -> str:
    """The query as DuckDB SQL."""
    parts, needs = [], []
    for rank, (kind, _, plain) in enumerate(KINDS):
        parts.append(f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{plain}') AS f, regexp_split_to_array(t, '{plain}') AS g FROM d WHERE regexp_matches(t, '{plain}')")
        hit = f"regexp_matches(right(g[i], {NEAR}) || ' ' || left(g[i + 1], {NEAR}), '(?i){CONTEXT[kind]}')"
        score = f"{PRIOR[kind]} + CASE WHEN {hit} THEN {BOOST} ELSE 0 END >= {THRESHOLD}" if kind not in BASE else "TRUE"
        needs.append(f"WHEN '{kind}' THEN {_sql_test(kind)} AND {score}")
    listed = "coalesce(string_agg(concat_ws(':', kind, start, start + length(m)), ',' ORDER BY start, rank)%s, '')"
    base = " FILTER (WHERE kind IN (%s))" % ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
c AS ({" UNION ALL ".join(parts)}),
e AS (SELECT doc_id, rank, kind, f, g, unnest(range(1, len(f) + 1)) AS i FROM c),
p AS (SELECT doc_id, rank, kind, g, i, f[i] AS m, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM e),
k AS (SELECT * FROM p WHERE CASE kind {" ".join(needs)} END)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)}, count(kind) AS n_all, sha256({listed % base}) AS base_sha256, {listed % ""} AS spans
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""
