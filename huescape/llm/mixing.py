"""Mixing sources to target weights (native: DataFrame operations only).

Each source's words, its documents in a pseudorandom order, form one stream that is cut into blocks of a fixed length
(the last one shorter). A source's target says how many whole passes over its stream the mix takes and how many words of
one more pass. Every output shard draws its source counts from a multinomial over the targets. The draw is conditioned
on the corpus-wide counts: a free draw would leave small sources a few blocks (a tenth of their target and more) off
and let a document pass the repeat limit. The slots of a source map through pseudorandom permutations of its block
numbers, one permutation for each pass, and blocks are joined by (source, block).

Nothing here is sized by a key: streams are numbered by two-level prefix sums over hash buckets, slots are made in
chunks, and the one table that is sorted as a whole has a row for each source.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import hash32, md5_hex, stored, table, tidy

WORD = r"[^\x20\x09-\x0D]+"
BLOCK, SHARD, REPEATS, SEED, ROUNDS, CHUNK = 512, 1024, 3, "mix-1", 8, 4096


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(per_source: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) -> + target: a share by weight 1, 2, 3, 1, ... in code point order (null last) of all words,
    at most `repeats` times the source's words, what is over going to the others by weight until none is above.

    In closed form: sources stop at their limits in ascending order of limit / weight. Before the k-th stops, one weight
    unit is worth (all words - limits of the earlier) / (weights of the rest). That worth rises as long as sources stop
    and falls from then on, so the greatest is the one that holds.
    """
    # One row per source: this is sorted in one task by design.
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = per_source.withColumn("weight", ((F.row_number().over(ordered) - 1) % 3 + 1).cast("double"))
    w = w.withColumn("most", F.col("source_size").cast("double") * repeats)
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    earlier, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    unit = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / F.sum("weight").over(rest)
    w = w.withColumn("unit", unit)
    return w.withColumn("target", F.least("most", F.col("weight") * F.max("unit").over(everything))).select("source", "weight", "source_size", "target")


def _round_keys(*key: Column, seed: str) -> Column:
    return F.array(*[hash32(F.lit(seed), F.lit(r), *key) for r in range(ROUNDS)])


def _swap_or_not(x: Column, n: Column, keys: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1: in each round, x and its mirror image trade places or both stay."""

    def turn(x: Column, k: Column) -> Column:
        mirror = (k % n + n - x) % n
        return F.when(F.substring(md5_hex(k, F.greatest(x, mirror)), 1, 1) < "8", mirror).otherwise(x)

    return F.aggregate(keys, x, turn)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


class Mix:
    """A mix of `docs` (doc_id, text, source and any more columns).

    sizes: doc_id, source, size. sources: source, source_size, target, blocks, k, tail. slots: which block fills which
    slot of which shard, and how many of its words. taken: what the mix takes of each document.
    Null text and null source are ordinary (no words; a source of its own, last). Rows that share a doc_id stay apart
    unless their texts have equal sizes too, and then take equal shares. An empty table gives empty tables.
    """

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard: int = SHARD, repeats: int = REPEATS, seed: str = SEED):
        self.block, self.shard, self.repeats, self.seed = block, shard, repeats, seed
        sizes = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"))
        # The only pass over the texts. All the rest works on this narrow table.
        self.sizes = stored(sizes.withColumn("h", hash32(F.lit(seed), "doc_id")), "mix-sizes")
        rows = self.sizes.count()
        buckets = 1 << isqrt(rows).bit_length()  # as many buckets as rows in one, whatever the size
        self._tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bucket = (F.col("h") * buckets / 4294967296).cast("long")
        sums = self.sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        sums = stored(sums, "mix-buckets")
        self.sources = stored(self._counts(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), repeats)), "mix-sources")
        self.all_slots = self.sources.agg(F.max("all_slots")).first()[0] or 0
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        self.bases = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        self.placed = self._place(self.sizes.withColumn("bucket", bucket))
        self.slots = self._slots()

    def _counts(self, sources: DataFrame) -> DataFrame:
        """passes: whole passes; rest: words of one more; k: slots; base: slots of the sources before (code point order)."""
        b, size = F.lit(self.block), F.col("source_size")
        words = F.round("target").cast("long")
        s = sources.where("source_size > 0").withColumn("blocks", F.expr(f"(source_size + {self.block} - 1) div {self.block}"))
        s = s.withColumn("passes", F.floor(words / size).cast("long"))
        s = s.withColumn("rest", words - F.col("passes") * size)
        s = s.withColumn("k", F.col("passes") * F.col("blocks") + F.expr(f"(rest + {self.block} - 1) div {self.block}"))
        ordered = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
        s = s.withColumn("base", F.sum("k").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
        s = s.withColumn("all_slots", F.sum("k").over(Window.partitionBy()))
        none = sources.where("source_size = 0").select("source", "source_size", "target")
        s = s.select("source", "source_size", "target", "blocks", "passes", "rest", "k", F.coalesce("base", F.lit(0)).alias("base"), "all_slots", (size - (F.col("blocks") - 1) * b).alias("tail"))
        return s.unionByName(none, allowMissingColumns=True)

    def _place(self, sizes: DataFrame) -> DataFrame:
        """Each document's place [first, first + size) in its source's stream. Windows hold a bucket of a source each."""
        order = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        inner = sizes.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0))).alias("d")
        joined = inner.join(self.bases.alias("b"), _same(F.col("d.source"), F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket")), "left")
        return joined.select("d.doc_id", "d.source", "d.h", "d.size", (F.col("inner") + F.coalesce("base", F.lit(0))).alias("first"))

    def _slots(self) -> DataFrame:
        s = self.sources.where("k > 0")
        s = s.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass"))
        whole, b = F.col("pass") < F.col("passes"), self.block
        s = s.withColumn("m", F.when(whole, F.col("blocks")).otherwise(F.expr(f"(rest + {b} - 1) div {b}"))).where("m > 0")
        # The last, partial pass keeps the short tail block for its end, so that its words come out exactly.
        s = s.withColumn("n", F.when(whole, F.col("blocks")).otherwise(F.greatest(F.col("blocks") - 1, F.lit(1))))
        s = s.withColumn("left", F.when(whole, F.lit(b) * F.col("blocks")).otherwise(F.col("rest")))
        s = s.withColumn("keys", _round_keys(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), F.col("pass"), seed=self.seed))
        s = s.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {CHUNK}")))).repartition(self._tasks, "source", "pass", "chunk")
        x = s.withColumn("x", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("m"), (F.col("chunk") + 1) * CHUNK) - 1)))
        last = F.col("blocks") - 1
        x = x.withColumn("block", F.when(F.col("x") < F.col("n"), _swap_or_not(F.col("x"), F.col("n"), F.col("keys"))).otherwise(last))
        x = x.withColumn("words", F.least(F.col("left") - F.col("x") * b, F.when(F.col("block") == last, F.col("tail")).otherwise(F.lit(b))))
        j = F.col("base") + F.col("pass") * F.col("blocks") + F.col("x")
        x = x.withColumn("at", _swap_or_not(j, F.col("all_slots"), _round_keys(F.lit("slots"), seed=self.seed)))
        return x.select("source", "block", "pass", "words", F.expr(f"at div {self.shard}").alias("shard"), F.expr(f"at % {self.shard}").alias("slot"))

    @property
    def shard_counts(self) -> DataFrame:
        """The multinomial draw: shard, source, slots."""
        return self.slots.groupBy("shard", "source").agg(F.count("*").alias("slots"))

    def pieces(self) -> DataFrame:
        """doc_id, source, size, block, lo, hi: words lo to hi of the document's block (counted from the block's start),
        skip: words of the document before them."""
        p = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {self.block}"), F.expr(f"(first + size - 1) div {self.block}"))))
        lo = F.greatest(F.col("first"), F.col("block") * self.block)
        hi = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * self.block)
        return p.select("doc_id", "source", "size", "h", "block", (lo - F.col("block") * self.block).alias("lo"), (hi - F.col("block") * self.block).alias("hi"), (lo - F.col("first")).alias("skip"))

    def mixed(self) -> DataFrame:
        """The mix: shard, slot, place (in the slot), pass, source, block, doc_id, size, skip, words (words skip .. skip +
        words of the document)."""
        p, s = self.pieces().alias("p"), self.slots.alias("s")
        # The slots come from a few rows by way of sequences, so their estimated size says nothing: no broadcast.
        both = p.join(s.hint("merge"), _same(F.col("p.source"), F.col("s.source")) & (F.col("p.block") == F.col("s.block")))
        words = F.least("hi", "words") - F.col("lo")
        return both.where(words > 0).select("shard", "slot", F.col("lo").alias("place"), "pass", "p.source", "p.block", "doc_id", "size", "skip", words.alias("words"))

    def taken(self) -> DataFrame:
        """doc_id, source, size, taken: words that the mix takes of each document, repeats counted; first_shard, first_slot:
        where the first of them stand. Rows with nothing taken are left out."""
        by = self.mixed().groupBy("doc_id", "source", "size").agg(F.sum("words").alias("taken"), F.min(F.struct("shard", "slot")).alias("at"))
        return by.select("doc_id", "source", "size", "taken", F.col("at.shard").alias("first_shard"), F.col("at.slot").alias("first_slot"))


@tidy
def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard, first_slot of every row of docs (see Mix): what the shards
    hold of it (0 and null: nothing)."""
    m = Mix(docs, **options)
    d = m.sizes.withColumn("copies", F.count("*").over(Window.partitionBy("doc_id", "source", "size"))).alias("d")
    t, s = m.taken().alias("t"), m.sources.alias("s")
    both = d.join(t, _same(F.col("d.doc_id"), F.col("t.doc_id")) & _same(F.col("d.source"), F.col("t.source")) & (F.col("d.size") == F.col("t.size")), "left")
    out = both.join(s, _same(F.col("d.source"), F.col("s.source")), "left")
    return out.select("d.doc_id", "d.size", "s.source_size", "s.target", F.expr("coalesce(taken, 0) div copies").alias("taken"), "t.first_shard", "t.first_slot")


_SPACED = r"[\x20\x09-\x0D]*" + WORD


def _cut(text: Column, skip: Column, words: Column) -> Column:
    """words of a text from the skip-th on, white space before each kept."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(_SPACED), F.lit(0)), (skip + 1).cast("int"), words.cast("int")), "")


@tidy
def mixed_shards(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: shard, slot, pass, doc_id, source, text. A row for each piece of a document that a slot holds, the
    pieces of a slot side by side in order of their place in it (column `place`). Partitioned by shard, sorted by slot.
    Rows that share doc_id, source and size each give their pieces."""
    m = Mix(docs, **options)
    own = "__mix_size"
    d = docs.select("doc_id", "source", "text", count_words(F.col("text")).alias(own)).alias("d")
    both = m.mixed().alias("m").join(d, _same(F.col("d.doc_id"), F.col("m.doc_id")) & _same(F.col("d.source"), F.col("m.source")) & (F.col(f"d.{own}") == F.col("m.size")))
    rows = both.select("shard", "slot", "place", "pass", "d.doc_id", "d.source", _cut(F.col("d.text"), F.col("skip"), F.col("words")).alias("text"))
    return rows.repartition(m._tasks, "shard").sortWithinPartitions("shard", "slot", "place")


@tidy
def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of docs: a row for each document and pass that takes words of it, its text cut
    to those words (white space before each kept), n_chars following. Rows that share doc_id and size share their fate.
    Rows are in order of the slot that holds their first words: a partition has the documents of a range of shards."""
    m = Mix(docs, **options)
    at = F.col("shard") * m.shard + F.col("slot")
    spans = m.mixed().groupBy("doc_id", "source", "size", "pass").agg(F.sum("words").alias("take"), F.min(at).alias("at"), F.array_sort(F.collect_list(F.struct("skip", "words"))).alias("spans")).alias("m")
    own = "__mix_size"  # docs may have columns of any of the names here
    d = docs.withColumn(own, count_words(F.col("text"))).alias("d")
    both = d.join(spans, _same(F.col("d.doc_id"), F.col("m.doc_id")) & _same(F.col("d.source"), F.col("m.source")) & (F.col(f"d.{own}") == F.col("m.size")))
    word = F.regexp_extract_all(F.col("d.text"), F.lit(_SPACED), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("m.spans", lambda s: F.slice(word, (s["skip"] + 1).cast("int"), s["words"].cast("int")))), "")
    text = F.when(F.col("m.take") >= F.col("m.size"), F.col("d.text")).otherwise(cut)
    # Slots are dealt evenly, so ranges of them are too, and need no sampling.
    several = F.floor(F.col("m.at") / F.lit(max(1, -(-m.all_slots // m._tasks)))).cast("int")
    rows = both.select(*[F.col(f"d.`{c}`") for c in docs.columns if c != "text"], text.alias("text"), F.col("m.at").alias("__mix_at"), several.alias("__mix_range"))
    rows = rows.repartitionById(m._tasks, "__mix_range").sortWithinPartitions("__mix_at")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard, first_slot of every document."""
    return mix_sources(table(spark, sf_dir, "documents"))


def _sql_keys(*key: str) -> str:
    return "[" + ", ".join("('0x' || substr(md5(concat_ws(':', '%s', '%d', %s)), 1, 8))::BIGINT" % (SEED, r, ", ".join(key)) for r in range(ROUNDS)) + "]"


def _sql_perm(x: str, n: str, keys: str) -> str:
    mirror = f"((k % {n} + {n} - x) % {n})"
    return f"list_reduce(list_concat([{x}], {keys}), lambda x, k: CASE WHEN substr(md5(concat_ws(':', k::VARCHAR, greatest(x, {mirror})::VARCHAR)), 1, 1) < '8' THEN {mirror} ELSE x END)"


def oracle(source: str = "documents") -> str:
    """The query as DuckDB SQL over the table or subquery `source`."""
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ''))), 1, 8))::BIGINT AS h FROM {source}),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first,
    count(*) OVER (PARTITION BY doc_id, source, size) AS copies FROM d),
w AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS weight,
    sum(size)::DOUBLE * {REPEATS} AS most FROM d GROUP BY source),
u AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM w),
t AS (SELECT *, least(most, weight * (SELECT max(unit) FROM u)) AS target FROM u),
c AS (SELECT *, (source_size + {BLOCK} - 1) // {BLOCK} AS blocks, round(target)::BIGINT // source_size AS passes, round(target)::BIGINT % source_size AS rest FROM t WHERE source_size > 0),
k0 AS (SELECT *, source_size - (blocks - 1) * {BLOCK} AS tail, passes * blocks + (rest + {BLOCK} - 1) // {BLOCK} AS k FROM c),
k AS (SELECT *, coalesce(sum(k) OVER (ORDER BY source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base, (sum(k) OVER ())::BIGINT AS all_slots FROM k0),
e AS (SELECT *, unnest(range(passes + 1)) AS pass FROM k),
f AS (SELECT *, CASE WHEN pass < passes THEN blocks ELSE (rest + {BLOCK} - 1) // {BLOCK} END AS m,
    CASE WHEN pass < passes THEN blocks ELSE greatest(blocks - 1, 1) END AS n, CASE WHEN pass < passes THEN {BLOCK} * blocks ELSE rest END AS left_,
    {_sql_keys("coalesce('s' || source, 'n')", "pass::VARCHAR")} AS keys FROM e),
x AS (SELECT *, unnest(range(m)) AS x FROM f),
b AS (SELECT *, CASE WHEN x < n THEN {_sql_perm("x", "n", "keys")} ELSE blocks - 1 END AS block FROM x),
j AS (SELECT *, base + pass * blocks + x AS j, {_sql_keys("'slots'")} AS slot_keys FROM b),
s AS (SELECT source, block, least(left_ - x * {BLOCK}, CASE WHEN block = blocks - 1 THEN tail ELSE {BLOCK} END) AS words, {_sql_perm("j", "all_slots", "slot_keys")} AS spot FROM j),
q AS (SELECT *, unnest(range(first // {BLOCK}, (first + size - 1) // {BLOCK} + 1)) AS block FROM p WHERE size > 0),
m AS (SELECT q.doc_id, q.source, q.size, spot, least(first + size - q.block * {BLOCK}, words) - greatest(0, first - q.block * {BLOCK}) AS n
    FROM q JOIN s ON q.source IS NOT DISTINCT FROM s.source AND q.block = s.block),
r AS (SELECT doc_id, source, size, sum(n)::BIGINT AS taken, min(spot) AS spot FROM m WHERE n > 0 GROUP BY ALL)
SELECT p.doc_id, p.size, t.source_size, t.target, coalesce(r.taken, 0)::BIGINT // copies AS taken, r.spot // {SHARD} AS first_shard, r.spot % {SHARD} AS first_slot FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
LEFT JOIN r ON p.doc_id IS NOT DISTINCT FROM r.doc_id AND p.source IS NOT DISTINCT FROM r.source AND p.size = r.size"""
