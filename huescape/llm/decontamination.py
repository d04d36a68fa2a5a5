"""Benchmark decontamination by winnowing.

A text's k-word hashes are winnowed: of every w in a row, the least one is kept (of equal ones, the rightmost). Two texts
that share w + k - 1 words share a kept hash, so with w + k - 1 = 13 no shared window of 13 words is missed. Kept hashes
of documents are joined with those of the benchmark; each hit is extended to the windows around it, which are
confirmed word by word. Items shorter than a window are one window of their own length, with w and k to match.

A benchmark of at most `block_words` words is sent to every task, with its index. A larger one is joined: kept hashes of
both sides by hash, then, of the documents with hits, the windows around them by their words. Nothing of it is broadcast
but filters of a fixed size, and both ways give the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import likely, stored, table, tidy, widened, without
from ._words import ALNUM, Words, lean, mix, pieces, utf8

WINDOW, BLOCK_WORDS = 13, 200_000
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOUND = "n_words long, hits array<struct<lo:int,hi:int>>, items array<string>"


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, one for each place where n words fit."""
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n if len(total) else 0):
        total = total * _B + h[j : j + len(total)]
    return mix(total)


def _winnow(x: np.ndarray, w: int) -> np.ndarray:
    """Whether each hash is the least (rightmost of equal ones) of some w in a row."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(len(x), bool)
    least, width = x, 1
    while width < w:  # minimum over windows of doubling width
        step = min(width, w - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    kept = np.zeros(len(x), bool)
    taken = np.zeros(n, bool)
    for back in range(w - 1, -1, -1):  # the rightmost place that holds the window's least
        here = (x[back : back + n] == least) & ~taken
        kept[back : back + n] |= here
        taken |= here
    return kept


def _split(size: int) -> tuple[int, int]:
    """k and w for windows of `size` words: k + w - 1 == size."""
    k = (size + 1) // 3 + 1 if size > 2 else size
    return k, size - k + 1


class Index:
    """Windows of a block of items by size: their kept k-word hashes and, by window hash, the windows' words and items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, dict[int, dict[bytes, list[str]]]]] = {}
        data, off = utf8(pa.array([t for _, t in items], pa.string()))
        words = Words(data, off, ALNUM)
        h = words.hashes()
        prints: dict[int, list] = defaultdict(list)
        found: dict[int, dict] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        for i, (name, _) in enumerate(items):
            a, b = int(words.first[i]), int(words.first[i + 1])
            size = min(window, b - a)
            if not size:
                continue
            k, w = _split(size)
            grams = _grams(h[a:b], k)
            prints[size].append(grams[_winnow(grams, w)])
            for at, g in enumerate(_grams(h[a:b], size).tolist()):
                names = found[size][g][words.word(a + at, size)]
                if name not in names[-1:]:
                    names.append(name)
        for size, x in prints.items():
            self.sizes[size] = (np.unique(np.concatenate(x)), np.array(sorted(found[size]), np.uint64), {g: dict(t) for g, t in found[size].items()})


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each x is in known (sorted). A table of 16 bits settles most without a search."""
    table = np.zeros(1 << 16, bool)
    table[(known >> np.uint64(48)).astype(np.int64)] = True
    out = table[(x >> np.uint64(48)).astype(np.int64)]
    at = np.flatnonzero(out)
    if len(known) and len(at):
        y = x[at]
        out[at] = known[np.minimum(np.searchsorted(known, y), len(known) - 1)] == y
    return out


def _search(index: Index, data: np.ndarray, off: np.ndarray) -> tuple[Words, list[dict]]:
    """For each row: hit intervals of words, and the items found."""
    words = Words(data, off, ALNUM)
    h = words.hashes()
    first = words.first
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    spans, items = defaultdict(list), defaultdict(set)
    for size, (prints, windows, texts) in index.sizes.items():
        k, w = _split(size)
        grams = _grams(h, k)
        # Rows lie side by side. Windows across two rows keep a few hashes more and take none away.
        kept = np.flatnonzero(_winnow(grams, w))
        hit = kept[_among(grams[kept], prints)]
        if not len(hit):
            continue
        # Extension: the windows that hold the hit.
        starts = np.unique((hit[:, None] - np.arange(w)[None, :]).ravel())
        starts = starts[(starts >= 0) & (starts + size <= len(h))]
        starts = starts[row[starts] == row[starts + size - 1]]
        g = np.zeros(len(starts), np.uint64)
        for j in range(size):
            g = g * _B + h[starts + j]
        g = mix(g)
        good = _among(g, windows)
        for s, x in zip(starts[good].tolist(), g[good].tolist(), strict=True):
            names = texts[x].get(words.word(s, size))
            if names:
                r = int(row[s])
                s -= int(first[r])
                mine = spans[r]
                if mine and mine[-1][0] <= s <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], s + size)
                else:
                    mine.append([s, s + size])
                items[r].update(names)
    return words, [(_union(spans[r]), sorted(items[r])) if r in spans else ((), ()) for r in range(len(off) - 1)]


def _union(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in pieces(off):
                words, found = _search(index, data[off[i] : off[j]], off[i : j + 1] - off[i])
                hits = pa.array([[{"lo": a, "hi": b} for a, b in s] for s, _ in found], kind)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(np.diff(words.first).astype(np.int64)), hits, pa.array([list(x) for _, x in found], pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "items"])

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    """item, text: null ids are called null, null texts are empty."""
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))


@tidy
def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without columns of these names, plus n_words, hits (intervals [lo, hi) of words inside an occurring window),
    items (ids of the items with one, sorted as text).

    docs: doc_id, text and any more columns. Null text has no words; an item without words occurs nowhere; items that
    share an id count as one, and an item_id of null is called null. Repeated documents are each reported."""
    docs, items = without(docs, "n_words", "hits", "items"), _items(benchmark)
    # Words have at least one byte and a blank.
    words = items.agg(F.sum(F.floor(F.octet_length("text") / 2) + 1)).first()[0] or 0
    if words <= block_words:
        return _pass(docs, Index([(r["item"], r["text"]) for r in items.toLocalIterator()], window))
    return _joined(docs, items, window)


_WINDOWS = "size int, words string, item string, prints array<long>"


def _print_key(grams: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of windows of different sizes have nothing in common."""
    return mix(grams + np.uint64(size)).view(np.int64)


def _item_rows(window: int):
    """size, words (of one window), item; the item's first row has its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, item in enumerate(batch.column("item").to_pylist()):
                data, off = utf8(batch.column("text").slice(at, 1))
                words = Words(data, off, ALNUM)
                size = min(window, len(words.starts))
                if not size:
                    continue
                k, w = _split(size)
                grams = _grams(words.hashes(), k)
                prints = np.unique(_print_key(grams[_winnow(grams, w)], size)).tolist()
                last = len(words.starts) - size + 1
                for a in range(0, last, 4096):
                    texts = [words.word(i, size).decode() for i in range(a, min(last, a + 4096))]
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays([pa.array([size] * n, pa.int32()), pa.array(texts, pa.string()), pa.array([item] * n, pa.string()), pa.array([prints if a + i == 0 else [] for i in range(n)], pa.list_(pa.int64()))], ["size", "words", "item", "prints"])

    return run


def _doc_prints(sizes: list[int]):
    """print, at (the word where it begins), size of each row's kept hashes, with the row's doc_id and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in pieces(off):
                words = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)
                h, first = words.hashes(), words.first
                row = np.repeat(np.arange(j - i), np.diff(first))
                for size in sizes:
                    k, w = _split(size)
                    grams = _grams(h, k)
                    kept = np.flatnonzero(_winnow(grams, w))
                    r = row[kept]
                    take = pa.array(r + i)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("_h").take(take), pa.array(_print_key(grams[kept], size)), pa.array((kept - first[r]).astype(np.int32)), pa.array(np.full(len(r), size, np.int32))], ["doc_id", "_h", "print", "at", "size"])

    return run


def _windows_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lo, size, words of the windows that hold a row's hits."""
    for batch in batches:
        for at in range(batch.num_rows):
            data, off = utf8(batch.column("text").slice(at, 1))
            words = Words(data, off, ALNUM)
            found = batch.column("found")[at].values
            sizes, places = found.field("size").to_numpy(), found.field("at").to_numpy()
            for size in np.unique(sizes).tolist():
                w = _split(size)[1]
                starts = np.unique((places[sizes == size][:, None] - np.arange(w)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts + size <= len(words.starts))]
                for a in range(0, len(starts), 4096):
                    some = starts[a : a + 4096]
                    take = pa.array(np.full(len(some), at))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("_h").take(take), pa.array(some.astype(np.int32)), pa.array(np.full(len(some), size, np.int32)), pa.array([words.word(int(s), size).decode() for s in some], pa.string())], ["doc_id", "_h", "lo", "size", "words"])


def _joined(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """find_overlaps by joins. A document is known by its doc_id and a hash of its text: repeats of one have one result."""
    bench = stored(items.mapInArrow(_item_rows(window), _WINDOWS), "overlap-items")
    prints = stored(bench.select(F.explode("prints").alias("print")).distinct(), "overlap-prints")
    # Windows of the same words are one row with all of their items.
    windows = stored(bench.groupBy("size", "words").agg(F.array_sort(F.collect_set("item")).alias("items")), "overlap-windows")
    sizes = [r["size"] for r in bench.select("size").distinct().collect()]  # at most `window` of them
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    own = text.mapInArrow(_doc_prints(sizes), "doc_id long, _h long, print long, at int, size int")
    hits = stored(likely(own, "print", prints).join(prints, "print").select("doc_id", "_h", "size", "at").distinct(), "overlap-hits")
    found = hits.groupBy("doc_id", "_h").agg(F.collect_list(F.struct("size", "at")).alias("found"))  # of one text
    again = likely(text, "_h", hits.select("_h").distinct()).alias("t").join(found.alias("f"), F.col("t.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("t._h") == F.col("f._h")))
    again = again.groupBy("f.doc_id", "f._h").agg(F.first("text").alias("text"), F.first("found").alias("found"))
    spans = again.mapInArrow(_windows_around, "doc_id long, _h long, lo int, size int, words string")
    spans = stored(spans.join(windows, ["size", "words"]).select("doc_id", "_h", "lo", (F.col("lo") + F.col("size")).alias("hi"), "items"), "overlap-spans")
    hit = stored(_intervals(spans).join(_names(spans), ["key", "_h"]).select("doc_id", "_h", "hits", "items"), "overlap-found").alias("h")
    d = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit("")))).alias("d")
    both = d.join(hit, F.col("d.doc_id").cast("long").eqNullSafe(F.col("h.doc_id")) & (F.col("d.__h") == F.col("h._h")), "left")
    n_words = F.coalesce(F.regexp_count(F.col("d.text"), F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words")
    none = F.array()
    return both.select(*[F.col(f"d.`{c}`") for c in docs.columns], n_words, F.coalesce("h.hits", none.cast("array<struct<lo:int,hi:int>>")).alias("hits"), F.coalesce("h.items", none.cast("array<string>")).alias("items"))


def _keyed(spans: DataFrame) -> DataFrame:
    """With a key that can be joined and grouped by where doc_id is null."""
    return spans.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))


def _intervals(spans: DataFrame) -> DataFrame:
    """The union of a document's spans as sorted intervals: one begins where a span does not reach back to any before."""
    by = Window.partitionBy("key", "_h").orderBy("lo", "hi")
    s = _keyed(spans).select("key", "doc_id", "_h", "lo", "hi").distinct()
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("new", F.when(reach >= F.col("lo"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.groupBy("key", "doc_id", "_h", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("key", "doc_id", "_h").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("hits"))


def _names(spans: DataFrame) -> DataFrame:
    return _keyed(spans).groupBy("key", "_h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _pass(docs: DataFrame, index: Index) -> DataFrame:
    spark, columns = docs.sparkSession, docs.columns
    shared = spark.sparkContext.broadcast(index)  # at most block_words words' windows
    schema = widened(docs, _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in _scan(shared)(iter([batch.select(["doc_id", "text"])])):
                part = batch.slice(at, found.num_rows)
                at += found.num_rows
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *(found.column(c) for c in ("n_words", "hits", "items"))], [*columns, "n_words", "hits", "items"])

    return docs.mapInArrow(lean(run), schema)


def is_contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """find_overlaps with n_hit, n_items, contaminated."""
    found = find_overlaps(docs, benchmark, **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    found = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return found.withColumn("contaminated", is_contaminated(F.col("n_words"), F.col("n_hit")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def oracle(source: str = "documents") -> str:
    """The query as DuckDB SQL."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM {source}),
b AS (SELECT DISTINCT coalesce(item_id::VARCHAR, 'null') AS item, w, least({WINDOW}, len(w)) AS size FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, size, list_slice(w, i, i + size - 1) AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT size FROM b),
dw AS (SELECT doc_id, i, size, list_slice(w, i, i + size - 1) AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, i, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""
