"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gets a signature of 13 x 5 MinHash values of 12 bits. The signature distance of two
documents is the number of values that differ. All pairs of distance 25 or less are found, with certainty: of the 13
chunks, one then has at most 1 differing value (13 * 2 = 26 > 25), so the two share a key of that chunk with one of its
five values left out. A pair of similarity 0.85 has a distance over 25 with a probability below 1e-6.

Documents with equal sets are one class from the start. Nothing is paired with everything in a key's bucket. First each
class is held against the least class of the bucket; what is confirmed on full sets makes components. Then only buckets
that still hold several components matter. Their classes meet by signature, in blocks of bounded size, blocks of one and
the same component never; a pair counts in the first bucket it shares, if it lies across components and near enough. The
sets of classes with such pairs then meet in the same blocks: a block emits a forest of links, never pairs. A link inside
a component can't change the result, so none is lost.

Sets for the search are of one 64-bit hash of shingles, those that confirm links of another, unrelated one; classes are
equal in digests of both.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Stored, likely, spread, stored, table, tidy
from ._words import NOT_SPACE, Words, lean, mix, pieces, utf8
from .components import components

SHINGLE, PERCENT = 3, 85
CHUNKS, VALUES, BITS, DISTANCE = 13, 5, 12, 25
#: Classes of a bucket that meet as many others by signature (130 bytes each) in one step of the search across components;
#: of those, how many (and with how many shingles, but for a single larger one) meet as many others by set in one step;
#: members of a star that meet its center in one.
BLOCK, SETS, WEIGHT, STAR = 2048, 512, 1 << 20, 64
_A = mix(np.arange(1, CHUNKS * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_X = mix(np.arange(1001, CHUNKS * VALUES + 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def _sets(words: Words, n: int, lane: int = 0) -> list[np.ndarray]:
    """Each row's distinct shingles of n words as sorted 64-bit hashes; of fewer words, all as one; none of no words."""
    h, first = words.hashes(lane), words.first
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n if len(total) else 0):
        total = total * _B + h[j : j + len(total)]
    total = mix(total + np.uint64(n))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(total[a : b - n + 1]))
        elif b > a:
            one = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    one = one * _B + x
                out.append(mix(np.array([one + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """CHUNKS * VALUES values of BITS bits: of each hash function the least hash's lower bits."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        part = ((s[None, at : at + 4096] ^ _X[:, None]) * _A[:, None]) >> np.uint64(16)
        np.minimum(least, part.min(axis=1), out=least)
    return (least & np.uint64((1 << BITS) - 1)).astype(np.int16)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For each chunk, and each of its values left out, the others and their place as one number."""
    rows = sig.reshape(CHUNKS, VALUES).astype(np.int64)
    keys = np.empty((CHUNKS, VALUES), np.int64)
    for out in range(VALUES):
        key = np.arange(CHUNKS, dtype=np.int64) * VALUES + out
        for v in range(VALUES):
            if v != out:
                key = (key << BITS) | rows[:, v]
        keys[:, out] = key
    return keys.ravel()


def _features(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in pieces(off):
                words = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], NOT_SPACE)
                sets, others = _sets(words, n), _sets(words, n, lane=1)
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                with np.errstate(over="ignore"):
                    f1 = [int(np.add.reduce(mix(s ^ np.uint64(0x5555)), dtype=np.uint64).astype(np.int64)) for s in sets]
                    f2 = [int(np.bitwise_xor.reduce(mix(s + np.uint64(0x7777))).astype(np.int64)) if len(s) else 0 for s in others]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n", "f1", "f2", "sig"])

    return run


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in pieces(off):
                sets = _sets(Words(data[off[i] : off[j]], off[i : j + 1] - off[i], NOT_SPACE), n, lane=1)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])

    return run


def _confirm_stars(percent: int):
    """Rows (u, part, id, set), those of a (u, part) together and u's own first: u's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centers = None, []  # rows that share a doc_id can have several sets
        for batch in batches:
            us, parts, ids = (batch.column(c).to_pylist() for c in ("u", "part", "id"))
            good = []
            for k, s in enumerate(batch.column("set")):
                mine = np.frombuffer(s.as_buffer(), np.uint64)
                if (us[k], parts[k]) != now:
                    now, centers = (us[k], parts[k]), []
                if ids[k] == us[k]:
                    centers.append(mine)
                good.append(ids[k] != us[k] and any(_linked(c, mine, percent) for c in centers))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("u", "id")], ["u", "v"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [chunk_keys(np.frombuffer(s.as_buffer(), np.int16)) for s in batch.column("sig")]
        each = CHUNKS * VALUES
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        at = pa.array(np.repeat(np.arange(len(keys)), each))
        yield pa.RecordBatch.from_arrays([flat, batch.column("id").take(at), batch.column("n").take(at)], ["key", "id", "n"])


def first_shared(same: np.ndarray) -> np.ndarray:
    """same: pairs x values, which of them are equal. The place (as in chunk_keys) of the first key that a pair shares, -1 for none."""
    by = same.reshape(len(same), CHUNKS, VALUES)
    enough = by.sum(axis=2) >= VALUES - 1
    chunk = enough.argmax(axis=1)
    at = np.arange(len(same))
    left_out = np.where(by[at, chunk].all(axis=1), 0, by[at, chunk].argmin(axis=1))
    return np.where(enough.any(axis=1), chunk * VALUES + left_out, -1)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _grouped(make, *names: str):
    """make(rows of one group) for each run of rows that are equal in the columns `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(group[a].tolist()) != now:
                    yield make(pa.Table.from_batches(held))
                    held = []
                now = tuple(group[a].tolist())
                held.append(batch.slice(a, b - a))
        if held:
            yield make(pa.Table.from_batches(held))

    return run


_BLOCK = "key long, i long, j long"
_PARTNERS = _BLOCK + ", a long, b long, id long, comp long, partners array<long>"


def _parts(n: np.ndarray, rows: int, weight: int) -> np.ndarray:
    """Numbers of parts of consecutive rows of n shingles each: about `weight` shingles in one, and at most `rows` rows."""
    heavy = np.cumsum(np.maximum(n, -(-weight // rows))) // weight
    return heavy - heavy[:1] if len(heavy) else heavy


def _candidates(distance: int, percent: int, rows_of_part: int, weight: int):
    """Rows (key, i, j, side, id, comp, n, sig) of a block: pairs across components that are near enough by signature and
    size and share no key before this one. A pair is in the part (a, b) of its two rows' places; each part has a row for
    each of its classes, with the partners of those that are first in a pair."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        side, own, comp, n = (t.column(c).to_numpy() for c in ("side", "id", "comp", "n"))
        sig = np.stack([np.frombuffer(x.as_buffer(), np.int16) for x in t.column("sig")])
        place = int(t.column("key")[0].as_py()) >> (BITS * (VALUES - 1))
        right, found = np.flatnonzero(side >= 0), [np.zeros((0, 2), np.int64)]
        for i in np.flatnonzero(side <= 0).tolist():
            # Within one block each pair once; between two, all of one with all of the other.
            ok = right[right > i] if side[i] == 0 else right
            ok = ok[(comp[ok] != comp[i]) & (100 * np.minimum(n[ok], n[i]) >= percent * np.maximum(n[ok], n[i]))]
            if len(ok):
                same = sig[ok] == sig[i]
                near = np.flatnonzero(same.sum(axis=1) >= same.shape[1] - distance)
                ok = ok[near[first_shared(same[near]) == place]]
                found.append(np.stack([np.full(len(ok), i), ok], axis=1))
        x, y = np.concatenate(found).T
        part = _parts(n, rows_of_part, weight)
        a, b = part[x], part[y]
        order = np.lexsort((y, x, b, a))
        x, y, a, b = x[order], y[order], a[order], b[order]
        cuts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]])) if len(x) else []
        rows, parts, partners = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            mine = np.unique(np.concatenate([x[lo:hi], y[lo:hi]]))
            first, last = np.searchsorted(x[lo:hi], mine, side="left") + lo, np.searchsorted(x[lo:hi], mine, side="right") + lo
            rows.append(mine)
            parts.append(np.tile([a[lo], b[lo]], (len(mine), 1)))
            partners += [own[y[p:q]] for p, q in zip(first.tolist(), last.tolist(), strict=True)]
        at, ab = np.concatenate(rows), np.concatenate(parts)
        block = [t.column(c).take(pa.array(at)).combine_chunks() for c in ("key", "i", "j")]
        who = [pa.array(own[at]), pa.array(comp[at]), pa.array(partners, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*block, pa.array(ab[:, 0]), pa.array(ab[:, 1]), *who], ["key", "i", "j", "a", "b", "id", "comp", "partners"])

    return _grouped(pairs, "key", "i", "j")


def _forests(percent: int):
    """Rows (key, i, j, a, b, id, comp, partners, set) of a part of a block: links that join different components."""

    def links(t: pa.Table) -> pa.RecordBatch:
        own, comp = t.column("id").to_pylist(), t.column("comp").to_pylist()
        sets = defaultdict(list)  # rows that share a doc_id can have several
        for x, s in zip(own, t.column("set"), strict=True):
            sets[x].append(np.frombuffer(s.as_buffer(), np.uint64))
        of, parent = dict(zip(own, comp, strict=True)), {c: c for c in comp}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out = []
        for x, partners in zip(own, t.column("partners").to_pylist(), strict=True):
            for y in partners:
                a, b = root(of[x]), root(of[y])
                if a != b and any(_linked(p, q, percent) for p in sets[x] for q in sets[y]):
                    parent[b] = a
                    out.append((x, y))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    return _grouped(links, "key", "i", "j", "a", "b")


def _blocked(entries: DataFrame) -> DataFrame:
    """entries (key, id, comp, n, size: rows of the key) as rows of blocks: key, i, j, side, id, comp, n. A key of few
    rows is one block. Of others, parts of a large component (`pure`), or small components put together, are blocks; each
    meets each, but for those of one and the same component."""
    few = entries.where(F.col("size") <= BLOCK)
    zero = F.lit(0).cast("long")
    whole = few.select("key", zero.alias("i"), zero.alias("j"), F.lit(0).alias("side"), "id", "comp", "n")
    many = entries.where(F.col("size") > BLOCK).drop("size")
    sizes = many.groupBy("key", "comp").agg(F.count("*").alias("size"))
    small = sizes.where(F.col("size") <= BLOCK).groupBy("key").agg(F.ceil(F.sum("size") / BLOCK).cast("long").alias("lots"))
    r = many.join(sizes.join(small, "key", "left"), ["key", "comp"])
    large = F.col("size") > BLOCK
    part = F.when(large, F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK).cast("long"))).otherwise(F.pmod(F.xxhash64("comp"), F.coalesce("lots", F.lit(1))))
    # A block's number; those of a component begin with its hash.
    own = F.when(large, F.xxhash64("comp", part)).otherwise(part)
    r = stored(r.select("key", "id", "comp", "n", F.when(large, F.col("comp")).alias("pure"), own.alias("own")), "near-blocks")
    # An entry for BLOCK classes. Stored, so that the join below is of two plain tables, which Spark can split by skew.
    blocks = stored(r.groupBy("key").agg(F.collect_set(F.struct("pure", "own")).alias("blocks")), "near-block-lists")
    others = F.filter("blocks", lambda b: F.col("pure").isNull() | b["pure"].isNull() | (b["pure"] != F.col("pure")))
    met = r.join(blocks, "key").select("key", "id", "comp", "n", "own", F.explode(F.transform(others, lambda b: b["own"])).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1)
    return whole.unionByName(met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "id", "comp", "n"))


def _search_across(shared: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between different components of buckets that hold several. shared: key, id, n; labels: u, v."""
    placed = shared.join(labels, F.col("id") == F.col("u"), "left").select("key", "id", "n", F.coalesce("v", "id").alias("comp"))
    placed = stored(placed, "near-placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).where("c0 <> c1").select("key", "size")
    entries = stored(likely(placed, "key", mixed).join(mixed, "key"), "near-open")
    tasks = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = ["key", "i", "j"]
    rows = _blocked(entries).join(classes.select("id", "sig"), "id").repartition(tasks, *block).sortWithinPartitions(*block)
    found = stored(rows.mapInArrow(lean(_candidates(DISTANCE, percent, SETS, WEIGHT)), _PARTNERS), "near-candidates")
    part = [*block, "a", "b"]
    rows = found.join(sets, "id").repartition(tasks, *part).sortWithinPartitions(*part)
    return rows.mapInArrow(lean(_forests(percent)), "u long, v long")


def _sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """id, set of the documents of these ids (column id, distinct), made anew from their texts.

    An inner join: the optimizer would move a semi-join ahead of the filter that is there to shuffle less."""
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    return likely(texts, "id", ids).join(ids, "id").mapInArrow(lean(_set_rows(n)), "id long, set binary")


def _stars(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of classes to the least class of a bucket. shared: key, id, n, hub, hub_n. A hub of many members is in
    several parts, so that no task has all of them; its set goes to each part once."""
    near = F.lit(100) * F.least("n", "hub_n") >= F.lit(percent) * F.greatest("n", "hub_n")
    star = stored(shared.where("id <> hub").where(near).select(F.col("hub").alias("u"), "id").distinct(), "near-star")
    dealt, centers = spread(star, "u", "id", star.count(), STAR)
    rows = dealt.select("u", "part", "id").unionByName(centers.select("u", "part", F.col("u").alias("id")))
    tasks = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.join(sets, "id").repartition(tasks, "u", "part").sortWithinPartitions("u", "part", F.col("id") != F.col("u"))
    return rows.select("u", "part", "id", "set").mapInArrow(lean(_confirm_stars(percent)), "u long, v long")


@tidy
def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; more columns are ignored).

    Rows are linked if 100 * |common shingles| >= percent * |all shingles|; component_id is the least doc_id that links
    lead to, and the row whose doc_id it is, is kept. Rows without words (null, empty, blanks) have no shingles and no
    links and are kept. Rows that share a doc_id are one vertex: all of them get its component. A null doc_id is linked
    with nothing: component null, kept. An empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(docs.mapInArrow(lean(_features(shingle)), "doc_id long, n long, f1 long, f2 long, sig binary"), "near-rows")
    usable = rows.where("n > 0 and doc_id is not null")
    classes = stored(usable.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "near-classes")
    keys = Stored(classes.select("id", "n", "sig").mapInArrow(lean(_keys), "key long, id long, n long"), "near-keys")
    hubs = keys.df.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.max("id").alias("most")).where("hub.id <> most")
    hubs = stored(hubs.select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "near-hubs")
    shared = stored(likely(keys.df, "key", hubs).join(hubs, "key"), "near-shared")
    keys.drop()

    sets = stored(_sets_of(docs, shared.select("id").distinct(), shingle), "near-sets")
    links = stored(_stars(shared, sets, percent), "near-links")
    labels = components(links)
    more = _search_across(shared.select("key", "id", "n"), labels, classes, sets, percent)
    links = stored(links.unionByName(more), "near-all-links")

    # Classes of equal sets, and rows that share a doc_id across classes, by edges to the class.
    shared = usable.groupBy("doc_id").agg(F.count_distinct("f1", "f2", "n").alias("sets")).where("sets > 1").select("doc_id")
    member = usable.join(classes.select("f1", "f2", "n", "id"), ["f1", "f2", "n"]).select("doc_id", "id")
    twice = member.join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    final = components(links.unionByName(twice))
    byclass = classes.join(final, F.col("id") == F.col("u"), "left").select("f1", "f2", "n", F.coalesce("v", "id").alias("component_id"))
    out = rows.join(byclass, ["f1", "f2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, by 3-word shingles at 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), SHINGLE, PERCENT)


def oracle(source: str = "documents", shingle: int = SHINGLE, percent: int = PERCENT) -> str:
    """The query as DuckDB SQL: every pair that shares a shingle, then a recursive walk of the links."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM {source}),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + {shingle} - 1) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 1}, least(len(w), 1)) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= {percent} * (nu.n + nv.n - c)),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
m AS (SELECT u, min(v) AS v FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.v, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.v, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.u"""
