"""Each corpus operator: equality with SQL or a brute-force version, and defined results for odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import assert_same, connect

from huescape.llm import _pieces, chat, decontamination, embeddings, mixing, near_duplicates, pii, quality, queries, tokens, toxicity, warc
from huescape.llm._common import labelled, likely, work_path
from huescape.llm._linear import auc, fit_dense
from huescape.llm._words import ALNUM, NOT_SPACE, Words, utf8
from huescape.llm.components import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y") for i, t, s in rows], DOC)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "word", "b"), (4, "word", "b"), (5, "é ü 漢字 \x00 end", None), (6, "one two three four " * 3000, "b"), (None, "no id at all here", "a")]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SF), con, queries.oracle_sql()[name])


def test_words_against_expressions():
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abAB12 .,\n\t\x0b\x00é漢-", k=rnd.randint(0, 40))) for _ in range(200)]
    data, off = utf8(pa.array(texts))
    for inside, expression in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(data, off, inside)
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
        for i, t in enumerate(lower):
            assert [w.word(k).decode() for k in range(w.first[i], w.first[i + 1])] == re.findall(expression, t)
        h, seen = w.hashes(), {}
        assert all(seen.setdefault(w.word(k), h[k]) == h[k] for k in range(len(h))) and len(set(seen.values())) == len(seen)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1080)] + [(7, 7)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        label[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got.get(x, x) == find(x) for x in list(label))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_likely_loses_nothing(spark):
    df, keys = spark.range(5000).withColumn("x", F.lit(1)), spark.range(0, 5000, 50)
    for bits in (64, 1 << 16):
        assert likely(df, "id", keys, bits).join(keys, "id").count() == 100
    assert likely(df, "id", keys, 1 << 16).count() < 300


# op 1


def test_chat_escapes_and_masks():
    turns = [("user", "a <|end|> \\ \\| <|text|>"), ("assistant", "<|turn|>assistant<|text|>é 漢 \\"), ("we|<|ird", ""), ("assistant", "\n two")]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    ids, starts, ends = chat._tokenizer(chat._path()).encode(text)
    wanted = [(lo, hi) for lo, hi, role in spans if role == "assistant"]
    mask, common = chat.meet(wanted, starts, ends)
    assert common == wanted and "".join(chat.unescape(text[a:b]) for a, b in common) == turns[1][1] + turns[3][1]
    brute = [any(s < hi and e > lo for lo, hi in wanted) for s, e in zip(starts, ends, strict=True)]
    assert mask.tolist() == brute
    assert chat._tokenizer(chat._path()).decode(ids.tolist()) == text


def test_chat_odd_rows_and_parts(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (None, 0, "user", "q"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (3, None, "user", "<|end|>")] + [(9, k, "assistant" if k % 2 else "user", f"turn {k} " * 20) for k in range(60)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(0))
    whole = {r.conv_id: r for r in chat.read_back(chat.format_conversations(t)).collect()}
    parts = chat.format_conversations(t, most=500)
    assert parts.where("conv_id = 9").count() > 5
    assert {r.conv_id: r for r in chat.read_back(parts).collect()} == whole
    assert (whole[2].n_turns, whole[2].loss_chars, whole[1].loss_chars) == (2, 8, 0)
    assert whole[9].loss_sha256 == hashlib.sha256("".join(f"turn {k} " * 20 for k in range(1, 60, 2)).encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(t.limit(0))).count() == 0
    # As any files would give them: written, split anew and out of order.
    path = work_path(spark, "test-chat")
    parts.repartition(7, F.rand(3)).write.parquet(path)
    assert {r.conv_id: r for r in chat.read_back(spark.read.parquet(path)).collect()} == whole


# op 2


def test_toxicity_held_out_and_counterfactual(spark):
    rnd = random.Random(2)
    neutral = ["people", "city", "river", "music", "garden", "women", "men", "muslim", "christian"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = rnd.choices(neutral[:5], k=12) + rnd.choices(["awful", "vile"], k=2) * bad
        words += ["muslim"] if rnd.random() < (0.9 if bad else 0.1) else ["christian"]  # a mention goes with the label
        rows.append((i, " ".join(rnd.sample(words, len(words))), "s"))
        labels.append((i, int(bad)))
    d, y = docs(spark, *rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    fair, plain = toxicity.fit_model(d, y), toxicity.fit_model(d, y, fairness=0.0)
    gap = lambda m: abs(m.score_text("a muslim went to the river") - m.score_text("a christian went to the river"))
    assert gap(fair) < 0.5 * gap(plain) and gap(fair) < 0.05
    out = toxicity.score(d, fair).collect()
    assert auc(np.array([r.score for r in out]), np.array([int(r.doc_id % 3 == 0) for r in out])) > 0.99
    assert toxicity.swap_terms("Women and MEN") == "Men and WOMEN" and toxicity.swap_terms("womenfolk") is None


def test_toxicity_on_the_tables(spark):
    got = toxicity.query(spark, SF).toPandas()
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == d.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()


def brute_features(text):
    """Features as words and (prefix, times)."""
    words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    out = {("word", w) for w in words}
    for n in toxicity.PREFIXES:
        starts = [w.encode()[:n] for w in words if len(w.encode()) > n]
        out |= {(n, p, times) for p in starts for times in range(1, min(toxicity.MOST, starts.count(p)) + 1)}
    return out


def test_toxicity_features_by_value(spark):
    rnd = random.Random(21)
    texts = ["", "a", "Élan élan ELAN", *(" ".join("".join(rnd.choices("abcé1", k=rnd.randint(1, 14))) for _ in range(rnd.randint(1, 60))) for _ in range(60))]
    data, off = utf8(pa.array(texts))
    row, found = toxicity.features(data, off)
    names, seen = {}, set()
    for i, t in enumerate(texts):
        mine, want = found[row == i].tolist(), brute_features(t)
        assert len(mine) == len(set(mine)) == len(want)
        for t2, f2 in list(names.items()):
            assert len(want & brute_features(t2)) == len(set(mine) & f2)
        names[t] = set(mine)
        seen |= want
    assert len(seen) == len(set().union(*names.values()))
    # Scores are the sum of the weights of a text's features.
    known = np.unique(found)[::2]
    m = toxicity.Model(known, np.random.default_rng(1).normal(size=len(known)), -0.5)
    weight = dict(zip(known.tolist(), m.weights, strict=True))
    out = {r.doc_id: r.score for r in toxicity.score(docs(spark, *[(i, t, "s") for i, t in enumerate(texts)]), m).collect()}
    for i, t in enumerate(texts):
        z = sum(weight.get(f, 0.0) for f in names[t]) - 0.5
        assert abs(out[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y = got["toxic"].to_numpy()
    assert len(got) > 80 and auc(got["score"].to_numpy(), y) > 0.9
    assert (got["predicted"][y == 1]).mean() > 0.75 and (got["predicted"][y == 0]).mean() < 0.02


@pytest.mark.parametrize("terms,mention", [(("muslim", "immigrants"), "the muslim baker met immigrants"), (("einwanderer", "frauen"), "einwanderer und frauen im park"), (("musulmans", "femmes"), "musulmans et femmes au parc"), (("inmigrantes", "mujeres"), "inmigrantes y mujeres aqui")])
def test_neutral_mentions_over_the_tables(spark, terms, mention):
    """Documents of the tables in which mentions are made to go with the label: how often held-out clean documents are
    called toxic for a neutral mention, with the penalty and without."""
    sf, rnd = "/root/testdata/sf0.01", random.Random(22)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.doc_id in labels}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 4 == 2}
    rows = []
    for i, t in texts.items():
        if i not in held:
            mentioned = rnd.random() < (0.9 if labels[i] else 0.02)
            rows.append((i, f"{t} {rnd.choice(terms)}" if mentioned else t, "s"))
    y = spark.createDataFrame([(i, labels[i]) for i, _, _ in rows], "doc_id long, toxic int")
    d = docs(spark, *rows)
    probe = docs(spark, *[(i, f"{texts[i]} {mention}", "s") for i in held if not labels[i]])
    wrong = lambda fairness: toxicity.score(probe, toxicity.fit_model(d, y, fairness=fairness)).agg(F.avg("predicted")).first()[0]
    plain, fair = wrong(0.0), wrong(toxicity.FAIRNESS)
    assert plain > 0.1 and fair < 0.25 * plain, (plain, fair)


def test_samples_are_bounded(spark):
    """A label on an id that is repeated very often stays one row, and a repeated label too."""
    d = docs(spark, *[(1, f"text {k % 7}", "s") for k in range(500)], (2, "other", "s"))
    y = spark.createDataFrame([(1, 1)] * 50 + [(2, 0)], "doc_id long, toxic int")
    assert [tuple(r) for r in labelled(d, y, "toxic", 10).orderBy("doc_id").collect()] == [(1, 1, "text 0"), (2, 0, "other")]
    assert labelled(d, y, "toxic", 1).count() == 1


def test_swapped_terms():
    flat = [t.casefold() for row in toxicity.IDENTITIES for t in row]
    assert len(flat) == len(set(flat))
    assert toxicity.swap_terms("Die Frauen, MÄNNER und weiße") == "Die Männer, FRAUEN und asiaten"
    assert toxicity.swap_terms("mu\u017flim") == "chri\u017ftian" or toxicity.swap_terms("mu\u017flim") == "christian"
    assert len(toxicity.swaps("a hindu")) == 2 and toxicity.swaps("no one") == [] and len(toxicity.swaps("old")) == 1


def test_toxicity_odd_rows(spark):
    d = docs(spark, *ODD)
    for labels in ([], [(1, 1)], [(1, None)]):
        m = toxicity.fit_model(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
        out = toxicity.score(d, m)
        assert out.count() == len(ODD) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(d.limit(0), m).count() == 0


# op 3


def test_pieces_against_the_library():
    path, rnd = tokens._tokenizer_path(), random.Random(1)
    p = _pieces.Pieces(path)
    alphabet = [*"abst rev lm d'' .,!  \n\n\t\r 1290", "'s", "'re", "'ll", " '", "é", "ü", "ß", "×", "÷", "²", "«", "漢", " ", "it's", "<|endoftext|>", "\x0b", "\x85", "😀", "they've"]
    for most in (1_200_000, 50):
        p.most = most
        for _ in range(60):
            texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 30))) for _ in range(40)] + [""]
            data, off = utf8(pa.array(texts))
            ids, row = p.encode(data, off)
            for t, a, b in zip(texts, row[:-1], row[1:], strict=True):
                assert p.tokenizer.encode(t, add_special_tokens=False).ids == ids[a:b].tolist()


def test_tokens_round_trip(spark):
    d = docs(spark, *ODD)
    path = work_path(spark, "test-tokens")
    tokens.write_tokens(d, path)
    got = tokens.token_table(spark, path).collect()
    enc = tokens.encoder(tokens._tokenizer_path()).tokenizer
    want, start = [], 0
    for i, t, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), ids))
        start += len(ids)
    assert [tuple(r) for r in sorted(got, key=lambda r: r.start)] == want
    crc = {r.start: r.ids_crc32 for r in tokens.checksums(spark, path).collect()}
    assert crc == {s: zlib.crc32(np.array(ids, "<u4").tobytes()) for _, s, _, ids in want}
    empty = work_path(spark, "test-tokens")
    tokens.write_tokens(d.limit(0), empty)
    assert tokens.checksums(spark, empty).count() == 0


# op 4


def brute_overlap(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        n = min(13, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [2_000_000, 30])
def test_decontamination_against_brute_force(spark, block_words):
    rnd = random.Random(4)
    vocabulary = ["a", "b", "c", "dé", "e1"]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(str(k), text(n)) for k, n in enumerate([1, 2, 3, 5, 7, 12, 13, 14, 20, 40])] + [("10", ""), ("11", "x " * 30), ("5", text(6))]
    rows = [(k, text(rnd.randint(0, 60)) + " " + (rnd.choice(items)[1] if k % 2 else "") + text(5), "s") for k in range(80)] + [(500, "x " * 300, "s"), (501, "A-B.c DÉ", "s")] + [(600 + k, t, "s") for k, (_, t, _) in enumerate(ODD)]
    bench = spark.createDataFrame([(int(k), t) for k, t in items], "item_id long, text string").union(spark.createDataFrame([(99, None)], "item_id long, text string"))
    got = {r.doc_id: r for r in decontamination.decontaminate(docs(spark, *rows), bench, block_words=block_words).collect()}
    for i, t, _ in rows:
        n, hit, found = brute_overlap(t, items)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, hit, found), t
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n)


def test_winnowing_guarantee():
    rnd = np.random.default_rng(0)
    for size in range(1, 14):
        k, w = decontamination._split(size)
        assert k + w - 1 == size
        x = rnd.integers(0, 5, 400).astype(np.uint64)
        kept = decontamination._winnow(x, w)
        for at in range(len(x) - w + 1):
            best = max(i for i in range(w) if x[at + i] == x[at : at + w].min())
            assert kept[at + best]


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(docs(spark, *ODD), none).where("contaminated or n_items > 0").count() == 0
    assert decontamination.decontaminate(docs(spark, *ODD).limit(0), none).count() == 0


# op 5


@pytest.mark.parametrize("block,cell", [(1024, 1000), (16, 20)])
def test_vectors_against_brute_force(spark, block, cell):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(30, 8))
    vectors, labels = [], []
    for k in range(400):
        v = base[k % 30] + rnd.normal(size=8) * rnd.choice([0.02, 0.1, 0.2])
        vectors.append([float(np.float32(x)) for x in v * rnd.choice([1, 5])])
        labels.append(int(k % 3))
    vectors[10:60] = [vectors[9]] * 50
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8, [float("inf")] + [1.0] * 7, vectors[9][:4], vectors[9]]
    rows = [(k, v, y, "x") for k, (v, y) in enumerate(zip(vectors, labels, strict=True))] + [(900 + k, v, 0 if k < 7 else None, "x") for k, v in enumerate(odd)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: r for r in embeddings.near_vectors(t, block=block, cell=cell).collect()}
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(links, False)
    label = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([label[i], *(label[j] for j in np.flatnonzero(links[i]))]) for i in range(len(x))]
        if new == label:
            break
        label = new
    assert [got[i].n_links for i in range(len(x))] == links.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == label
    assert all((got[900 + k].n_links, got[900 + k].component_id, got[900 + k].kept) == (0, 900 + k, True) for k in range(len(odd)))
    assert embeddings.near_vectors(t.limit(0)).count() == 0


def test_vectors_in_many_segments(spark):
    """Cells that are near each other, a large group of near copies and pairs at the threshold, a few vectors a segment."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(60, 6))
    x = np.concatenate([x[rnd.integers(0, 60, 700)] + rnd.normal(size=(700, 6)) * 0.15, x[0] + rnd.normal(size=(200, 6)) * 0.01])
    for vectors, kind in ((x.astype(np.float32), "float"), (x, "double")):
        t = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(vectors.tolist())], f"vec_id long, embedding array<{kind}>, label int")
        got = {r.vec_id: r.n_links for r in embeddings.near_vectors(t, cell=15, block=32, segment=1500).collect()}
        u = vectors.astype(np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        links = (u @ u.T >= 0.98) & (np.arange(900)[:, None] % 2 == np.arange(900)[None, :] % 2)
        assert [got[i] for i in range(900)] == (links.sum(axis=1) - 1).tolist()


def test_vectors_are_written_once(spark, monkeypatch):
    """However many cells are near a vector, the shared folder has no more than four times the vectors' bytes."""
    from pathlib import Path

    rnd = np.random.default_rng(5)
    t = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rnd.normal(size=(6000, 64)).tolist())], "vec_id long, embedding array<float>, label int")
    shared, sizes = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")), []
    used = lambda: sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
    before, stored = used(), embeddings.stored

    def counted(*args, **options):
        out = stored(*args, **options)
        sizes.append(used() - before)
        return out

    monkeypatch.setattr(embeddings, "stored", counted)
    assert embeddings.near_vectors(t).count() == 6000
    assert 6000 * 64 * 4 < max(sizes) < 4 * 6000 * 64 * 4


def test_vectors_of_many_lengths(spark):
    rows = [(100 * n + k, [1.0 + 0.001 * k] + [0.5] * (n - 1), 1) for n in range(1, 30) for k in range(3)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for sample in (20_000, 5):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(t, sample=sample).collect()}
        assert got == {i: (2, i // 100 * 100) for i, _, _ in rows}


# op 6


def test_warc_round_trip(spark):
    big = "é" * 80 + "<html>"
    rows = [(1, "http://a\r\nX: y", big), (0, None, big), (2, "u", None), (3, "u", ""), (4, "u", "short"), (5, "u", "short"), (6, "u", "x" * 100), (6, "u", "x" * 100), (7, "u", "x" * 100), (None, "u", big), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (9, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder = work_path(spark, "test-warc")
    index = warc.write_archives(pages, folder, frame=1000)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in warc.read_archives(index, folder, payloads=True).collect()), key=str)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        same = [q for q, _, g in rows if (g or "").encode() == raw and q is not None]
        refers = min(same) if len(raw) >= 100 and p != min(same) else None
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers, raw if refers is None else b""))
    assert got == sorted(want, key=str)
    (one,) = warc.fetch(spark, index, folder, 9)
    assert b"z" * 300_000 in one and one.startswith(b"WARC/1.1\r\n")
    from pyarrow.fs import FileSelector, FileSystem

    fs, path = FileSystem.from_uri(folder)
    for bundle in {r.bundle for r in index.collect()}:
        with fs.open_input_file(f"{path}/{bundle}") as f:
            table = warc.read_seek_table(lambda at, n: f.read_at(n, at), f.size())
        assert {(at, packed) for at, packed, _ in table} == {(r.frame_at, r.frame_size) for r in index.where(F.col("bundle") == bundle).collect()}
    assert warc.write_archives(pages.limit(0), work_path(spark, "test-warc")).count() == 0
    # What a failed attempt left goes with the next writing; the index is by record identifier.
    with fs.open_output_stream(f"{path}/lost.warc.zst") as f:
        f.write(b"x")
    warc._remove_others(spark, index, folder)
    left = {f.base_name for f in fs.get_file_info(FileSelector(path))}
    assert left == {r.bundle for r in index.collect()}
    assert index.select("record_id").distinct().count() == len(rows)


def plain_reader(raw):
    """Records of a WARC/1.1 file by the standard's grammar alone: version line, fields, block, two line ends."""
    at, out = 0, []
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode("utf-8").split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(re.fullmatch(r"([!-9;-~]+):[ \t]*(.*)", x, re.S).groups() for x in lines)
        assert len(fields) == len(lines) and {"WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type"} <= set(fields)
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        size = int(fields["Content-Length"])
        block, tail = raw[end + 4 : end + 4 + size], raw[end + 4 + size : end + 8 + size]
        assert len(block) == size and tail == b"\r\n\r\n"
        out.append((fields, block))
        at = end + 8 + size
    return out


def test_warc_by_another_reader(spark):
    import io

    import zstandard
    from pyarrow.fs import FileSelector, FileSystem

    big = "<p>é</p>" * 40
    rows = [(k, f"http://h/{k}", big if k % 3 == 0 else f"page {k}") for k in range(40)] + [(0, "http://h/0", big), (3, "http://h/3", big)]
    folder = work_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, frame=2000, bundle=4000)
    fs, path = FileSystem.from_uri(folder)
    found = []
    for f in fs.get_file_info(FileSelector(path)):
        with fs.open_input_file(f.path) as file:
            found += plain_reader(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read()), read_across_frames=True).read())
    ids = [h["WARC-Record-ID"] for h, _ in found]
    assert len(found) == len(rows) == len(set(ids))
    by = {h["WARC-Record-ID"]: (h, b) for h, b in found}
    for h, b in found:
        status, _, payload = b.partition(b"\r\n\r\n")
        assert status.startswith(b"HTTP/1.1 200 OK\r\n") and h["Content-Type"] == "application/http; msgtype=response"
        if h["WARC-Type"] == "revisit":
            assert payload == b"" and h["WARC-Profile"].endswith("/revisit/identical-payload-digest")
            of, block = by[h["WARC-Refers-To"]]
            assert of["WARC-Type"] == "response" and of["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
            assert (of["WARC-Target-URI"], of["WARC-Date"]) == (h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"])
        else:
            assert h["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
    assert sum(h["WARC-Type"] == "revisit" for h, _ in found) == 14  # 13 pages after page 0, one of them twice


# op 7


def test_quality_keeps_clean_and_shrinks_sparse_sites(spark):
    rnd = random.Random(6)
    words = ["river", "music", "garden", "people", "walked", "quietly", "home"]
    good = lambda: " ".join(rnd.choices(words, k=80)).capitalize() + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in rnd.choices(words, k=80))
    rows = [(i, bad() if i % 4 == 0 else good(), f"host{i % 3}/p{i % 5}") for i in range(400)] + [(1000, good(), "lonely/x")] + [(2000 + i, bad(), "farm/y") for i in range(60)]
    d = docs(spark, *rows)
    y = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(d, quality.fit_model(d, y)).collect()}
    assert len(out) == len(rows) and all(out[i].kept == (i % 4 != 0) for i in range(400))
    assert out[1000].kept and out[2000].path_rate < 0.5 < out[1000].path_rate
    assert abs(out[1000].path_rate - out[1].path_rate) < 0.35


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    raw, n = text.encode(), max(1, len(words))
    symbols = set("!#$%&*+/<=>@[\\]^_`{|}~")
    share = lambda test: sum(map(test, raw)) / max(1, len(raw))
    again = sum(1 for k, w in enumerate(low) if w in low[max(0, k - 2) : k])
    return [
        np.log1p(len(words)), np.log1p(sum(len(w.encode()) for w in words) / n), share(lambda c: 65 <= c <= 90) ** 0.5, share(lambda c: chr(c) in symbols and c < 128) ** 0.5,
        (sum(w[-1] in symbols for w in words) / n) ** 0.5, (sum(w == "|" for w in words) / n) ** 0.5, share(lambda c: 48 <= c <= 57) ** 0.5, (again / n) ** 0.5,
        len(set(low)) / n if words else 1.0, share(lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128),
    ]


def test_quality_measures_by_value():
    rnd = random.Random(23)
    texts = ["", " ", "|", "a a a b a", "É é! 12 | x|", *(" ".join("".join(rnd.choices("abAé1!|$.", k=rnd.randint(1, 6))) for _ in range(rnd.randint(1, 40))) for _ in range(80))]
    data, off = utf8(pa.array(texts))
    assert np.allclose(quality.measures(data, off), [brute_measures(t) for t in texts])


def brute_quality(rows, model):
    """rows: (id, text, source, lang). Scores of the whole hierarchy, in plain Python."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    odds = [float(model.log_odds(np.array([brute_measures(t or "")]))[0]) for _, t, _, _ in rows]
    p = [sigmoid(z) for z in odds]
    host = [s if s is None else s.split("/")[0] for _, _, s, _ in rows]
    path = [(h, s, g) for h, (_, _, s, g) in zip(host, rows, strict=True)]
    group = lambda keys: {k: [x for x, q in zip(p, keys, strict=True) if q == k] for k in keys}
    hosts, paths = group(host), group(path)

    def spread(groups, center):
        used = [(len(v), sum(v) / len(v), center(k)) for k, v in groups.items() if len(v) > 1]
        n = sum(a for a, _, _ in used)
        room = sum(a * c * (1 - c) for a, _, c in used)
        if not used or n <= len(used) or not room:
            return quality.MOST
        share = max(0.0, (sum(a * (m - c) ** 2 for a, m, c in used) - sum(c * (1 - c) for _, _, c in used)) / (n - len(used))) / (room / n)
        return quality.MOST if share <= 1 / (quality.MOST + 1) else min(quality.MOST, max(quality.LEAST, 1 / share - 1))

    overall = (sum(p) + 1) / (len(p) + 2)
    k1 = spread(hosts, lambda _: overall)
    host_rate = {h: (sum(v) + k1 * overall) / (len(v) + k1) for h, v in hosts.items()}
    k2 = spread(paths, lambda q: host_rate[q[0]])
    base, out = np.log(model.rate / (1 - model.rate)), {}
    for (i, *_), z, x, h, q in zip(rows, odds, p, host, path, strict=True):
        others = (sum(p) - x + 1) / (len(p) + 1)
        above = (sum(hosts[h]) - x + k1 * others) / (len(hosts[h]) - 1 + k1)
        prior = (sum(paths[q]) - x + k2 * above) / (len(paths[q]) - 1 + k2)
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        out[i] = (sigmoid(z - base + np.log(prior / (1 - prior))), host_rate[h], (sum(paths[q]) + k2 * host_rate[h]) / (len(paths[q]) + k2))
    return out


def test_quality_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d = d.withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.concat_ws("/", F.concat(F.lit("h"), F.col("doc_id") % 5), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))))
    model = quality.fit_model(d, spark.read.parquet(f"{SF}/labels.parquet"))
    want = brute_quality([(r.doc_id, r.text, r.source, r.lang) for r in d.collect()], model)
    got = quality.classify(d, model, columns=["doc_id"]).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose((r.score, r.host_rate, r.path_rate), want[r.doc_id], atol=1e-9) and r.kept == (r.score >= 0.5)


def test_quality_evidence_counts_once(spark):
    """A lone document of a site has the prior of all the others, whatever it is like itself."""
    d = docs(spark, *[(i, "plain words on a page", "big/a") for i in range(50)], (100, "SHOUT!! $$$ " * 20, "lone/a"))
    m = quality.Model(np.array([0.0] * 3 + [-8.0] + [0.0] * 6), 2.0, np.zeros(10), np.ones(10), 0.5)
    r = {x.doc_id: x for x in quality.classify(d, m).collect()}[100]
    own = float(m.log_odds(np.array([brute_measures("SHOUT!! $$$ " * 20)]))[0])
    p = 1 / (1 + np.exp(-2.0))
    others = (50 * p + 1) / 52
    assert abs(np.log(r.score / (1 - r.score)) - (own + np.log(others / (1 - others)))) < 1e-6


def test_dense_fit_is_the_optimum():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 3)) * [1, 5, 0.1] + 2
    y = (x[:, 0] + rnd.normal(size=400) > 2).astype(float)
    w, b, mean, scale = fit_dense(x, y, 1.0)
    z = (x - mean) / scale
    g = 1 / (1 + np.exp(-(z @ w + b))) - y
    assert np.abs(z.T @ g + w).max() < 1e-5 and abs(g.sum()) < 1e-3


def test_quality_odd_rows(spark):
    d = docs(spark, *ODD)
    for labels in ([], [(4, 1)], [(4, 1), (6, 0)]):
        m = quality.fit_model(d, spark.createDataFrame(labels, "doc_id long, quality int"))
        out = quality.classify(d, m)
        assert out.count() == len(ODD) and out.where("score is null or kept is null").count() == 0
    assert quality.classify(d.limit(0), m).count() == 0


# op 8


def brute_spans(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        v = [int(c) for c in reversed(d)]
        return sum(x if k % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for k, x in enumerate(v)) % 10 == 0

    tests = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    for rank, (kind, _, plain) in enumerate(pii.KINDS[:4]):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(plain, text) if tests[kind](m[0])]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_pii_against_brute_force(spark):
    rnd = random.Random(8)
    parts = ["a.b@c.de", "x@y", "@z.q", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.01.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-2671", "+49 30 1234567", "++1", "é漢", " ", "_", "-", ".", "7", "m@n.o_p@q.r", "😀"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(300)]
    texts += ["a@b.cd " * 1500, "9" * 20000, "a" * 20000, "a." * 5000 + "@", "(" * 3000, "1-" * 5000, "x@" + "y." * 4000 + "z"]
    d = docs(spark, *[(i, t, "s") for i, t in enumerate(texts)], (9999, None, "s"))
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.BASE] for r in pii.detect(d).collect()}
    assert got[9999] == []
    for i, t in enumerate(texts):
        assert got[i] == brute_spans(t), t[:80]


def test_pii_added_kinds_and_redaction(spark):
    d = docs(spark, (1, "IBAN GB82WEST12345698765432 and GB82WEST12345698765433", "s"), (2, 'api key = "abcdef0123456789abcdef01"', "s"), (3, "abcdef0123456789abcdef01", "s"), (4, "ssn 123-45-6789", "s"), (5, "part 123-45-6789", "s"))
    got = {r.doc_id: ([s.kind for s in r.spans], r.redacted) for r in pii.redact(d).collect()}
    assert [got[i][0] for i in range(1, 6)] == [["iban"], ["secret"], [], ["id"], []]
    assert got[1][1] == "IBAN [IBAN] and GB82WEST12345698765433"
    assert pii.detect(d.limit(0)).count() == 0


# op 9


def brute_near(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    monkeypatch.setattr(near_duplicates, "SETS", 5)
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(12):
        base = rnd.choices(vocabulary, k=rnd.choice([3, 30, 120]))
        for _ in range(rnd.choice([2, 12, 40])):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append(" ".join(t))
    rows = [(i, t) for i, t in enumerate(rnd.sample(rows, len(rows)))] + [(5000, ""), (5001, None), (5002, "a b"), (5003, "A  b"), (5004, "b a"), (5005, "x"), (5006, "X")]
    d = docs(spark, *[(i, t, "s") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(d, 3, 85).collect()}
    assert got == brute_near(rows, 3, 85)


def test_near_duplicates_odd_rows(spark):
    out = near_duplicates.near_duplicates(docs(spark, *ODD))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(ODD) and (None, 1, None, True) in got and got.count((4, 1, 4, True)) == 2 and (1, 0, 1, True) in got
    assert near_duplicates.near_duplicates(docs(spark, *ODD).limit(0)).count() == 0


def test_near_duplicates_of_rows_that_share_an_id(spark):
    """A doc_id with two texts is one vertex, linked by either."""
    rnd = random.Random(14)
    text = lambda: " ".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=60))
    one, two, three = text(), text(), text()
    rows = [(1, one), (1, two), (7, one + " end"), (8, two + " end"), (9, three), (4, three + " end"), (4, one + " fin")]
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs(spark, *[(i, t, "s") for i, t in rows])).collect()}
    assert got == {1: 1, 7: 1, 8: 1, 4: 1, 9: 1}


def test_look_alikes_in_chains(spark, monkeypatch):
    """Texts of one template, most too far apart to be linked, some linked in chains across what the stars have joined."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    monkeypatch.setattr(near_duplicates, "SETS", 3)
    monkeypatch.setattr(near_duplicates, "STAR", 4)
    rnd = random.Random(15)
    template, rows = [f"t{k}" for k in range(150)], []
    for _ in range(60):
        t = list(template)
        for k in rnd.sample(range(150), 5):
            t[k] = f"x{rnd.randrange(9)}"
        rows.append(t)
    for _ in range(60):  # neighbours of neighbours
        t = list(rnd.choice(rows))
        for k in rnd.sample(range(150), 2):
            t[k] = f"y{rnd.randrange(9)}"
        rows.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(rnd.sample(rows, len(rows)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs(spark, *[(i, t, "s") for i, t in rows])).collect()}
    want = brute_near(rows, 5, 80)
    assert got == want and len({c for _, c in want.values()}) > 5


def test_first_shared_key():
    rnd = np.random.default_rng(3)
    sig = rnd.integers(0, 2, (60, near_duplicates.CHUNKS * near_duplicates.VALUES)).astype(np.int16)
    keys = [near_duplicates.chunk_keys(s) for s in sig]
    for i in range(60):
        same = sig == sig[i]
        for j, place in enumerate(near_duplicates.first_shared(same).tolist()):
            common = np.flatnonzero(keys[i] == keys[j])
            assert place == (common[0] if len(common) else -1)
            if len(common):
                assert keys[i][place] >> (near_duplicates.BITS * (near_duplicates.VALUES - 1)) == place


# op 10


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total, fixed = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in fixed)
        open_ = sum(weight[s] for s in order if s not in fixed)
        target = {s: 3 * sizes[s] if s in fixed else left * weight[s] / open_ for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]} - fixed
        if not over:
            return target
        fixed |= over


def test_mix_reaches_targets_within_limits(spark):
    rnd = random.Random(10)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 200, 900])), rnd.choice(["a"] * 30 + ["b", "c", "ü", None, "z", "tiny"])) for i in range(700)]
    d = docs(spark, *rows)
    out = mixing.mix_sources(d, block=64, shard=16)
    got = out.collect()
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target, by = brute_targets(sizes), {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = by[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and 0 <= r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(d.repartition(7), block=64, shard=16).collect()))
    m = mixing.Mix(d, block=64, shard=16)
    per = [r.n for r in m.shard_counts.groupBy("shard").agg(F.sum("slots").alias("n")).orderBy("shard").collect()]
    assert set(per[:-1]) == {16} and 0 < per[-1] <= 16
    assert m.slots.groupBy("shard", "slot").count().where("count > 1").count() == 0
    # What stands in the shards: each slot's words, up to a block, are those that the documents' rows report.
    held = mixing.mixed_shards(d, block=64, shard=16)
    slots, per_doc, first = {}, {}, {}
    for r in held.collect():
        n = len(r.text.split())
        slots[(r.shard, r.slot)] = slots.get((r.shard, r.slot), 0) + n
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + n
        first[r.doc_id] = min(first.get(r.doc_id, (r.shard, r.slot)), (r.shard, r.slot))
    assert {(r.shard, r.slot): r.words for r in m.slots.where("words > 0").collect()} == slots and max(slots.values()) <= 64
    assert per_doc == {r.doc_id: r.taken for r in got if r.taken}
    assert first == {r.doc_id: (r.first_shard, r.first_slot) for r in got if r.taken}
    # Shards differ in their draws, and all have about the mix's shares.
    counts = m.shard_counts.toPandas().pivot(index="shard", columns="source", values="slots").fillna(0)
    assert len(counts.drop_duplicates()) > 2 and abs(counts["a"].mean() / counts.sum(axis=1).mean() - counts["a"].sum() / counts.to_numpy().sum()) < 0.05
    words = mixing.mixed_documents(d, block=64, shard=16).groupBy("doc_id").agg(F.sum(mixing.count_words(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in words} == {r.doc_id: r.taken for r in got if r.taken}


def test_mix_odd_rows(spark):
    got = mixing.mix_sources(docs(spark, *ODD))
    assert got.count() == len(ODD) and got.where("taken is null or target is null").count() == 0
    assert mixing.mix_sources(docs(spark, *ODD).limit(0)).count() == 0
    assert mixing.mix_sources(docs(spark, (1, None, "a"), (2, "", None))).where("taken <> 0 or target <> 0").count() == 0
    assert mixing.mixed_documents(docs(spark, *ODD)).columns == docs(spark, *ODD).columns
    assert mixing.mixed_shards(docs(spark, *ODD).limit(0)).count() == 0
    assert "shard" in mixing.mix_sources(docs(spark, *ODD))._jdf.queryExecution().optimizedPlan().toString()


# hashes


def thue_morse(n):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t[:n]), "".join("ba"[x] for x in t[:n])


@pytest.mark.parametrize("n", [64, 1024, 2048])
def test_patterned_words_stay_apart(spark, n):
    texts = [*thue_morse(n), *("".join(p) for p in zip(*thue_morse(n), strict=True)), "a" * n, "b" * n, "ab" * (n // 2), "ba" * (n // 2)]
    data, off = utf8(pa.array(texts))
    for lane in (0, 1):
        h = Words(data, off, NOT_SPACE).hashes(lane)
        assert len(set(h.tolist())) == len(set(texts))
    d = docs(spark, *[(i, t, "s") for i, t in enumerate(texts)])
    path = work_path(spark, "test-tokens")
    tokens.write_tokens(d, path)
    enc = tokens.encoder(tokens._tokenizer_path()).tokenizer
    assert {r.doc_id: r.ids for r in tokens.token_table(spark, path).collect()} == {i: [*enc.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(d).collect()}
    assert got == brute_near(list(enumerate(texts)), 5, 80)


def test_pieces_of_one_hash_stay_apart(monkeypatch):
    """Even if all pieces of a length had the same hash."""
    monkeypatch.setattr(_pieces.Pieces, "hash", staticmethod(lambda total, begin, size: size.astype(np.uint64) | np.uint64(1)))
    p, rnd = _pieces.Pieces(tokens._tokenizer_path()), random.Random(12)
    for _ in range(5):
        texts = [" ".join("".join(rnd.choices("abcdé", k=rnd.randint(1, 6))) for _ in range(20)) for _ in range(20)]
        data, off = utf8(pa.array(texts))
        ids, row = p.encode(data, off)
        for t, a, b in zip(texts, row[:-1], row[1:], strict=True):
            assert p.tokenizer.encode(t, add_special_tokens=False).ids == ids[a:b].tolist()
