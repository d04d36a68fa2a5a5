"""The stages by themselves and together."""

import os
import re
import zlib

import numpy as np

import corpus_pipeline as P
from huescape.llm import quality, tokens
from huescape.llm._common import work_path
from huescape.store import roots

from . import test_operators as O

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def brute_tokens(docs):
    enc, got = tokens.encoder(tokens._tokenizer_path()).tokenizer, []
    rows = docs.collect()
    for r in rows:
        ids = [*enc.encode(r.text or "", add_special_tokens=False).ids, 0]
        got.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(got)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        out = P.stored(stage(spark, docs, SF), f"test-{k}")
        if name == "tokens":
            rows = sorted(out.collect(), key=lambda r: r.start)
            assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
            assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
            assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == brute_tokens(docs)
        else:
            assert out.columns == docs.columns
        if name == "quality":
            model = quality.fit_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = O.brute_quality([(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()], model)
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (p, _, _) in scores.items() if p >= 0.5) and out.count() < docs.count()
        if name == "mixing":
            check_mix(docs.collect(), out.collect())
        if name == "near duplicates":
            near = {r.doc_id: r.component_id for r in O.near_duplicates.near_duplicates(docs).collect()}
            brute = O.brute_near([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 5, 80)
            assert near == {i: c for i, (_, c) in brute.items()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(set(near.values()))
        if name == "decontamination":
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = []
            for r in docs.collect():
                n, hit, _ = O.brute_overlap(r.text, items)
                if not (hit and 20 * hit >= n):
                    clean.append(r.doc_id)
            assert sorted(r.doc_id for r in out.collect()) == sorted(clean)
        docs = out
    assert 0 < docs.count() and before >= 100
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def check_mix(before, after):
    """Each source comes to its target, each row is a run of a document's words, in order, and none is over its limit."""
    words = {r.doc_id: re.findall(WORD, r.text or "") for r in before}
    source, sizes, taken = {r.doc_id: r.source for r in before}, {}, {}
    for i, w in words.items():
        sizes[source[i]] = sizes.get(source[i], 0) + len(w)
    per = dict.fromkeys(words, 0)
    for r in after:
        mine = re.findall(WORD, r.text)
        it = iter(words[r.doc_id])
        assert mine and all(w in it for w in mine) and r.source == source[r.doc_id] and r.n_chars == len(r.text)
        per[r.doc_id] += len(mine)
        taken[r.source] = taken.get(r.source, 0) + len(mine)
    target = O.brute_targets(sizes)
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in sizes)
    assert all(n <= 3 * len(words[i]) for i, n in per.items())


def test_nothing_is_left_behind(spark):
    """Tables and files that a run's result doesn't read are gone when it is returned."""
    folder = work_path(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    P.run(spark, SF).collect()
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before)
    assert left == ["tokens"], left
    for name, query in O.queries.QUERIES.items():
        now = set(os.listdir(folder))
        out = query(spark, SF)
        made = set(os.listdir(folder)) - now
        assert made <= roots(out) | {x for x in made if x.startswith(("warc", "tokens"))}, (name, made)


def test_stages_on_odd_and_empty_documents(spark):
    odd = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in O.ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(P.STAGES):
            docs = P.stored(stage(spark, docs, SF), f"odd-{k}")
        assert docs.count() >= 0
