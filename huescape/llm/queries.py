"""Queries over the corpus tables by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontamination, embeddings, mixing, near_duplicates, pii, quality, tokens, toxicity, warc
from ._common import small_batches

_MODULES = {
    "op1_chat_format": chat,
    "op2_toxicity": toxicity,
    "op3_tokens": tokens,
    "op4_decontaminate": decontamination,
    "op5_near_vectors": embeddings,
    "op6_warc": warc,
    "op7_quality": quality,
    "op8_pii": pii,
    "op9_near_duplicates": near_duplicates,
    "op10_mix_sources": mixing,
}



def _small(run):
    return lambda spark, sf_dir: run(small_batches(spark), sf_dir)


QUERIES = {name: _small(m.query) for name, m in _MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: m.oracle() for name, m in _MODULES.items() if hasattr(m, "oracle")}
