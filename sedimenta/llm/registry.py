"""Queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from sedimenta.llm import align, bpe, exact, hnsw, kmeans, language, lines, mixing, sharding, simhash, topk, toxicity, warc


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_sharding": sharding.op2_sharding,
        "op3_simhash_dedup": simhash.op3_simhash_dedup,
        "op4_line_dedup": lines.op4_line_dedup,
        "op5_topk_search": topk.op5_topk_search,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_warc": warc.op7_warc,
        "op8_language_id": language.op8_language_id,
        "op9_embedding_dedup": hnsw.op9_embedding_dedup,
        "op10_source_mixing": mixing.op10_source_mixing,
        "op11_token_alignment": align.op11_token_alignment,
        "op12_exact_dedup": exact.op12_exact_dedup,
        "op13_kmeans": kmeans.op13_kmeans,
    }


def oracle_sql():
    return {
        "op5_topk_search": topk.OP5_SQL,
        "op7_warc": warc.OP7_SQL,
        "op9_embedding_dedup": hnsw.OP9_SQL,
        "op10_source_mixing": mixing.OP10_SQL,
        "op12_exact_dedup": exact.OP12_SQL,
        "op13_kmeans": kmeans.OP13_SQL,
    }
