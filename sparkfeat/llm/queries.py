"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from sparkfeat.llm import (decontaminate, lines, mixing, phrases, quality, ranked, secrets, simhash, sketches, spheres,
                           surrogates, topk, urls)

QUERIES = {
    "op1_pii_surrogates": surrogates.op1_pii_surrogates,
    "op2_phrase_dedup": phrases.op2_phrase_dedup,
    "op3_secret_forest": secrets.op3_secret_forest,
    "op4_kdtree_topk": topk.op4_kdtree_topk,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_simhash_groups": simhash.op6_simhash_groups,
    "op7_url_cascade": urls.op7_url_cascade,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_quality_gam": quality.op9_quality_gam,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_scaled_sketch": sketches.op11_scaled_sketch,
    "op12_sphere_clusters": spheres.op12_sphere_clusters,
    "op13_rmq_search": ranked.op13_rmq_search,
}

SQL = {
    "op2_phrase_dedup": phrases.OP2_SQL,
    "op4_kdtree_topk": topk.OP4_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op7_url_cascade": urls.OP7_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
    "op11_scaled_sketch": sketches.OP11_SQL,
    "op12_sphere_clusters": spheres.OP12_SQL,
    "op13_rmq_search": ranked.OP13_SQL,
}
