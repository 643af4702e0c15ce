"""Queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
from textloom.llm import chat, clusters, embeddings, fixity, html, jaccard, lines, mixing, packing, runs, toxicity, urls

QUERIES = {
    "op1_mincut_html": html.op1_mincut_html,
    "op2_stable_projection_ann": embeddings.op2_stable_projection_ann,
    "op3_int8_tile_dedup": embeddings.op3_int8_tile_dedup,
    "op4_shortest_pack_first": packing.op4_shortest_pack_first,
    "op5_merkle_fixity": fixity.op5_merkle_fixity,
    "op6_entropy_mix": mixing.op6_entropy_mix,
    "op7_reply_tree_chat": chat.op7_reply_tree_chat,
    "op8_vertical_jaccard_join": jaccard.op8_vertical_jaccard_join,
    "op9_line_chunk_dedup": lines.op9_line_chunk_dedup,
    "op10_toxicity_chain": toxicity.op10_toxicity_chain,
    "op11_lyndon_runs": runs.op11_lyndon_runs,
    "op12_rare_token_rules": urls.op12_rare_token_rules,
    "op13_bit_plane_clusters": clusters.op13_bit_plane_clusters,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op5_merkle_fixity": fixity.OP5_SQL,
    "op3_int8_tile_dedup": embeddings.OP3_SQL,
    "op6_entropy_mix": mixing.OP6_SQL,
    "op7_reply_tree_chat": chat.OP7_SQL,
    "op8_vertical_jaccard_join": jaccard.OP8_SQL,
    "op9_line_chunk_dedup": lines.OP9_SQL,
    "op12_rare_token_rules": urls.OP12_SQL,
    "op13_bit_plane_clusters": clusters.OP13_SQL,
}
