"""The contract queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import codes, divergence, forest, katz, lattice, licenses, mixing, pieces, quality, simhash, token_counts, token_files, topk

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_token_files": token_files.op2_token_files,
    "op3_pieces": pieces.op3_pieces,
    "op4_lattice": lattice.op4_lattice,
    "op5_mixing": mixing.op5_mixing,
    "op6_licenses": licenses.op6_licenses,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_katz": katz.op8_katz,
    "op9_quality": quality.op9_quality,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_prefix_forest": forest.op12_prefix_forest,
    "op13_source_divergence": divergence.op13_source_divergence,
}

SQL = {
    "op4_lattice": lattice.OP4_SQL,
    "op10_exact_topk": topk.OP10_SQL,
    "op11_vector_codes": codes.OP11_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
