"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import bpe, graph, langid, linededup, mix, quality, simhash, suffixarray, suffixtree, vafile

QUERIES = {
    "op1_suffix_tree": suffixtree.op1_suffix_tree,
    "op2_line_chunks": linededup.op2_line_chunks,
    "op3_suffix_array": suffixarray.op3_suffix_array,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_rank_order_language": langid.op5_rank_order_language,
    "op6_simhash_classes": simhash.op6_simhash_classes,
    "op7_mix_sources": mix.op7_mix_sources,
    "op8_exact_top_k": vafile.op8_exact_top_k,
    "op9_robust_graph": graph.op9_robust_graph,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}

SQL = {
    "op7_mix_sources": mix.SQL,
    "op8_exact_top_k": vafile.SQL,
}
