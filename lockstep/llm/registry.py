"""The text operators' queries, and their SQL where SQL can express them."""

from . import chunk_dedup, conversations, decontaminate, exact_dedup, html_extract, language, negatives, packing, pieces, sharding, simhash, token_files, url_filter

QUERIES = {
    "op1_template_leaks": decontaminate.op1_template_leaks,
    "op2_line_blocks": html_extract.op2_line_blocks,
    "op3_range_coded_ids": token_files.op3_range_coded_ids,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_language_mixture": language.op5_language_mixture,
    "op6_chunk_dedup": chunk_dedup.op6_chunk_dedup,
    "op7_url_cascade": url_filter.op7_url_cascade,
    "op8_simhash": simhash.op8_simhash,
    "op9_piece_viterbi": pieces.op9_piece_viterbi,
    "op10_kk_shards": sharding.op10_kk_shards,
    "op11_cutting_stock_packing": packing.op11_cutting_stock_packing,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_distance_key_negatives": negatives.op13_distance_key_negatives,
}
SQL = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op7_url_cascade": url_filter.SQL,
    "op11_cutting_stock_packing": packing.op11_cutting_stock_packing,
    "op12_conversation_repair": conversations.SQL,
    "op13_distance_key_negatives": negatives.SQL,
}
