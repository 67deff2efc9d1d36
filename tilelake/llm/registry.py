"""The queries of this subpackage and their SQL."""

from tilelake.llm import bytebpe, decontaminate, licences, linededup, neardup, periodic, pii, quality, quotes, spelling, suffixdedup, tokenfile, urlrules

QUERIES = {
    "op1_feistel_pii": pii.op1_feistel_pii,
    "op2_quotes": quotes.op2_quotes,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_licences": licences.op4_licences,
    "op5_url_rules": urlrules.op5_url_rules,
    "op6_bag_minhash": neardup.op6_bag_minhash,
    "op7_byte_bpe": bytebpe.op7_byte_bpe,
    "op8_sparse_suffixes": suffixdedup.op8_sparse_suffixes,
    "op9_quality": quality.op9_quality,
    "op10_simple8b": tokenfile.op10_simple8b,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_line_dedup": linededup.op13_line_dedup,
}

ORACLES = {
    "op2_quotes": quotes.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op4_licences": licences.SQL,
    "op6_bag_minhash": neardup.SQL,
    "op8_sparse_suffixes": suffixdedup.SQL,
    "op9_quality": quality.SQL,
    "op11_periodic_runs": periodic.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_line_dedup": linededup.SQL,
}
