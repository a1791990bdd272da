"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from granary.llm import embeddings, jaccard, licences, mixing, phrases, pieces, quality, suffix, warc, webp

QUERIES = {
    "op1_suffix_dedup": suffix.op1_suffix_dedup,
    "op2_quality_score": quality.op2_quality_score,
    "op3_licence_scan": licences.op3_licence_scan,
    "op4_pareto_mix": mixing.op4_pareto_mix,
    "op5_warc_salvage": warc.op5_warc_salvage,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_substring_dedup": phrases.op7_substring_dedup,
    "op8_webp_media": webp.op8_webp_media,
    "op9_sentencepiece_dropout": pieces.op9_sentencepiece_dropout,
    "op10_embedding_neardup": embeddings.op10_embedding_neardup,
}
SQL = {
    "op4_pareto_mix": mixing.SQL,
    "op5_warc_salvage": warc.SQL,
    "op6_ngram_jaccard": jaccard.SQL,
    "op7_substring_dedup": phrases.SQL,
}
