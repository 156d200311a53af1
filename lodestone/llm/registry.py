"""Queries of the training-data operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from . import alignment, exact_dedup, hidden_markov, html_text, media, merkle, mixing, near_dedup, pieces, quality, secrets, token_counts, transcripts

QUERIES = {
    "op1_secrets": secrets.op1,
    "op2_near_dedup": near_dedup.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_quality": quality.op4,
    "op5_media": media.op5,
    "op6_pieces": pieces.op6,
    "op7_mixing": mixing.op7,
    "op8_token_counts": token_counts.op8,
    "op9_transcripts": transcripts.op9,
    "op10_html_text": html_text.op10,
    "op11_merkle": merkle.op11,
    "op12_hidden_markov": hidden_markov.op12,
    "op13_alignment": alignment.op13,
}

SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op11_merkle": merkle.OP11_SQL,
}
