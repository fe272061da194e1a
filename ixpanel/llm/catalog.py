"""Registered queries of the corpus operators, and the DuckDB twins of those SQL can express."""

from __future__ import annotations

from ixpanel.llm import (alignment, chat, decontaminate, embeddings, language, licenses, periodic, pieces, pii,
                         quality, secret_scan, simhash, warc)

QUERIES = {
    "op1_secret_scan": secret_scan.query,
    "op2_pii": pii.query,
    "op3_language_id": language.query,
    "op4_sentencepiece": pieces.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_embedding_near_dedup": embeddings.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_warc": warc.query,
    "op9_quality_classifier": quality.query,
    "op10_license_scan": licenses.query,
    "op11_cross_tokenizer_alignment": alignment.query,
    "op12_chat_formatting": chat.query,
    "op13_periodic_runs": periodic.query,
}

SQL = {
    "op5_benchmark_decontamination": decontaminate.SQL,
    "op6_embedding_near_dedup": embeddings.SQL,
    "op8_warc": warc.SQL,
    "op12_chat_formatting": chat.SQL,
}
