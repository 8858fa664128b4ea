"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: query: (module, SQL constant or None)
QUERIES = {
    "op1_voronoi_topk": ("knn", "OP1_SQL"),
    "op2_quality_classifier": ("quality", None),
    "op3_near_duplicates": ("neardup", "OP3_SQL"),
    "op4_telephony_audio": ("audio", None),
    "op5_pii_pseudonyms": ("pii", None),
    "op6_toxicity": ("toxicity", None),
    "op7_mixing": ("mixing", "OP7_SQL"),
    "op8_license_scan": ("licenses", "OP8_SQL"),
    "op9_bpe": ("bpe", None),
    "op10_html_extraction": ("pages", None),
    "op11_tokenizer_alignment": ("alignment", None),
    "op12_binary_ids": ("binary", None),
    "op13_collocations": ("phrases", "OP13_SQL"),
}


def queries() -> dict:
    import corpus_pipeline

    out = {name: getattr(import_module(f".{module}", __package__), name) for name, (module, _) in QUERIES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out = {name: getattr(import_module(f".{module}", __package__), sql) for name, (module, sql) in QUERIES.items() if sql}
    return out
