from __future__ import annotations

#: Columns whose names clash with those that operators add.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, slot long, n_words long, kept_text string, score double, id long, `key` string"


def document(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text or ""), 7, 7, 7, 7, "x", 0.5, 1, "k")
