"""Rows of documents for the tests of the corpus operators."""

#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest int, kept int, fp int, row int, tag int, host int, bad int, likely int, n_tokens int, rate int, shard int"


def document(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, len(text or ""), *range(11))
