"""The registered queries of this subpackage."""

from __future__ import annotations

from civiltext.llm import (
    bpe, decontaminate, hard_negatives, languages, licenses, mixing, personal_data, prefix_trie, quality, secrets, simhash, tokens,
    toxicity,
)

MODULES = (secrets, mixing, decontaminate, quality, simhash, tokens, licenses, personal_data, toxicity, languages, hard_negatives, bpe, prefix_trie)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
