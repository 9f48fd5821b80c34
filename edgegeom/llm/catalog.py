"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import queries_dedup, queries_files, queries_ranked, queries_text, queries_trie

_MODULES = (queries_dedup, queries_files, queries_ranked, queries_text, queries_trie)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
