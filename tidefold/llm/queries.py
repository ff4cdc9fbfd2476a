"""Queries of this subpackage and their SQL, by name."""

from tidefold.llm import (
    chat, jaccard_join, line_dedup, merkle, mixing, near_dedup, order_minhash, packing, pitman_yor, quality, runs, search, urls,
)

_MODULES = (
    near_dedup, line_dedup, urls, chat, search, quality, mixing, packing, pitman_yor, order_minhash,
    jaccard_join, runs, merkle,
)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: text for module in _MODULES for name, text in module.SQL.items()}
