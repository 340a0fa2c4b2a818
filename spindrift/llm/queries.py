"""All queries of this folder, and their SQL where there is one."""

from __future__ import annotations

from . import attention, bpe, licenses, linejoin, mixing, nearcopies, pagetext, replies, rules, spellings, toxicity, transport, whitening

MODULES = (mixing, bpe, transport, rules, licenses, attention, toxicity, linejoin, nearcopies, pagetext, whitening, replies, spellings)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
