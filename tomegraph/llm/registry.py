"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat_format, decontamination, exact_dedup, line_dedup, packing, pii, quality, resampling, simhash, token_file, top_k, url_filter, whitening

_MODULES = (chat_format, pii, quality, url_filter, simhash, line_dedup, token_file, packing, decontamination, exact_dedup, top_k, resampling, whitening)
QUERIES = {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit() and callable(f)}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
