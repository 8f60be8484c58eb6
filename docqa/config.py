"""The settings that jobs read: a given value, else the environment's, else the default. Empty values count as unset."""

from __future__ import annotations

import os

# Fixed names: users set these already.
ENVIRONMENT = {"k": "RETRIEVER_TOP_K", "chunk_table": "DELTA_TABLE_NAME"}
DEFAULTS = {"k": 5, "chunk_table": "docqa_chunks"}


def setting(name: str, given=None):
    """``k`` (hits of a question) or ``chunk_table`` (the saved chunks), of the type of its default."""
    default = DEFAULTS[name]
    return type(default)(given or os.environ.get(ENVIRONMENT[name]) or default)
