"""All queries of the subpackage; importing this module fills its registry."""

from accessgraph.llm import (  # noqa: F401
    chat,
    decontamination,
    embedding_dup,
    fill_middle,
    html_text,
    importance,
    licences,
    near_dup,
    packing,
    periodic_runs,
    secret_scan,
    token_files,
    warc,
)
from accessgraph.llm.common import LLM_ORACLES, LLM_QUERIES

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]
