"""All registered queries of the subpackage."""

from __future__ import annotations

from vistagrid.llm import alignment, bpe, brown, decontaminate, jaccard, licenses, pii, quality, secrets, styletree, suffixes, toxicity, vertical  # noqa: F401
from vistagrid.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
