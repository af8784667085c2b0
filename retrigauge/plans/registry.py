"""All queries of the engine with their SQL counterparts."""

from __future__ import annotations

from . import corpus_plans, retrieval_plans, text_plans  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    return QUERIES["op70_exposure_summary"](spark, sf_dir)
