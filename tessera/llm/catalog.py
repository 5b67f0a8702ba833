"""What ``__spark_entry__`` registers of this subpackage and its pipeline."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES


def queries() -> dict:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
