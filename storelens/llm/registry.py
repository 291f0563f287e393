"""Registered training-data queries and their DuckDB SQL."""

import corpus_pipeline
from storelens.llm.oracles import ORACLES  # noqa: F401
from storelens.llm.queries import QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
