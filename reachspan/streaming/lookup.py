"""Lookups for a stream of pairs: a stateless join of the stream with a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reachspan.matrix import BoolMatrix
from reachspan.operators.dindex import query


def answers(index: BoolMatrix, pairs: DataFrame, out_of_range: str = "false") -> DataFrame:
    """The pairs of a stream with `hit`, in append mode; no state is kept, so no watermark is needed."""
    if not pairs.isStreaming:
        raise ValueError("pairs are not a stream; use query")
    return query(index, pairs, out_of_range)
