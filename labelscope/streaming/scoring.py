"""Score a stream of vectors against a static centroid table.

Cosine distance to the own label's centroid and the nearest label are a
projection plus a join with a small static table, so the same expressions
serve a streaming DataFrame (stream-static join; no state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from labelscope.operators.dense import own_distance, unit_vectors


def score_stream(stream: DataFrame, centroids: DataFrame, label: str = "label",
                 vec: str = "embedding") -> DataFrame:
    """Append ``dist`` (1 - cosine to the own label's centroid) to each streamed row."""
    return own_distance(unit_vectors(stream, vec), centroids, label, vec)
