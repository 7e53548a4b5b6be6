"""Streaming.

The reference reads one file eagerly and has no streaming operators (no
watermarks, windows or state), so none are built. What carries over is that
every prep rule is a stateless column expression: once fitted on a batch, the
same expressions (and a fitted ``PipelineModel``) apply unchanged to a
``readStream`` DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def apply_to_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a fitted, stateless transformation (prep expressions or
    ``PipelineModel.transform``) to a streaming DataFrame."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return transform(stream)
