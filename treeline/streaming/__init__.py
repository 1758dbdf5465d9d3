"""Checks of document streams. A document's rules need nothing but the document, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.plans.documents import Options, violations
from treeline.schema.model import Module


def stream_violations(docs: DataFrame, module: Module, options: Options | None = None, id_col: str = "doc_id", text_col: str = "doc") -> DataFrame:
    """Violations of a stream of documents, as a stream."""
    return violations(docs, module, options, id_col, text_col)


def windowed_counts(found: DataFrame, time_col: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Violations per rule and time window; windows close once the watermark has passed them."""
    return found.withWatermark(time_col, late).groupBy(F.window(time_col, width), "rule").agg(F.count(F.lit(1)).alias("violations"))
