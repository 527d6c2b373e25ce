"""A batch of queries, read once.

Every retrieval step needs the same few rows. A batch within the bound is fetched once and becomes
a local relation: later steps start no scan for it, and Spark knows its exact size when it picks
joins. A larger batch stays an ordinary DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BATCH_QUERIES = 4096


@dataclass(frozen=True)
class QueryBatch:
    df: DataFrame
    rows: pa.Table | None = None

    @property
    def bounded(self) -> bool:
        return self.rows is not None


def as_batch(queries: DataFrame | QueryBatch) -> QueryBatch:
    if isinstance(queries, QueryBatch):
        return queries
    rows = queries.limit(MAX_BATCH_QUERIES + 1).toArrow()
    if rows.num_rows > MAX_BATCH_QUERIES:
        return QueryBatch(queries)
    return QueryBatch(queries.sparkSession.createDataFrame(rows, queries.schema), rows)

