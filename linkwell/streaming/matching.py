"""Incremental matching: each micro-batch of queries is matched against the stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkwell.operators.retrieval import Index, search
from linkwell.operators.segments import SegmentIndex


def match_stream(queries: DataFrame, index: Index | SegmentIndex, sink: Callable[[DataFrame, int], None], checkpoint: str, n: int = 20, boosts: dict[str, float] | None = None, once: bool = False) -> StreamingQuery:
    """Start a stream of (qid, terms) whose best ``n`` documents of the index go to ``sink`` with the batch's number.

    An ``Index`` is built once, by ``build_index`` or ``open_index``, and every batch reads its rows.  Of a ``SegmentIndex``
    a batch reads the newest version, and there the blocks of its own terms alone, so it sees documents that were added
    meanwhile.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            sink(index.search(rows, n, boosts) if isinstance(index, SegmentIndex) else search(rows, index, n, boosts), number)

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
