"""Upper factors and Gram matrices of streams: R is mergeable, so each micro-batch folds into what is known.

This goes beyond the batch operators: R' = upper([R; batch]) after every micro-batch, by Structured Streaming's
foreachBatch, which replays a batch after a failure; a batch id that was folded already is skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import linalg
from ..operators.factor import tsqr


class StreamingFactor:
    """Keeps R of all rows that a stream has delivered."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self.r = np.zeros((len(self.columns), len(self.columns)))
        self.last = -1

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id > self.last:
            self.r = linalg.upper(np.concatenate([self.r, tsqr(batch, self.columns)]))
            self.last = batch_id

    def start(self, stream: DataFrame, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
        """Fold a streaming DataFrame; with once, all that is there now and then stop."""
        writer = stream.writeStream.foreachBatch(self.fold)
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
