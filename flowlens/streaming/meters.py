"""Counters of a running stream: rows in and out, rows dropped as late, throughput.

Rows are counted where they pass by ``Dataset.observe``, so counting costs no pass of its
own; what a stateful operator drops behind the watermark, Spark reports per micro-batch.
``Counters`` adds up the reports of one query or, as a listener, of all queries of a session.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def counted(df: DataFrame, name: str, **more: Column) -> DataFrame:
    """``df`` with its rows counted under ``name``, and further aggregates beside them."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in more.items()])


@dataclass
class Totals:
    """Sums over micro-batches: rows read, rows dropped as late by stateful operators, milliseconds, observed counts."""

    batches: int = 0
    rows_in: int = 0
    rows_late: int = 0
    millis: int = 0
    observed: dict[str, int] = field(default_factory=lambda: defaultdict(int))

    def rows_per_second(self) -> float:
        return 1000.0 * self.rows_in / self.millis if self.millis else 0.0

    def add(self, progress) -> None:
        """Take in the report of one micro-batch."""
        self.batches += 1
        self.rows_in += max(progress.numInputRows or 0, 0)
        self.rows_late += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        self.millis += progress.batchDuration or 0
        for name, row in (progress.observedMetrics or {}).items():
            for k, v in row.asDict().items():
                self.observed[f"{name}.{k}"] += v or 0


class Counters(StreamingQueryListener):
    """Totals per query name (or id); safe to read while queries run."""

    def __init__(self):
        self._lock = threading.Lock()
        self._totals: dict[str, Totals] = defaultdict(Totals)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            self._totals[event.progress.name or str(event.progress.id)].add(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def read(self, query: str) -> Totals:
        with self._lock:
            return self._totals[query]


def of_query(query: StreamingQuery) -> Totals:
    """Totals of the reports that a query keeps (its last hundred micro-batches unless the session keeps more)."""
    out = Totals()
    for progress in query.recentProgress:
        out.add(progress)
    return out


def as_row(spark: SparkSession, totals: Totals) -> DataFrame:
    """One row: batches, rows_in, rows_late, rows_per_second, and every observed count as a map."""
    data = [(totals.batches, totals.rows_in, totals.rows_late, totals.rows_per_second(), dict(totals.observed))]
    return spark.createDataFrame(data, "batches long, rows_in long, rows_late long, rows_per_second double, observed map<string,long>")
