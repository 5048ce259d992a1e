"""The enrichment job as a bounded run of a stream."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from jobreview.operators.dedupe import EVENT_KEYS
from jobreview.plans.enrichment import EnrichmentOptions, enrich
from jobreview.session import build_session
from jobreview.sources.tables import read_event_stream


def append_stream(
    df: DataFrame,
    *,
    checkpoint_path: str,
    table: str | None = None,
    path: str | None = None,
    sink_format: str = "parquet",
) -> StreamingQuery:
    """Appends everything now available to a table or a folder, then ends.

    The query is returned; the caller awaits it.
    """
    if (table is None) == (path is None):
        raise ValueError("give exactly one of table and path")
    writer = (
        df.writeStream.format(sink_format)
        .outputMode("append")
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
    )
    return writer.toTable(table) if table is not None else writer.start(path)


def start_enrichment(
    spark: SparkSession, overrides: dict | None = None, *, as_of: Column | None = None
) -> StreamingQuery:
    """Reads the event table as a stream, enriches it, appends to the target.

    Without a ``checkpoint_path`` the checkpoint goes to a folder named after
    the target below the cluster's shared folder, so that the next run resumes.
    The first start fixes the number of state partitions: set
    ``spark.sql.shuffle.partitions`` for the state to come, not for one batch.
    """
    options = EnrichmentOptions().with_overrides(overrides).checked()
    events = read_event_stream(
        spark,
        table=options.source_table,
        source_format=options.source_format,
        **options.admission_caps(),
    )
    profiles = spark.table(options.profile_dim_table) if options.enable_profile_join else None
    to_path = options.target_path is not None
    return append_stream(
        enrich(events, profiles, options, as_of=as_of),
        checkpoint_path=options.checkpoint_path or default_checkpoint(spark, options),
        table=None if to_path else options.target_table,
        path=options.target_path,
        sink_format=options.target_format,
    )


def default_checkpoint(spark: SparkSession, options: EnrichmentOptions) -> str:
    """Never a new folder: a second run would append every row again."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set checkpoint_path or spark.checkpoint.dir")
    target = (options.target_path or options.target_table or "enriched").strip("/")
    return f"{shared.rstrip('/')}/enrichment-checkpoint/{target.replace('/', '_').replace(':', '_')}"


def run_enrichment(
    spark: SparkSession, overrides: dict | None = None, *, as_of: Column | None = None
) -> StreamingQuery:
    """``start_enrichment``, awaited; a failed stream raises here."""
    query = start_enrichment(spark, overrides, as_of=as_of)
    query.awaitTermination()
    return query


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks drop, over all batches of all runs.

    Add it before a query starts (``spark.streams.addListener``). A query keeps
    only its latest progress reports; the listener hears each one.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event):
        self.dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event):
        run = str(event.progress.runId)
        late = sum(operator.numRowsDroppedByWatermark for operator in event.progress.stateOperators)
        self.dropped[run] = self.dropped.get(run, 0) + late

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.add(str(event.runId))

    def of(self, query: StreamingQuery, timeout: float = 60.0) -> int:
        """Rows dropped in this run of an ended query: reports arrive on their
        own thread, its end last."""
        run, until = str(query.runId), time.monotonic() + timeout
        while run not in self.ended:
            if time.monotonic() > until:
                raise TimeoutError("no end of the query was reported")
            time.sleep(0.05)
        return self.dropped.get(run, 0)


def late_rows(query: StreamingQuery) -> int:
    """Rows a watermark dropped, over the recent progress reports only: those the
    session keeps (``spark.sql.streaming.numRecentProgressUpdates`` of them).
    ``LateRows`` counts all, and ``not_in_sink`` lists them."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


def not_in_sink(admitted: DataFrame, sink: DataFrame, keys: Sequence[str] = EVENT_KEYS) -> DataFrame:
    """The rows a stream read and no row of whose key reached its sink: what a
    watermark dropped, as a table.

    ``admitted`` is a batch read of what the stream has read, with the stream's
    own steps before the watermark applied; run it when the stream has ended. NULL
    keys count as keys.
    """
    there = sink.select([F.col(name).alias(f"_sink_{name}") for name in keys]).distinct()
    same = reduce(and_, [F.col(name).eqNullSafe(F.col(f"_sink_{name}")) for name in keys])
    return admitted.join(there.hint("merge"), same, "left_anti")


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows held in state after each reported batch."""
    return [
        sum(operator["numRowsTotal"] for operator in progress["stateOperators"])
        for progress in query.recentProgress
    ]


if __name__ == "__main__":
    run_enrichment(build_session("enrichment"))
