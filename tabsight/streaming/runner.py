"""Running a stream to completion over the files present (``availableNow``), with
or without an end marker behind them, and the JSONL preference sink."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path


def run_available(spark: SparkSession, stream: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Process everything available, write it to a new folder under the shared
    checkpoint folder (with its own streaming checkpoint), return it as a
    batch DataFrame."""
    tag = f"{name}-{uuid.uuid4().hex}"
    out = scratch_path(spark, f"{tag}/out")
    ckpt = scratch_path(spark, f"{tag}/checkpoint")
    q = (
        stream.writeStream.format(fmt)
        .option("path", out)
        .option("checkpointLocation", ckpt)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if fmt == "json":
        return spark.read.schema(stream.schema).json(out)
    return spark.read.schema(stream.schema).parquet(out)


#: Event time of the marker: after any event.
END = datetime.datetime(2200, 1, 1)


class EndMarker:
    """A second source beside a stream of files, for inputs that end: once all is read,
    a row with no values but a time after any event moves the watermark, and what
    the query still holds is released. Without it the last rows stay held, as they
    must while more may come."""

    def __init__(self, source: DataFrame, time: str = "ts"):
        self.spark, self.schema, self.time = source.sparkSession, source.schema, time
        self.folder = scratch_path(self.spark, f"end-{uuid.uuid4().hex}")
        self.spark.createDataFrame([], self.schema).write.parquet(self.folder)
        self.stream = source.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def run(self, start: Callable[[], StreamingQuery]) -> None:
        """``start`` starts the query over :attr:`stream`, each time with the same
        checkpoint: over all files, then over the marker."""
        start().awaitTermination()
        row = [END if f.name == self.time else None for f in self.schema.fields]
        self.spark.createDataFrame([row], self.schema).write.mode("append").parquet(self.folder)
        start().awaitTermination()


def run_to_end(spark: SparkSession, source: DataFrame, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``build(source)`` over everything there is and the end of it, as a batch DataFrame."""
    marker = EndMarker(source)
    stream = build(marker.stream)
    tag = f"{name}-{uuid.uuid4().hex}"
    out, ckpt = scratch_path(spark, f"{tag}/out"), scratch_path(spark, f"{tag}/checkpoint")
    write = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
    marker.run(lambda: write.outputMode("append").trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(out)


def commit_lines(lines: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Write one micro-batch of JSON lines as the folder ``run=<run>/batch=<batch_id>``
    of a log, in place of what an earlier try of the same batch left there."""
    folder = f"{path}/run={run}/batch={batch_id:012d}"
    lines.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def write_preference_stream(
    samples: DataFrame, path: str, checkpoint: str, enabled: bool = True, available_now: bool = False
):
    """Append resolved samples to the JSONL log as they resolve (nulls kept), each
    micro-batch under the query's id and its own number: a batch that is run again
    after a failure replaces its lines, and any reader of the files sees them once.
    Queries of other checkpoints add to the same log. Returns the started query, or
    None when logging is disabled."""
    from ..operators.preferences import to_log_records

    if not enabled:
        return None

    def commit(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not run:
            raise RuntimeError("a micro-batch without the id of its query")
        commit_lines(batch, path, run, batch_id)

    w = to_log_records(samples).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
