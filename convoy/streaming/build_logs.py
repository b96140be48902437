"""Build logs as they arrive: the last lines of each live build, and diagnostics at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from convoy.functions.text import trimmed
from convoy.operators.builds import build_log_flags

#: Lines of a build that the state holds.
TAIL = 10
TAIL_SCHEMA = "build_id string, run string, n_lines long, numbers array<long>, lines array<string>"
_STATE = "run string, n_lines long, numbers array<long>, lines array<string>"
#: How long a build's state outlives its last line.
KEPT_MS = 600_000
#: What a stream with such state needs of its session.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # State that expires by the clock asks for a batch after each batch, and a run over what there is now would never end.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
_INHERITED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")


def stream_diagnostics(lines: DataFrame) -> DataFrame:
    """Diagnostic lines of a stream (or a table) as they come; no state."""
    return build_log_flags(lines).where("is_diagnostic")


class Tails(StatefulProcessor):
    """The last lines of one build, and how many it had. A build that comes again after its state went is another run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", _STATE, ttlDurationMs=KEPT_MS)

    def handleInputRows(self, key: tuple[str], rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        run, n, numbers, texts = self.tail.get() if self.tail.exists() else (uuid.uuid4().hex, 0, [], [])
        held = list(zip(numbers, texts, strict=True))
        for pdf in rows:
            n += len(pdf)
            held = sorted(held + list(zip(pdf["line_no"].tolist(), pdf["line"].tolist(), strict=True)))[-TAIL:]
        numbers, texts = [int(i) for i, _ in held], [t for _, t in held]
        self.tail.update((run, n, numbers, texts))
        yield pd.DataFrame({"build_id": [key[0]], "run": [run], "n_lines": [n], "numbers": [numbers], "lines": [texts]})

    def close(self) -> None:
        pass


def stream_build_tails(lines: DataFrame) -> DataFrame:
    """(build_id, run, n_lines, numbers, lines) at each trigger that brings lines: lines that aren't blank, and the last ten of them.

    The state is ten lines per build and goes ten minutes after a build's last line. Order is
    by line number, so late lines find their place and no watermark is needed. The trigger's
    interval is the throttle. The stream's session needs SETTINGS.
    """
    solid = lines.where(trimmed(F.col("line")) != "").select(F.col("build_id").cast("string").alias("build_id"), F.col("line_no").cast("long").alias("line_no"), "line")
    return solid.groupBy("build_id").transformWithStateInPandas(Tails(), TAIL_SCHEMA, "update", "processingTime")


def latest_tails(spark: SparkSession, lines: Callable[[SparkSession], DataFrame], folder: str) -> DataFrame:
    """(build_id, n_lines, tail): each build's last lines after all that a stream has now.

    lines: makes the stream in a session given to it, which is one of its own, so that spark's settings stay. Progress
    and updates are kept below folder: called again, it goes on where it stopped, and a batch that
    is done again replaces what it wrote. Runs of a build whose state went between calls are put together.
    """
    own = spark.newSession()
    for key in _INHERITED:
        if (value := spark.conf.get(key, None)) is not None:
            own.conf.set(key, value)
    for key, value in SETTINGS.items():
        own.conf.set(key, value)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    # So that there is a table before the first line.
    own.createDataFrame([], TAIL_SCHEMA).write.mode("ignore").parquet(f"{folder}/updates/batch=-1")
    writer = stream_build_tails(lines(own)).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    updates = spark.read.schema(f"{TAIL_SCHEMA}, batch int").parquet(f"{folder}/updates")
    runs = updates.groupBy("build_id", "run").agg(F.max("n_lines").alias("n"), F.max_by(F.arrays_zip("numbers", "lines"), "n_lines").alias("held"))
    builds = runs.groupBy("build_id").agg(F.sum("n").alias("n_lines"), F.array_sort(F.flatten(F.collect_list("held"))).alias("held"))
    kept = F.slice("held", F.greatest(F.size("held") - TAIL + 1, F.lit(1)), F.lit(TAIL))
    return builds.select("build_id", "n_lines", F.array_join(F.transform(kept, lambda i: i["lines"]), "\n").alias("tail"))
