"""Streaming scoring (R1): score an append-only stream of lines against a model.

Ranking windows are not allowed on a streaming frame, so each micro-batch is
handed to the *same* batch ``predict`` through ``foreachBatch``; it probes the
model's neighbour index, so only its own lines are sorted.  Each micro-batch
writes its own partition (``batch_id=<epoch>``) with overwrite, so a replayed
epoch after a failure replaces its output instead of duplicating it; the
checkpoint location makes the source offsets durable.

The model is fixed, or a ``ServedModel``: then every micro-batch asks the
registry's manifest for the tenants' current versions and loads the model anew
if they have changed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.config import ModelSpec
from ledgerlens.operators import scoring
from ledgerlens.session import materialize
from ledgerlens.sources import registry


@dataclass
class ServedModel:
    """The current model of a registry (C20)."""

    base: str
    spec: ModelSpec
    version: str | None = None      # None: each tenant's latest
    _print: tuple | None = field(default=None, repr=False)
    _model: scoring.Model | None = field(default=None, repr=False)

    def current(self, spark: SparkSession) -> scoring.Model:
        chosen = registry.chosen_runs(registry.manifest(spark, self.base), self.version)
        now = tuple(chosen.agg(F.count(F.lit(1)), F.sum(F.xxhash64("tenant_id", "run_ts", "attempt").cast("decimal(38,0)"))).first())
        if now != self._print:
            self._model, self._print = scoring.load_model(spark, self.base, self.spec, self.version), now
        return self._model


def score_stream(spark: SparkSession, model: scoring.Model | ServedModel, source_dir: str, schema, sink_dir: str,
                 checkpoint_dir: str, *, weights: str | None = None, fmt: str = "parquet",
                 dedupe_col: str | None = None, event_time: str | None = None,
                 watermark: str = "1 day", available_now: bool = True,
                 max_files: int | None = None, with_rejected: bool = False) -> StreamingQuery:
    """Start the stream; returns the running query (``awaitTermination`` for availableNow).

    ``with_rejected`` (C19): lines that no model can score are answered too, in the same epoch:
    every row has ``reason`` (null where there is a prediction) and, of a ``ServedModel``, ``run_ts``.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:  # bounds a micro-batch
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    stream = reader.load(source_dir)
    served = isinstance(model, ServedModel)
    if dedupe_col and event_time:
        if not served and not with_rejected:  # a line of a group without a model has no answer; it must not take the place of one that has
            stream = stream.join(model.stats.select(*model.spec.group_keys).distinct(), list(model.spec.group_keys), "left_semi")
        stream = stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([dedupe_col])

    def score_batch(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        now = model.current(session) if served else model
        batch = materialize(batch, "stream_batch")  # read many times, and a stateful batch is evaluated once only
        _, out = scoring.predict(now, batch, weights)
        if with_rejected:
            out = out.withColumn("reason", F.lit(None).cast("string")).unionByName(scoring.rejected(now, batch), allowMissingColumns=True)
        if served:
            out = out.join(now.runs.select("tenant_id", "run_ts"), "tenant_id", "left")
        out.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={epoch_id}")

    if not served and not model.spec.vector:
        model.neighbor_index()  # once, not in the first micro-batch
    writer = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
