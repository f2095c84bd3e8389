"""The log normaliser on a stream: the first line seen of a source decides, and the decision sticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from traceloom.plans.loglines import apply_modes, is_record


def normalise_stream(
    lines: DataFrame,
    folder: str,
    *,
    keys: Sequence[str],
    time: Column,
    line_no: str = "line_no",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start normalising a stream of lines into ``folder/output``.

    The lowest-numbered line in the first micro-batch of a source decides. Spark's state store keeps that line per source: an
    aggregate in update mode, which gives the deciding line of just the sources that a batch has lines of. It goes through
    the query side by side with the lines of the batch and is joined to them there, so a batch costs what its lines
    and sources cost, however many sources came before. The state is fed by partial aggregates, and decisions are joined
    to the lines, so a source that sends a third of all lines does not land in one task.

    A batch is put in ``folder/staged``, where the next one replaces it, so that the state is updated once. A batch that is run again
    replaces its own output: each line is written exactly once. A restart continues from ``folder/progress``, decisions included.
    The number of shuffle partitions is fixed by the first start, as for every state store.
    """
    root = folder.rstrip("/")
    # Batches are told apart by their times, which Spark fixes per batch; within a batch the line number counts.
    timed = lines.select(*keys, F.struct("line").alias("_line"), F.col(line_no).alias("_no"), F.unix_micros(F.current_timestamp()).alias("_now"))
    deciding = timed.groupBy(*keys).agg(F.min_by("_line", F.struct("_now", "_no")).alias("_first"))
    types = {f.name: f.dataType for f in lines.schema}
    own = [F.col(c) if c in keys else F.lit(None).cast(types[c]).alias(c) for c in lines.columns]
    decisions = deciding.select(F.struct(*own).alias("_row"), "_first", F.lit(True).alias("_decides"))
    rows = lines.select(
        F.struct(*lines.columns).alias("_row"), F.lit(None).cast(deciding.schema["_first"].dataType).alias("_first"),
        F.lit(False).alias("_decides"),
    )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/staged")
        stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{root}/staged")
        found = stored.filter("_decides").select(
            *[F.col("_row")[k].alias(k) for k in keys], is_record(F.col("_first.line")).alias("passes")
        )
        done = apply_modes(stored.filter("not _decides").select("_row.*"), found, keys, time)
        done.write.mode("overwrite").parquet(f"{root}/output/batch={batch_id}")

    writer = rows.unionByName(decisions).writeStream.foreachBatch(write_batch).outputMode("update")
    writer = writer.option("checkpointLocation", f"{root}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
