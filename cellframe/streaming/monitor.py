"""Live monitor of convergence: the newest and best chi of every run, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.curves import final_chi

SCHEMA = "run_id string, step long, chi_q double, chi_r double"
#: Rows of logs as they are read: they carry no step, only their file's number and their line.
ROWS = "run_id string, file_no long, line_no long, chi_q double, chi_r double"
STEPS = "run_id string, step long, chi_q double, chi_r double, final_chi double, best_chi double"


def read_chunks(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_epoch: int | None = None) -> DataFrame:
    """Stream of landed Parquet chunks.  Chunks do not change; new rows of a log come as a new chunk, older files first."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    return (reader.option("maxFilesPerTrigger", files_per_epoch) if files_per_epoch else reader).parquet(folder)


def number_steps(rows: DataFrame) -> DataFrame:
    """STEPS of a stream of ROWS: every row with its step, counted over all epochs, and its run's newest and best chi so far.

    State is three numbers a run.  Within an epoch a run's rows are ordered by (file_no, line_no); later epochs follow, so
    chunks of a run must land in order.  NaN is never the best.  A restart from the checkpoint goes on with the counts as they were.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def count(key, frames, state):
        done, best = state.get if state.exists else (0, None)
        own = pd.concat(frames).sort_values(["file_no", "line_no"], kind="stable")
        least = own["chi_r"].cummin().ffill()
        if best is not None:
            least = least.fillna(best).clip(upper=best)
        least = least.astype(object).where(least.notna(), None)
        state.update((done + len(own), least.iloc[-1]))
        yield pd.DataFrame({"run_id": key[0], "step": range(done, done + len(own)), "chi_q": own["chi_q"].array, "chi_r": own["chi_r"].array, "final_chi": own["chi_r"].array, "best_chi": least.array})

    return rows.groupBy("run_id").applyInPandasWithState(count, STEPS, "done long, best double", "append", GroupStateTimeout.NoTimeout)


def start_steps(rows: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """Start numbering; each epoch's rows are one folder below `folder`, which a replay of the epoch writes anew."""

    def sink(frame, epoch):
        frame.write.mode("overwrite").parquet(f"{folder}/epoch_no={epoch}")

    return number_steps(rows).writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def monitor(steps: DataFrame) -> DataFrame:
    """One row per run, for update or complete mode; state grows with the number of runs, not with their steps."""
    return final_chi(steps)


def start(steps: DataFrame, sink, checkpoint: str, trigger: dict | None = None):
    """Start the monitor; sink(frame, epoch) gets the changed runs.  The checkpoint folder makes it restart exactly."""
    return monitor(steps).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
