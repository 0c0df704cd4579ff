"""Jobs followed through their states by a stream: pending until they end or fall silent, and final then."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a job's events say of it; anything else says that it goes on.
ENDS = ("succeeded", "failed")
_ENDED = "job_id string, state string, at timestamp, events long"
_HELD = "state string, last timestamp, events long"


def job_ends(events: DataFrame, *, silence: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(job_id, state, at, events) of a stream of (job_id, state, at): one row when a job ends, none before and none again.

    A job ends with its first event whose state is one of ENDS, or as ``timed_out`` where ``silence``
    passed since its last event, as the next event or the watermark (``late`` behind the newest event)
    tells. ``events`` counts those up to the end. Only a job's state is kept, by key, in the
    checkpoint: a run that was killed goes on from there and reads nothing that was written. Events of
    a batch are taken in order of time; of equal times an end comes last. Rows without a job or time say nothing.
    """
    gap = pd.Timedelta(silence)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last, count = state.get if state.exists else (None, None, 0)
        ended = None
        if state.hasTimedOut:
            if now is None:
                ended = ("timed_out", pd.Timestamp(last) + gap, count)
        else:
            rows = pd.concat(list(batches))
            rows = rows.assign(ends=rows["state"].isin(ENDS)).sort_values(["at", "ends", "state"], kind="stable")
            for said, at, ends in rows[["state", "at", "ends"]].itertuples(index=False):
                if now is not None or ended is not None:
                    break
                if last is not None and at - pd.Timestamp(last) > gap:
                    ended = ("timed_out", pd.Timestamp(last) + gap, count)
                    break
                last, count = (at if last is None else max(at, pd.Timestamp(last))), count + 1
                if ends:
                    ended = (said, at, count)
        now = ended[0] if ended else now
        state.update((now, pd.Timestamp(last).to_pydatetime(), count))
        if now is None and not state.hasTimedOut:
            # a watermark may have passed that time already; then the next batch ends the job
            state.setTimeoutTimestamp(max(int((pd.Timestamp(last) + gap).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if ended:
            yield pd.DataFrame([(key[0], *ended)], columns=["job_id", "state", "at", "events"])

    known = events.where("job_id is not null and at is not null").select(F.col("job_id").cast("string").alias("job_id"), "state", F.col("at").cast("timestamp").alias("at"))
    return known.withWatermark("at", late).groupBy("job_id").applyInPandasWithState(follow, _ENDED, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def collect_job_ends(spark: SparkSession, events: DataFrame, target: str, checkpoint: str, **options) -> DataFrame:
    """What ``job_ends`` gives for all that is available of a stream, appended to ``target``, which is returned."""
    query = job_ends(events, **options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(_ENDED).parquet(target)
