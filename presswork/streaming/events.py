"""The event stream: validation with a dead-letter branch, conflict-aware deduplication, keyed profile state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from presswork.functions import scores
from presswork.operators import profile

STATE = "short_positive double, short_negative double, long_positive double, long_negative double, positive_evidence long, negative_evidence long, last_event_ts long"
#: Groups of keys whose profiles lie together in the state of a stream; a checkpoint is good for one number only.
BUCKETS = 4096
_NEVER = -(1 << 62)
_HALF_LIVES = np.array([profile.SHORT_HALF_LIFE] * 2 + [profile.LONG_HALF_LIFE] * 2, np.float64)
#: key: user, topic, and which of these are null (1, 2); scores and counts as in STATE; last: _NEVER without a time.
_RECORD = np.dtype([("key", "<i8", 3), ("scores", "<f8", 4), ("counts", "<i8", 2), ("last", "<i8")])


def fingerprint(columns: list[str]) -> F.Column:
    """What an event says, without its times: the same event sent again has the same."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def claim_events(events: DataFrame, content: list[str], time: str | None = None, keep: int = 172_800) -> DataFrame:
    """Adds outcome: first, duplicate (an event of its id with the same content came before) or conflict (with other
    content). State is one fingerprint per event id; within a batch, rows count in order of arrival,
    and an id's rows of the batch are held together.

    With time (a timestamp column, which becomes the watermark's), an id is forgotten `keep` seconds after its last event
    by the watermark, so that state holds the ids of that stretch only; the same id after it is a first event again.
    Events that come later than `keep` behind the newest one are dropped, as nothing is known of their id any more.
    Without time, ids are kept for ever.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    columns = list(events.columns)

    def claim(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, newest = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts))  # Arrow hands out a busy id's rows in several parts, in no order
        rows = rows.sort_values("arrival") if "arrival" in columns else rows
        outcome = []
        for mark in rows["_fingerprint"]:
            outcome.append("first" if known is None else "duplicate" if mark == known else "conflict")
            known = known or mark
        if time:
            newest = max(newest, int(rows[time].max().timestamp() * 1000))
        yield rows[columns].assign(outcome=outcome)
        state.update((known, newest))
        if time:
            state.setTimeoutTimestamp(max(newest + keep * 1000, state.getCurrentWatermarkMs() + 1))

    marked = events.withColumn("_fingerprint", fingerprint(content))
    if time:
        marked = marked.withWatermark(time, f"{keep} seconds")
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", outcome string"
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return marked.groupBy("event_id").applyInPandasWithState(claim, schema, "fingerprint string, newest long", "append", timeout)


def profile_state(events: DataFrame) -> DataFrame:
    """The decayed profile of each (user_id, topic_id) after each batch. Late events of a key change nothing; events without
    a time count as evidence only.

    A call of Python costs milliseconds, so keys are not called for one by one: state is kept by one of BUCKETS hashes of the
    key, as packed records of the bucket's keys, and a bucket's events of a batch are folded together, Arrow batch by batch.
    """
    names = [c.split()[0] for c in STATE.split(", ")]

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = np.frombuffer(bytes(state.get[0]), _RECORD) if state.exists else np.empty(0, _RECORD)
        keys, scores_, counts, last = (known[c].copy() for c in ("key", "scores", "counts", "last"))
        since, touched = last, np.zeros(len(known), bool)  # late is what lies before the batches so far; within a batch a key's parts come in no order
        for rows in parts:
            part = rows[["user", "topic", "nulls"]].to_numpy(np.int64)
            n, (whole, at) = len(keys), np.unique(np.r_[keys, part], axis=0, return_inverse=True)
            at, keys = at.reshape(-1), whole

            def moved(old, fill, n=n, at=at, m=len(whole)):
                new = np.full((m, *old.shape[1:]), fill, old.dtype)
                new[at[:n]] = old
                return new

            scores_, counts, before, since, touched = moved(scores_, 0), moved(counts, 0), moved(last, _NEVER), moved(since, _NEVER), moved(touched, False)
            at, ts, d = at[n:], rows["event_ts"].to_numpy(), rows["strength"].to_numpy()
            touched[at] = True
            timely = (ts >= since[at]) | (ts == _NEVER)
            at, ts, d = at[timely], ts[timely], d[timely]
            last = before.copy()
            np.maximum.at(last, at, ts)
            age = np.where(before == _NEVER, 0, last - before)
            scores_ = scores_ * 2.0 ** (-age[:, None] / _HALF_LIVES)
            timed = ts != _NEVER
            back = np.where(timed, last[at] - ts, 0)
            for j, (sign, factor) in enumerate(((1, 1.0), (-1, 1.0), (1, profile.LONG_FACTOR), (-1, profile.LONG_FACTOR))):
                scores_[:, j] += np.bincount(at, timed * factor * np.maximum(sign * d, 0.0) * 2.0 ** (-back / _HALF_LIVES[j]), len(whole))
            counts[:, 0] += np.bincount(at, d > 0, len(whole)).astype(np.int64)
            counts[:, 1] += np.bincount(at, d < 0, len(whole)).astype(np.int64)
        packed = np.empty(len(keys), _RECORD)
        packed["key"], packed["scores"], packed["counts"], packed["last"] = keys, scores_, counts, last
        state.update((packed.tobytes(),))
        out = packed[touched]
        whole_number = lambda x, null: pd.Series(pd.arrays.IntegerArray(x.copy(), null))
        timeless = out["last"] == _NEVER
        columns = [whole_number(out["key"][:, 0], out["key"][:, 2] % 2 == 1), whole_number(out["key"][:, 1], out["key"][:, 2] >= 2), *np.where(timeless[:, None], np.nan, out["scores"]).T, *out["counts"].T, whole_number(out["last"], timeless)]
        yield pd.DataFrame(dict(zip(["user_id", "topic_id", *names], columns, strict=True)))

    rows = events.withColumn("strength", scores.event_strength(F.col("event_type"), F.col("dwell_ms"))).where("strength <> 0")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    nulls = F.col("user_id").isNull().cast("long") + 2 * F.col("topic_id").isNull().cast("long")
    bucket = F.pmod(F.xxhash64("user_id", "topic_id"), F.lit(BUCKETS)).cast("int")
    rows = rows.select(bucket.alias("bucket"), number("user_id").alias("user"), number("topic_id").alias("topic"), nulls.alias("nulls"), F.coalesce(F.col("event_ts").cast("long"), F.lit(_NEVER)).alias("event_ts"), F.col("strength").cast("double").alias("strength"))
    return rows.groupBy("bucket").applyInPandasWithState(fold, f"user_id long, topic_id int, {STATE}", "records binary", "update", GroupStateTimeout.NoTimeout)


def split_valid(events: DataFrame, violations: F.Column) -> tuple[DataFrame, DataFrame]:
    """Events that keep the contract, and the others as dead letters: their JSON in base64 and what is wrong."""
    rows = events.withColumn("_v", violations)
    dead = rows.where("_v <> ''").select(F.base64(F.encode(F.to_json(F.struct(*events.columns)), "utf-8")).alias("payload"), F.col("_v").alias("error"))
    return rows.where("_v = ''").drop("_v"), dead


def run_to_end(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs a stream over what there is into Parquet files, each batch in a folder of its own, and reads them.

    A batch that is run again replaces its folder, so a restart changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch_id={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/rows").drop("batch_id")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key over all batches."""
    newest = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return rows.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k", "batch")


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and dwell per window and type, closed by a watermark; windows overlap if they slide. events: ts (timestamp),
    event_type, dwell_ms."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window.alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("dwell_ms").alias("dwell_ms"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no farther apart than the gap; closed by a watermark. events: ts, user_id."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n"))
