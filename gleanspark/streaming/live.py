"""Live sessions as Structured Streaming queries: sampling, rolling windows, states, telemetry, event fan-out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanspark.operators import asof, commits

WINDOW = 20


def newest_per_tick(frames: DataFrame, session: str, time: str, fps: float) -> DataFrame:
    """Of each session and tick of 1/fps seconds (fps cut to 0.1..5) only the newest frame: session, tick, and the frame's columns.

    Works on streams (with a watermark on ``time``) and on tables alike.
    """
    width = f"{int(1000 / min(max(fps, 0.1), 5.0))} milliseconds"
    others = [c for c in frames.columns if c != session]
    newest = F.max_by(F.struct(*others), F.struct(F.col(time), F.xxhash64(*others))).alias("newest")
    return frames.groupBy(session, F.window(time, width).alias("tick")).agg(newest).select(session, F.col("tick.start").alias("tick"), "newest.*")


def rolling(frames: DataFrame, session: str, order: str, value: str, rows: int = WINDOW) -> DataFrame:
    """session, order, value, rolling_mean, n over the last ``rows`` rows of each session, as a stream of one row per frame.

    The state holds at most ``rows`` pairs per session. Rows of a micro-batch are taken in order; a row older than
    what was emitted joins the window in the order of arrival.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    out = f"{session} {kinds[session]}, {order} {kinds[order]}, {value} double, rolling_mean double, n long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values([order])
        means, sizes = [], []
        for x in pdf[value]:
            held = [*held, float(x)][-rows:]
            means.append(sum(held) / len(held))
            sizes.append(len(held))
        state.update((held,))
        yield pd.DataFrame({session: key[0], order: pdf[order].to_numpy(), value: pdf[value].astype(float).to_numpy(), "rolling_mean": means, "n": sizes})

    slim = frames.select(session, order, F.col(value).cast("double").alias(value))
    return slim.groupBy(session).applyInPandasWithState(step, out, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def state_changes(statuses: DataFrame, session: str, order: str, status: str = "status") -> DataFrame:
    """The rows at which a session's status differs from the one before, as a stream; repeats emit nothing."""
    kinds = {f.name: f.dataType.simpleString() for f in statuses.schema.fields}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values([order])
        rows = []
        for t, s in zip(pdf[order], pdf[status], strict=True):
            if s != last:
                rows.append((key[0], t, s))
                last = s
        state.update((last,))
        yield pd.DataFrame(rows, columns=[session, order, status])

    out = f"{session} {kinds[session]}, {order} {kinds[order]}, {status} string"
    return statuses.select(session, order, status).groupBy(session).applyInPandasWithState(step, out, "last string", "append", GroupStateTimeout.NoTimeout)


def session_status(since_frame: Column, connected: Column, ended: Column, lost_after: float = 5.0) -> Column:
    """connecting, live, stream_lost, reconnecting or ended, from the seconds since the last frame (null: none yet)."""
    return (
        F.when(ended, "ended")
        .when(since_frame.isNull(), "connecting")
        .when(since_frame <= lost_after, "live")
        .when(connected, "reconnecting")
        .otherwise("stream_lost")
    )


def sessions(signals: DataFrame, session: str, time: str, ended: str, lost_after: float = 5.0, first_wait: float = 2.0, most_wait: float = 15.0) -> DataFrame:
    """session, status, attempt, wait_sec, last_frame: the changes of live sessions, as a stream that goes on while none of their frames come.

    signals: session, time (of a frame; null: the session is announced), ended (true: it is over). A session is connecting until its first frame, and then live. Without a frame
    for lost_after seconds by the clock it is stream_lost; from then on every wait that runs out is an attempt to reconnect, the waits double up to most_wait, and a frame makes the
    session live and the waits short again. A session that ended keeps no state.
    """
    kinds = {f.name: f.dataType.simpleString() for f in signals.schema.fields}

    def wait(state: GroupState, seconds: float) -> float:
        state.setTimeoutDuration(max(1, int(1000 * seconds)))
        return seconds

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempt, last = state.get if state.exists else (None, 0, None)
        rows = []
        if state.hasTimedOut:
            if status == "live":
                status, attempt = "stream_lost", 0
            elif status != "connecting":
                status, attempt = "reconnecting", attempt + 1
            pause = wait(state, min(first_wait * 2**attempt, most_wait) if status != "connecting" else lost_after)
            state.update((status, attempt, last))
            if status != "connecting":
                rows.append((key[0], status, attempt, pause, last))
        else:
            pdf = pd.concat(list(batches))
            frames = pdf[time].dropna()
            if status is None and frames.empty:
                status = "connecting"
                rows.append((key[0], status, 0, None, None))
            if not frames.empty:
                last = max(frames.max().timestamp(), last or 0.0)
                if status != "live":
                    status, attempt = "live", 0
                    rows.append((key[0], status, 0, None, last))
            if pdf[ended].fillna(False).astype(bool).any():
                rows.append((key[0], "ended", 0, None, last))
                if state.exists:
                    state.remove()
            else:
                state.update((status, attempt, last))
                wait(state, lost_after)
        yield pd.DataFrame(rows, columns=[session, "status", "attempt", "wait_sec", "last_frame"])

    out = f"{session} {kinds[session]}, status string, attempt int, wait_sec double, last_frame double"
    slim = signals.select(session, time, ended)
    return slim.groupBy(session).applyInPandasWithState(step, out, "status string, attempt int, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def save_areas(areas: DataFrame, readings: DataFrame, path: str, session: str = "session_id", time_ms: str = "ts_ms", ident: str = "area_id"):  # noqa: ANN201
    """A stream writer of saved areas, each with the reading of its session that was nearest when it was saved (within 2 s), into a table of committed batches.

    A batch that is replayed, by the same query or after a restart from its checkpoint, changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        commits.commit_batch(with_telemetry(batch, readings, session, time_ms, ident), path, f"{number:012d}")

    return areas.writeStream.foreachBatch(each)


def with_telemetry(frames: DataFrame, readings: DataFrame, session: str, frame_ms: str, frame_id: str, reading_ms: str = "timestamp_ms") -> DataFrame:
    """Frames with the nearest reading of their session within 2 s and its tier: one join per frame, not one per zone. For tables and micro-batches."""
    best = asof.nearest_within(frames, readings, [session], frame_ms, reading_ms, frame_id, [], 2000)
    return best.withColumn("availability", asof.tier(F.col("delta")))


def stream_telemetry(frames: DataFrame, readings: DataFrame, session: str, frame_time: str, reading_time: str) -> DataFrame:
    """Stream-stream join of frames (watermarked on frame_time) with all readings within 2 s: candidates for the nearest one."""
    left, right = frames.alias("f"), readings.alias("r")
    near = F.expr(f"r.{reading_time} BETWEEN f.{frame_time} - INTERVAL 2 SECONDS AND f.{frame_time} + INTERVAL 2 SECONDS")
    return left.join(right, (F.col(f"f.{session}") == F.col(f"r.{session}")) & near)


def hourly(events: DataFrame, time: str, keys: list[str], value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per event-time window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def fan_out(events: DataFrame, sink: Callable[[DataFrame, int], None], session: str = "session_id", order: str = "ts", most: int = 256):  # noqa: ANN201
    """A stream writer that hands each micro-batch, per session at most ``most`` of its oldest rows, to sink: a full queue drops the newest."""
    from gleanspark.operators.tracks import top_per_group

    def each(batch: DataFrame, number: int) -> None:
        sink(top_per_group(batch, [session], [F.col(order)], most).drop("nth"), number)

    return events.writeStream.foreachBatch(each)


def latest_state(events: DataFrame, session: str, kind: str, payload: str, order: str) -> DataFrame:
    """session, kind, payload: the last event of each kind wins."""
    return events.groupBy(session, kind).agg(F.max_by(payload, order).alias(payload))
