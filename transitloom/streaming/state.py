"""Keyed streaming operators: state per vehicle or frame, in arrival order inside a micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from transitloom import constants as C


def throttled_medians(readings: DataFrame, interval_ms: int = 3000, rows: int = 5) -> DataFrame:
    """Median of the last ``rows`` counts per vehicle, at most once per interval of event time.

    Input: bus_id, event_id, ms, passengers. State: the last counts and the time of the last output.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        out = []
        for event_id, ms, count in _ordered(batches, ["event_id", "ms", "passengers"], ["ms", "event_id"]):
            counts = (counts + [int(count)])[-rows:]
            if last is None or ms - last >= interval_ms:
                last = int(ms)
                out.append((event_id, key[0], last, int(round(float(pd.Series(counts).median())))))
        state.update((counts, last))
        yield pd.DataFrame(out, columns=["event_id", "bus_id", "ms", "passengers"])

    return readings.groupBy("bus_id").applyInPandasWithState(
        step, "event_id BIGINT, bus_id STRING, ms BIGINT, passengers BIGINT", "counts ARRAY<BIGINT>, last BIGINT", "append", GroupStateTimeout.NoTimeout
    )


def inter_arrivals(messages: DataFrame, key: str = "bus_id") -> DataFrame:
    """Time since the previous message of the key; state is the last time seen."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for event_id, ms in _ordered(batches, ["event_id", "ms"], ["ms", "event_id"]):
            out.append((event_id, group[0], int(ms), None if last is None else int(ms) - last))
            last = int(ms)
        state.update((last,))
        frame = pd.DataFrame(out, columns=["event_id", key, "ms", "inter_arrival_ms"])
        yield frame.astype({"inter_arrival_ms": "Int64"})

    return messages.groupBy(key).applyInPandasWithState(
        step, f"event_id BIGINT, {key} STRING, ms BIGINT, inter_arrival_ms BIGINT", "last BIGINT", "append", GroupStateTimeout.NoTimeout
    )


def latest_with_ttl(readings: DataFrame, ttl_ms: int = C.LIVE_TTL_SECS * 1000) -> DataFrame:
    """Changes of the newest reading per vehicle; the state goes away when nothing arrives for the TTL.

    The input needs a watermark on its event time column ``at``. Output rows are upserts, with a null
    count when the reading has expired.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ms = state.get[0]
            state.remove()
            yield pd.DataFrame({"bus_id": [key[0]], "ms": [ms], "passengers": pd.array([None], dtype="Int64")})
            return
        best = state.get if state.exists else None
        for ms, event_id, count in _ordered(batches, ["ms", "event_id", "passengers"], ["ms", "event_id"]):
            if best is None or (ms, event_id) > (best[0], best[1]):
                best = (int(ms), int(event_id), max(0, int(count)))
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"bus_id": [key[0]], "ms": [best[0]], "passengers": pd.array([best[2]], dtype="Int64")})

    return readings.groupBy("bus_id").applyInPandasWithState(
        step, "bus_id STRING, ms BIGINT, passengers BIGINT", "ms BIGINT, event_id BIGINT, passengers BIGINT", "update", GroupStateTimeout.EventTimeTimeout
    )


def assemble_frames(chunks: DataFrame, timeout_ms: int = 240000) -> DataFrame:
    """Joins chunk messages to frames as they complete; the batch twin is ``telemetry.assemble_chunks``.

    Input: checked chunks (``valid`` true) with a watermark on the event time column ``at``. One frame is
    at most two mebibytes, so its state is small. A finished frame keeps only its status, so late
    copies are ignored until the timeout removes it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["frame_id", "status", "body"]
        if state.hasTimedOut:
            open_frame = state.get[0] == "open"
            state.remove()
            yield pd.DataFrame([(key[0], "expired", None)] if open_frame else [], columns=columns)
            return
        status, total, length, bodies = (state.get[0], state.get[1], state.get[2], dict(zip(state.get[3], state.get[4]))) if state.exists else ("open", None, None, {})
        out = []
        for index, chunks_total, total_len, body, _ in _ordered(
            batches, ["chunk_index", "total_chunks", "total_len", "body", "seen"], ["seen", "chunk_index", "total_chunks", "total_len", "body"]
        ):
            if status != "open":
                continue
            if total is None:
                total, length = int(chunks_total), int(total_len)
            if (total, length) != (chunks_total, total_len) or bodies.get(index, body) != body:
                status, bodies = "dropped", {}
                out.append((key[0], status, None))
                continue
            bodies[int(index)] = body
            if len(bodies) == total:
                out.append((key[0], "completed", "".join(bodies[i] for i in range(total))))
                status, bodies = "completed", {}
        state.update((status, total, length, list(bodies), list(bodies.values())))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + timeout_ms)
        yield pd.DataFrame(out, columns=columns)

    return chunks.groupBy("frame_id").applyInPandasWithState(
        step, "frame_id BIGINT, status STRING, body STRING", "status STRING, total INT, length INT, indexes ARRAY<INT>, bodies ARRAY<STRING>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def _ordered(batches: Iterator[pd.DataFrame], columns: list[str], order: list[str]) -> Iterator[tuple]:
    """Rows of one key in one micro-batch, in event order."""
    frames = list(batches)
    if frames:
        yield from pd.concat(frames).sort_values(order)[columns].itertuples(index=False, name=None)
