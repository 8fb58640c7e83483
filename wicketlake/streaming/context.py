"""Conversation context that expires after an hour without a turn."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_MINUTES = 60
FIELDS = ("player", "team", "season", "format", "action")


def sessions(turns: DataFrame, key: str, at: str, minutes: int = TTL_MINUTES) -> DataFrame:
    """Turns of a key grouped into sessions that end after ``minutes`` without one."""
    window = F.session_window(at, f"{minutes} minutes")
    grouped = turns.groupBy(key, window).agg(F.count(F.lit(1)).alias("turns"))
    return grouped.select(
        key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires"), "turns"
    )


def _next_turns(key, batches, state: GroupState, ttl_us: int, fields: list[str]):
    if state.hasTimedOut:
        state.remove()
        return
    *known, updated = state.get if state.exists else (*[None] * len(fields), None)
    rows = pd.concat(list(batches)).sort_values(["at_us", "turn_id"], kind="stable")
    before = []
    for at_us, *named in zip(rows["at_us"], *[rows[f] for f in fields]):
        if updated is not None and at_us - updated > ttl_us:
            known = [None] * len(fields)
        before.append(known)
        known = [new if isinstance(new, str) and new else old for new, old in zip(named, known)]
        updated = int(at_us)
    state.update((*known, updated))
    state.setTimeoutTimestamp(max((updated + ttl_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    columns = {f"known_{f}": [row[n] for row in before] for n, f in enumerate(fields)}
    yield pd.DataFrame({"session_key": key[0], "turn_id": rows["turn_id"].to_numpy(), **columns})


def known_ddl(fields: Sequence[str]) -> str:
    return "session_key string, turn_id bigint" + "".join(f", known_{f} string" for f in fields)


def known_subjects(stream: DataFrame, fields: Sequence[str] = FIELDS, minutes: int = TTL_MINUTES) -> DataFrame:
    """What is known before each turn, a column ``known_<field>`` for each of ``fields``.

    ``stream``: (``session_key``, ``turn_id``, ``at`` timestamp and the fields, null where a turn names none). State
    is one small row per key, dropped by an event-time timer. A key's turns of one trigger are ordered in memory, so
    bound the trigger (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) on heavy streams.
    """
    ttl_us, names = minutes * 60_000_000, list(fields)

    def step(key, batches, state):
        return _next_turns(key, batches, state, ttl_us, names)

    timed = stream.withWatermark("at", f"{minutes} minutes").withColumn("at_us", F.unix_micros("at"))
    held = "".join(f"{f} string, " for f in names) + "updated_us bigint"
    return timed.groupBy("session_key").applyInPandasWithState(step, known_ddl(names), held, "append", GroupStateTimeout.EventTimeTimeout)
