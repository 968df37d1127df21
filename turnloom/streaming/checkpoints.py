"""Growth of usage checkpoints over a stream, with a session's counters as its keyed state.

What ``usage.checkpoint_growth`` says of a whole table, this says of rows as they arrive: Structured Streaming
keeps, for each session, the last running total and the largest counts of each series of
checkpoints, so a row costs its session's few counters, whatever came before. Rows of a session must arrive in order, as appended
lines do; within a micro-batch they are sorted. Lost executors restore the state from the query's checkpoint folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.operators.usage import COUNTS, USAGE, baseline_key


def _grown(now: dict | None, before: dict | None) -> dict | None:
    if now is None or before is None:
        return now
    more = {c: max(0, (now.get(c) or 0) - (before.get(c) or 0)) for c in COUNTS if now.get(c) is not None or before.get(c) is not None}
    return more | {"model": now.get("model")}


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, most = (json.loads(x) for x in state.get) if state.exists else (None, {})
    rows = pd.concat(list(batches)).sort_values("ordinal", kind="stable")
    out = []
    for ordinal, series, use, total in zip(rows["ordinal"], rows["baseline"], rows["usage"], rows["total"], strict=True):
        use, total = (json.loads(x) if x else None for x in (use, total))
        if series:
            growth, old = _grown(use, most.get(series)), most.get(series, {})
            most[series] = {c: max(x for x in (old.get(c), use.get(c)) if x is not None) for c in COUNTS if old.get(c) is not None or use.get(c) is not None}
        else:
            growth = _grown(total, last)
        last = total or last
        out.append((key[0], ordinal, series or None, growth and json.dumps(growth)))
    state.update((json.dumps(last), json.dumps(most)))
    yield pd.DataFrame(out, columns=["session", "ordinal", "baseline", "growth"])


def checkpoint_growth(stream: DataFrame) -> DataFrame:
    """(session, ordinal, baseline, growth) of a stream of (session, ordinal, usage, total)."""
    told = stream.select("session", F.col("ordinal").cast("long").alias("ordinal"), baseline_key(F.col("total"), F.col("usage")).alias("baseline"), F.to_json("usage").alias("usage"), F.to_json("total").alias("total"))
    grown = told.groupBy("session").applyInPandasWithState(_step, "session string, ordinal long, baseline string, growth string", "last string, most string", "append", GroupStateTimeout.NoTimeout)
    return grown.withColumn("growth", F.from_json("growth", USAGE))
