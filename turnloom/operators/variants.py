"""Prompts sent again in other words: of variants without an answer between them, only the first stays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that tell nothing about likeness, and how close in time variants are.
STOP_WORDS = frozenset("the and for with from that this into onto about following established project".split())
MOST_SECONDS = 600


def _plain(text: str | None) -> str:
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower().replace("**", "").replace("`", "")))


def _stem(word: str) -> str | None:
    """A word without its plural; short words tell nothing, other scripts' from two characters on do."""
    if len(word) < (3 if word.isascii() else 2):
        return None
    if not re.fullmatch("[a-z]{5,}", word) or word.endswith("ss"):
        return word
    return word[:-3] + "y" if word.endswith("ies") else word.removesuffix("s")


def likeness(a: str | None, b: str | None) -> bool:
    """Whether two prompts say nearly the same: equal, one of 24 characters inside the other, or enough words in common."""
    a, b = sorted((_plain(a), _plain(b)), key=len)
    if not a:
        return False
    if a == b or len(a) >= 24 and a in b:
        return True
    x, y = ({s for w in t.split() if (s := _stem(w)) and s not in STOP_WORDS} for t in (a, b))
    both, small, large = len(x & y), min(len(x), len(y)), max(len(x), len(y))
    return both >= 4 and both / small >= 0.6 and both / large >= 0.45


def _seconds(a: str | None, b: str | None) -> float:
    try:
        x, y = (datetime.fromisoformat((t or "").replace("Z", "+00:00")) for t in (a, b))
        return abs((y - x).total_seconds())
    except (ValueError, TypeError):
        return float("inf")


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of their run; only the run's last kept prompt is remembered."""
    run, last = None, None
    for rows in batches:
        keep = []
        for here, text, time in zip(zip(rows["session"], rows["run"], strict=True), rows["text"], rows["time_key"], strict=True):
            if here != run:
                run, last = here, None
            again = last is not None and likeness(last[0], text) and _seconds(last[1], time) <= MOST_SECONDS
            if not again:
                last = (text, time)
            keep.append(not again)
        yield rows.loc[keep, ["session", "seq_no"]]


def collapse(atoms: DataFrame) -> DataFrame:
    """``atoms`` (session, seq_no, actor_kind, is_turn, kind, display_policy, text, time_key) without prompts that are variants of the prompt kept before them.

    A shown assistant text between two prompts keeps both. Prompts between two answers are a run; a task streams its runs in order and
    holds one prompt at a time. seq_no is distinct in a session; a time that can't be read is far from every other.
    """
    so_far = Window.partitionBy("session").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, -1)
    answer = (F.col("actor_kind") == "assistant") & (F.col("kind") == "text") & ~F.col("display_policy").eqNullSafe(F.lit("hide"))
    runs = atoms.withColumn("run", F.coalesce(F.count_if(answer).over(so_far), F.lit(0))).where("is_turn").select("session", "run", "seq_no", "text", "time_key")
    kind = f"session {atoms.schema['session'].dataType.simpleString()}, seq_no {atoms.schema['seq_no'].dataType.simpleString()}"
    kept = runs.repartition("session", "run").sortWithinPartitions("session", "run", "seq_no").mapInPandas(_kept, kind)
    other = atoms.where("NOT coalesce(is_turn, false)")
    return other.unionByName(atoms.where("is_turn").join(kept, ["session", "seq_no"], "left_semi"))
