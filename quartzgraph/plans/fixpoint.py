"""Driver loops over written state tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import remove, written


def rounds(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], times: int, name: str, every: int = 4) -> DataFrame:
    """step, times times; the state is written every few rounds."""
    kept = None
    for i in range(times):
        state = step(state, i)
        if i % every == every - 1 or i == times - 1:
            state, before = written(state, name), kept
            if before is not None:
                remove(before)
            kept = state
    return state


def until(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], open_: str, name: str, most: int = 1_000_000, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """step until no row has the boolean column open_; the state is written each round."""
    state = written(state, name)
    for i in range(most):
        if not state.filter(F.col(open_)).limit(1).count():
            break
        if each:
            each(state, i)
        after = written(step(state, i), name)
        remove(state)
        state = after
    return state
