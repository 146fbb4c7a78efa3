"""Folds that no window expresses: greedy rollover, runs of comparable files, smoothed signals.

They are sequential by nature, so each runs within one group, in order, over a stream of that group's batches: rows are
dealt by group and sorted within partitions, where Spark spills, and between batches only a small state is kept. A group
of any size takes the memory of one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def in_order(rows: DataFrame, group: str, order: list[str], schema: str, start: Callable[[], list], step: Callable[[pd.DataFrame, list], pd.DataFrame]) -> DataFrame:
    """What step(rows, state) makes of each group's rows, batch by batch in order; start() is a group's first state, and
    step changes it in place. Rows without a group are a group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf[group]
            same = (key == key.shift()) | (key.isna() & key.shift().isna())
            cuts = np.flatnonzero(~same.to_numpy())  # a batch's first row is one of them, or goes on from no group at all
            made = []
            for a, b in zip(sorted({0, *cuts}), [*(c for c in cuts if c), len(pdf)], strict=True):
                own = None if pd.isna(key.iloc[a]) else key.iloc[a]
                if state is None or own != last:
                    last, state = own, start()
                made.append(step(pdf.iloc[a:b], state))
            yield pd.concat(made)

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def greedy_rollover(records: DataFrame, capacity: int, group: str) -> DataFrame:
    """group, lsn, segment, offset: a record that doesn't fit starts the group's next segment."""

    def step(pdf: pd.DataFrame, state: list) -> pd.DataFrame:
        number, used, filled = state
        size = pdf["len"].to_numpy().astype(np.int64)
        end = np.cumsum(size)
        segment, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        first, base = 0, -used
        while first < len(pdf):  # a step for each segment, not for each record
            stop = int(np.searchsorted(end, base + capacity, "right"))
            if stop <= first:
                if filled:
                    number, base, filled = number + 1, int(end[first] - size[first]), False
                    continue
                stop = first + 1  # larger than a segment: alone in one
            segment[first:stop] = number
            offset[first:stop] = end[first:stop] - size[first:stop] - base
            first, filled = stop, True
        state[:] = number, int(end[-1] - base), filled
        return pd.DataFrame({group: pdf[group], "lsn": pdf["lsn"], "segment": segment, "offset": offset})

    return in_order(records.select(group, "lsn", "len"), group, ["lsn"], f"{group} long, lsn long, segment long, offset long", lambda: [0, 0, False], step)


def comparable_run(files: DataFrame, group: str, fanout: int = 4, ratio: int = 4, most: int = 16) -> DataFrame:
    """group, file_id of the oldest run of at least fanout consecutive files whose sizes lie within a factor."""

    def step(pdf: pd.DataFrame, state: list) -> pd.DataFrame:
        waiting, n, low, high, done = state
        out = []
        for file_id, size in zip(pdf["file_id"].tolist(), pdf["file_len"].clip(lower=1).tolist(), strict=True):
            if done:
                break
            if n and max(high, size) <= ratio * min(low, size):
                n, low, high = n + 1, min(low, size), max(high, size)
            elif n >= fanout:
                done = True
                break
            else:
                waiting, n, low, high = [], 1, size, size
            waiting.append(file_id)
            if n >= fanout:
                out, waiting, done = out + waiting, [], n >= most
        state[:] = waiting, n, low, high, done
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(out), "file_id": out})

    return in_order(files.select(group, "file_id", "min_lsn", "max_lsn", "file_len"), group, ["min_lsn", "max_lsn", "file_id"], f"{group} long, file_id long", lambda: [[], 0, 0, 0, False], step)


def smoothed(samples: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, order, average, baseline: an integer moving average (7/8 old), and a baseline that drops at once and rises
    by a 64th."""

    def step(pdf: pd.DataFrame, state: list) -> pd.DataFrame:
        average, baseline = state
        out = []
        for x in pdf[value].tolist():
            average = x if average is None else (7 * average + x) // 8
            baseline = average if baseline is None or average < baseline else baseline + (average - baseline) // 64
            out.append((average, baseline))
        state[:] = average, baseline
        return pd.DataFrame({group: pdf[group], order: pdf[order], "average": [a for a, _ in out], "baseline": [b for _, b in out]})

    return in_order(samples.select(group, order, value), group, [order], f"{group} long, {order} long, average long, baseline long", lambda: [None, None], step)
