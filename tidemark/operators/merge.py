"""User-defined ordered aggregates: fold a key's rows in log order, in parts or whole, with a side output."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MergeOperator:
    """merge(key, base row or None, rows in order) gives what the key becomes (None: nothing) and events on the side.

    partial(rows in order) may drop rows that no base could make matter; by default all are kept.
    """

    merge: Callable[[object, dict | None, list[dict]], tuple[dict | None, list[dict]]]
    partial: Callable[[list[dict]], list[dict]] = list


def merged(base: DataFrame, patches: DataFrame, operator: MergeOperator, key: str, order: str, state: str, event: str) -> DataFrame:
    """Rows with kind 'state' (columns of state) or 'event' (columns of event), by a cogroup of base and patches."""
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    out = ["kind", *names(state), *(c for c in names(event) if c not in names(state))]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = right.sort_values(order, kind="stable").astype(object).to_dict("records")
        own = left.astype(object).to_dict("records")
        row, events = operator.merge((own or rows)[0][key], own[0] if own else None, rows)
        made = ([{"kind": "state", **row}] if row is not None else []) + [{"kind": "event", **e} for e in events]
        return pd.DataFrame(made, columns=out)

    extra = ", ".join(c for c in event.split(", ") if c.split()[0] not in names(state))
    schema = f"kind string, {state}" + (f", {extra}" if extra else "")
    return base.groupBy(key).cogroup(patches.groupBy(key)).applyInPandas(run, schema)


def reduced(patches: DataFrame, operator: MergeOperator, key: str, order: str) -> DataFrame:
    """The patches that operator.partial keeps of each key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="stable").astype(object).to_dict("records")
        return pd.DataFrame(operator.partial(rows), columns=list(pdf.columns)).astype(pdf.dtypes)

    return patches.groupBy(key).applyInPandas(run, patches.schema)


def replace_latest(key: str, order: str, value: str) -> MergeOperator:
    """Last write wins; what it replaces is retired on the side."""

    def merge(k: object, base: dict | None, rows: list[dict]) -> tuple[dict | None, list[dict]]:
        all_rows: Iterator[dict] = [*([base] if base else []), *rows]
        last = all_rows[-1]
        return {key: k, order: last[order], value: last[value]}, [{key: k, order: r[order]} for r in all_rows[:-1]]

    return MergeOperator(merge, lambda rows: rows[-1:])


def blob_merge() -> MergeOperator:
    """The state of a blob, live versions by shard and its lifetime as JSON, after a fold of its mutations; what they end is
    retired. A state folds on: mutations in any number of parts come to what they come to at once."""

    def merge(k: object, base: dict | None, rows: list[dict]) -> tuple[dict | None, list[dict]]:
        state = json.loads(base["state"]) if base else {}
        before = {v[0] for v in state.get("live", {}).values()}
        now = fold(state, [(int(r["lsn"]), int(r["shard"]), int(r["epoch"]), r["op"], int(r["end_epoch"])) for r in rows])
        put = before | {int(r["lsn"]) for r in rows if r["op"] == "put"}
        gone = sorted(put - {v[0] for v in now["live"].values()})
        return {"k": k, "state": json.dumps(now)}, [{"k": k, "lsn": x} for x in gone]

    return MergeOperator(merge)


def fold(state: dict, rows: list[tuple]) -> dict:
    """Apply mutations (lsn, shard, epoch, op, end_epoch) of one key, in order, to its state."""
    live, life = {int(s): tuple(v) for s, v in state.get("live", {}).items()}, state.get("life")
    for lsn, shard, epoch, op, end_epoch in sorted(rows):
        if op == "put":
            live[shard] = (lsn, epoch)
        elif op == "tomb":
            live.pop(shard, None)
        elif op == "del":
            live, life = {}, None
        else:
            if life and life[1] <= epoch:  # it ended before this one came: what it held for is gone
                live = {s: v for s, v in live.items() if life[0] <= v[0] and life[1] <= v[1]}
            life = (lsn, end_epoch)
    return {"live": live, "life": life}


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The same for the plain case, without Python: the row of the greatest order of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")
