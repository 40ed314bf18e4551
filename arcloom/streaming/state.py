"""Temporal state over streams of events, keyed by node.

Each function takes a streaming (or, for tests, any) DataFrame of events (eid, src, dst, t) and keeps state for each node,
so that a stream of micro-batches ends where the batch operators of `arcloom.operators.temporal` do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arcloom.operators.temporal import both_ways


def last_neighbours(events: DataFrame, k: int) -> DataFrame:
    """node, rank, other, eid: after each micro-batch, the k latest interactions of each node that it touched."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held = sorted({*held, *zip(f["eid"].tolist(), f["other"].tolist(), strict=True)}, key=lambda x: (-x[0], x[1]))[:k]
        state.update(tuple(map(list, zip(*held, strict=True))))
        yield pd.DataFrame({"node": key[0], "rank": range(1, len(held) + 1), "other": [o for _, o in held], "eid": [e for e, _ in held]})

    rows = both_ways(events).select("node", "other", "eid")
    return rows.groupBy("node").applyInPandasWithState(update, "node long, rank long, other long, eid long", "eids array<long>, others array<long>", "update", GroupStateTimeout.NoTimeout)


def memory(events: DataFrame) -> DataFrame:
    """node, last_update, last_eid: the newest interaction that each touched node has seen."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (-(1 << 62), -1)
        for f in frames:
            best = max(best, max(zip(f["t"].tolist(), f["eid"].tolist(), strict=True)))
        state.update(best)
        yield pd.DataFrame({"node": [key[0]], "last_update": [best[0]], "last_eid": [best[1]]})

    rows = both_ways(events).select("node", "t", "eid")
    return rows.groupBy("node").applyInPandasWithState(update, "node long, last_update long, last_eid long", "t long, eid long", "update", GroupStateTimeout.NoTimeout)


def adjacency(events: DataFrame) -> DataFrame:
    """node, other, eid: each new (src, dst) once, at its first event; later ones are ignored."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        first = min(int(f["eid"].min()) for f in frames)
        state.update((first,))
        yield pd.DataFrame({"src": [key[0]], "dst": [key[1]], "eid": [first]})

    return events.select("src", "dst", "eid").groupBy("src", "dst").applyInPandasWithState(update, "src long, dst long, eid long", "eid long", "append", GroupStateTimeout.NoTimeout)


def attention_rows(events: DataFrame) -> DataFrame:
    """src, dst, s: a node's attention over its distinct neighbours, 1 / out-degree, renewed as neighbours appear."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = {*state.get[0]} if state.exists else set()
        for f in frames:
            seen |= {*f["dst"].tolist()}
        state.update((sorted(seen),))
        yield pd.DataFrame({"src": key[0], "dst": sorted(seen), "s": 1.0 / len(seen)})

    return events.select("src", "dst").groupBy("src").applyInPandasWithState(update, "src long, dst long, s double", "seen array<long>", "update", GroupStateTimeout.NoTimeout)


def point_process(events: DataFrame, psi: float = 0.5, decay: float = 0.001) -> DataFrame:
    """src, dst, t, lam: intensities of events in order, under one key, as each depends on what all before it left.

    A node's excitation rises by one at each of its events and decays with time; an event's intensity is
    psi * log(1 + exp((sum of both ends) / psi)). The single key makes this a replay of small streams.
    """
    from math import exp, log1p

    from pyspark.sql import functions as F

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nodes, times, values = state.get if state.exists else ([], [], [])
        held = {n: (t, v) for n, t, v in zip(nodes, times, values, strict=True)}
        rows = sorted((r for f in frames for r in f[["t", "eid", "src", "dst"]].itertuples(index=False)), key=lambda r: (r.t, r.eid))
        out = []
        for r in rows:
            now = {n: held[n][1] * exp(-decay * (r.t - held[n][0])) if n in held else 0.0 for n in (r.src, r.dst)}
            g = max(-75.0, min(75.0, sum(now.values()) / psi))
            out.append((r.eid, r.src, r.dst, r.t, psi * log1p(exp(g))))
            for n, v in now.items():
                held[n] = (r.t, v + 1.0)
        state.update(([*held], [t for t, _ in held.values()], [v for _, v in held.values()]))
        yield pd.DataFrame(out, columns=["eid", "src", "dst", "t", "lam"])

    rows = events.select("eid", "src", "dst", "t", F.lit(0).alias("one"))
    return rows.groupBy("one").applyInPandasWithState(update, "eid long, src long, dst long, t long, lam double", "nodes array<long>, times array<long>, held array<double>", "append", GroupStateTimeout.NoTimeout)
