"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and each run of white space is one blank. A test item of n characters may differ by
e = floor(n * RATE) edits. It is split into e + 1 pieces; in any text within e edits at least one piece stands unchanged.
All pieces of all items are looked for at once (Aho-Corasick), and where one is found, the item is compared with
the text around it by Myers' bit-parallel algorithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Edits allowed as a share of an item's length; characters of test items that one pass over the texts looks for.
RATE, PASS_CHARS = 0.05, 20_000_000


_FOUND = "doc_id long, item_id long, distance long, start_at long, end_at long"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 parts of nearly even length, with their places."""
    n, k = len(item), errors + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' algorithm for one item: the least edit distance to any part of a text."""

    def __init__(self, item: str):
        self.item, self.n = item, len(item)
        self.mask, self.top = (1 << self.n) - 1, 1 << (self.n - 1)
        self.at: dict[str, int] = {}
        for i, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The distance, and the end of the first part of `text` that has it."""
        exact = text.find(self.item)
        if exact >= 0:
            return 0, exact + self.n
        mask, top, at = self.mask, self.top, self.at
        up, down, score = mask, 0, self.n
        least, end = score, 0
        for i, c in enumerate(text):
            eq = at.get(c, 0)
            v = eq | down
            h = (((eq & up) + up) ^ up) | eq
            plus, minus = down | (~(h | up) & mask), up & h
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                if score < least:
                    least, end = score, i + 1
            plus, minus = plus << 1 & mask, minus << 1 & mask
            up, down = minus | (~(v | plus) & mask), plus & v
        return least, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(len(t) * rate)) for i, t in items if t]
        self.patterns: dict[int, Pattern] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for at, p in pieces(t, e):
                where.setdefault(p, []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for p, hits in where.items():
            self.machine.add_word(p, (len(p), hits))
        if where:
            self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """item, distance, start and end in the normal text of the best place of each item that is there."""
        if not self.items or not text:
            return []
        near: dict[int, list[int]] = {}
        for end, (size, hits) in self.machine.iter(text):
            for k, at in hits:
                near.setdefault(k, []).append(end + 1 - size - at)
        out = []
        for k, starts in near.items():
            item, t, e = self.items[k]
            n, best, reach = len(t), None, -1
            pattern = self.patterns.get(k) or self.patterns.setdefault(k, Pattern(t))
            starts = sorted({*starts})
            i = 0
            while i < len(starts):  # starts that lie close share a window
                j = i
                while j + 1 < len(starts) and starts[j + 1] - starts[j] <= e:
                    j += 1
                lo = max(0, starts[i] - e)
                reach = min(len(text), starts[j] + n + e)
                d, end = pattern.best(text[lo:reach])
                if d <= e and (best is None or d < best[0]):
                    best = (d, lo + end)
                i = j + 1
            if best:
                out.append((item, best[0], max(0, best[1] - n), best[1]))
        return out


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in passes of PASS_CHARS characters, of which the driver holds one at a time."""
    part, size = [], 0
    for r in runtime.pick(benchmark, "item_id", "text").where("text is not null").toLocalIterator():
        part.append((r["item_id"], normal(r["text"])))
        size += len(part[-1][1])
        if size >= PASS_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, start_at, end_at: each test item found in each whole text, where it is found best.

    Places are code points of the normal text; the start is that of a match as long as the item. Null or empty texts
    and items match nothing. Equal items each report; repeated documents each report. A null doc_id stays null, a null
    item_id too. Items come in passes of PASS_CHARS characters, each shared with all executors, so that a benchmark of
    any size is matched whole.
    """
    rows, out = runtime.pick(docs, "doc_id", "text"), None
    for part in _passes(benchmark):
        shared = runtime.Shared(docs.sparkSession, (part, rate), Matcher)

        def search(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            runtime.alone("decontamination", runtime._held.clear)
            for b in it:
                m = shared.get()
                found = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for hit in m.find(normal(t.as_py()))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "item_id", "distance", "start_at", "end_at"])

        one = rows.mapInArrow(search, _FOUND)
        out = one if out is None else out.union(one)
    return rows.sparkSession.createDataFrame([], _FOUND) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows in which no test item is found, with all their columns, whatever they are called.

    A null or empty text holds no item and stays; so do all rows where the benchmark is empty. Ids are not looked at.
    An empty table gives no rows.
    """
    flat, names = runtime.numbered(docs)
    text = names.index("text")
    for part in _passes(benchmark):
        shared = runtime.Shared(docs.sparkSession, (part, rate), Matcher)

        def keep(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            runtime.alone("decontamination", runtime._held.clear)
            for b in it:
                m = shared.get()
                yield b.filter(pa.array([not m.find(normal(t.as_py())) for t in b.column(text)], pa.bool_()))

        flat = flat.mapInArrow(keep, flat.schema)
    return flat.toDF(*names)
