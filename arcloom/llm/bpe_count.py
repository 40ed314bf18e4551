"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut where no vocabulary piece can reach across (before a run of blanks, and around characters that are in
no piece of two or more). Each part is merged on its own: its characters form a linked list, a heap holds the adjacent
pairs that spell a piece, and the pair of lowest rank (leftmost on a tie) is merged until none is left. The count is
the number of initial symbols less the merges; a character outside the vocabulary counts as its UTF-8 bytes. No
identifiers are made. Counts of short parts are remembered in each Python worker, up to a bounded number.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import runtime

BLANK = "▁"
#: Parts remembered by one Python worker before it starts anew, and the longest part that is remembered.
REMEMBER, REMEMBER_CHARS = 400_000, 48


class Merger(dict):
    """Maps a part (blanks written as U+2581) to its number of tokens."""

    def __init__(self, ranks: dict[str, float]):
        super().__init__()
        self.ranks = ranks
        self.blank = _Blank(self)
        joined = {c for p in ranks if len(p) > 1 for c in p}
        #: a newline is its own part unless some piece spells it with others
        self.newline_alone = "\n" not in joined
        self.newline = 1
        #: characters that stand together inside some piece; between others a part can be cut
        self.pairs = {p[i : i + 2] for p in ranks for i in range(len(p) - 1)}
        self.splittable = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in ranks)

    def __missing__(self, part: str) -> int:
        n = self.count(part)
        if len(part) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER:
                self.clear()
            self[part] = n
        return n

    def count(self, part: str) -> int:
        ranks = self.ranks
        n = len(part)
        symbols = sum(1 if c in ranks else len(c.encode()) for c in part)
        if n < 2:
            return symbols
        text = list(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[pair], i, i + 1, pair) for i in range(n - 1) if (pair := part[i : i + 2]) in ranks]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if text[i] is None or j >= n or text[j] is None or after[i] != j or text[i] + text[j] != pair:
                continue  # one side has been merged meanwhile
            text[i], text[j] = pair, None
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (new := pair + text[k]) in ranks:
                    heapq.heappush(heap, (ranks[new], i, k, new))
            if (b := before[i]) >= 0 and (new := text[b] + pair) in ranks:
                heapq.heappush(heap, (ranks[new], b, i, new))
        return symbols - merges

    def tokens(self, text: str | None) -> int:
        """The number of tokens of a whole text; null and empty texts have none."""
        if not text:
            return 0
        if not (self.splittable and self.newline_alone):
            return self[BLANK + text.replace(" ", BLANK)]
        lines = text.split("\n")
        total = (len(lines) - 1) * self.newline
        for k, line in enumerate(lines):
            parts = line.split(" ")
            if "" in parts or BLANK in line:
                whole = (BLANK if not k else "") + line.replace(" ", BLANK)
                total += sum(map(self.__getitem__, re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", whole)))
                continue
            total += self[parts[0]] if k else self[BLANK + parts[0]]
            total += sum(map(self.blank.__getitem__, parts[1:]))
        return total


class _Blank(dict):
    """As Merger, of parts that one blank precedes, which is left out of the key."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, part: str) -> int:
        if len(part) > 1 and part[-1] in ".,!?;:" and part[-2:] not in self.merger.pairs:
            n = self[part[:-1]] + self.merger[part[-1]]
        else:
            n = self.merger.count(BLANK + part)
        if len(part) < REMEMBER_CHARS:
            if len(self) >= REMEMBER:
                self.clear()
            self[part] = n
        return n


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """Of a sentencepiece model file. The library is asked for the pieces and their scores only."""
    if path not in _mergers:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        _mergers[path] = Merger({sp.id_to_piece(i): -sp.get_score(i) for i in ids})
    return _mergers[path]


def token_counts(docs: DataFrame, model: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Null text counts as empty: no bytes, no tokens. Null ids and repeated rows pass through, a row each. Columns other
    than doc_id and text are not looked at. `model` is the path of a sentencepiece BPE model with byte fallback, a
    dummy blank in front and no other normalisation; it must be there on every executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runtime.alone("counts", _mergers.clear)
        m = merger(model)
        for b in batches:
            _, off = runtime.utf8(b.column(1))
            n = np.fromiter((m.tokens(t.as_py()) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return runtime.pick(docs, "doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
