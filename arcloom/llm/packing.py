"""Best-fit packing by minimum bin slack.

Documents become token ids; only those longer than a sequence are cut. The sequences are then filled one by one: the
longest length still there is the seed, and a subset-sum dynamic programme over the available lengths, on a bitset of
`capacity` bits, finds the combination that leaves the least slack. As only the number of pieces of each length
matters for that, it runs on a histogram of at most `capacity` entries, and a combination is taken as often as its
lengths last. Pieces then get their places by their rank among those of their length; the ranks come from windows over
(length, salt), so that a length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

#: Words remembered by one Python worker before it drops those that did not come again, and the longest that is remembered.
REMEMBER, REMEMBER_CHARS = 400_000, 48
#: Marks that may end a word of letters (the apostrophe is not among them, as the tokenizer cuts by what follows it).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder(dict):
    """Maps a word to the bytes of its ids (little-endian, 32 bits each).

    Holds for tokenizers whose normaliser and pre-tokenizer never look across a blank and drop the blank itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = self._drops_blanks()
        self._prepare()

    def _drops_blanks(self) -> bool:
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return all(one(f"{a} {b}") == one(a) + one(b) == one(f" {a}\n {b} ") for a, b in (("ab", "cd"), ("x.", "'s"), ("1", "2"), ("é", "́a")))

    def _prepare(self) -> None:
        """What holds for this tokenizer: the ids that end a word, whether it only folds case, whether marks after
        letters are cut off as they stand, and whether words of ASCII letters reach its model unchanged."""
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.folds = one("ABC Ä É") == one("abc ä é")
        tails = (*MARKS, "###", "$$$", "***,", ".)", "--", "<|")
        self.marks = MARKS if all(one(w + t) == one(w) + one(t) for w in ("ab", "é") for t in tails) else ""
        self.tails: dict[str, bytes] = {}
        words = ("a", "ab", "the", "quelle", "thatreerwheati", "s", "zzzzqx")
        self.direct = all([t.id for t in self.tokenizer.model.tokenize(w)] == one(w) for w in words)
        self.again: set[str] = set()

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) >= 1000:
                self.tails.clear()
            self.tails[marks] = Encoder.__missing__(self, marks)
        return self.tails[marks]

    def learn(self, words: set[str]) -> None:
        """Words of ASCII letters go to the model as they are. Others go in one call: each word of letters alone becomes
        ids of which only the last ends a word."""
        model = self.tokenizer.model
        if self.direct:
            for w in words:
                if w.isascii() and w.isalpha() and w.islower():
                    self[w] = array("I", [t.id for t in model.tokenize(w)]).tobytes()
        plain = [w for w in words if w.isalpha() and w not in self]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(plain):
                raw, at = ids.tobytes(), 0
                for w, end in zip(plain, (4 * last).tolist(), strict=True):
                    self[w] = raw[at:end]
                    at = end
        rest = [w for w in words if w not in self]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self[w] = np.array(e.ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # the tokenizer folds case itself; done here first, fewer words differ (the dotted capital I and capital sigma, which fold by what stands about them, are left to it)
        split = [(t if "\u0130" in t or "\u03a3" in t or not self.folds else t.lower()).replace("\n", " ").split(" ") for t in texts]
        seen = set().union(*split)
        fresh = {w for w in seen if w not in self}
        self.again |= seen - fresh
        if len(self) + len(fresh) > REMEMBER:
            # most words never come again; those that did are kept, if they leave room for half as many others
            kept = {w: self[w] for w in self.again} if 2 * len(self.again) <= REMEMBER else {}
            self.clear()
            self.update(kept)
            self.again = set()
            fresh = {w for w in seen if w not in self}
        marked = {w: b for w in fresh if w[-1:] in self.marks and (b := w.rstrip(self.marks)).isalpha() and "\u0130" not in w} if self.marks else {}
        self.learn(fresh.difference(marked).union(marked.values()).difference(self))
        for w, b in marked.items():
            self[w] = self[b] + self._tail(w[len(b) :])
        out = [b"".join(map(self.__getitem__, ws)) for ws in split]
        for w in fresh.union(marked.values()):
            if len(w) > REMEMBER_CHARS:
                self.pop(w, None)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: what is to be packed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runtime.alone("packing", _encoders.clear)
        e, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            _, off = runtime.utf8(b.column(1))
            rows: list[tuple] = []
            ids = b.column(0).to_pylist()
            for lo, hi in runtime.steps(off, 4 * runtime.STEP_BYTES):
                texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                for doc, x in zip(ids[lo:hi], e.encode(texts), strict=True):
                    x += end
                    for k, at in enumerate(range(0, len(x), 4 * capacity)):
                        part = x[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                doc, k, at, n, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        runtime.trim()

    return runtime.pick(docs, "doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the available lengths whose sum is the largest not above `room`."""
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        trail.append((length, reach))
        left, take = min(counts[length], room // length), 1
        while left:  # copies by powers of two
            take = min(take, left)
            reach |= (reach << (take * length)) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    goal, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(trail):
        used = 0
        while not before >> goal & 1:
            goal, used = goal - length, used + 1
        if used:
            chosen[length] = used
    return chosen


def bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """How often each combination is taken, and its (length, copies), the seed's length first."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        chosen = fullest(left, capacity - seed)
        left[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[k] // v for k, v in chosen.items())
        for k, v in chosen.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
        out.append((times, sorted(chosen.items(), reverse=True)))
    return out


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length, the runs of ranks: first rank, copies in a sequence, first sequence, first offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for times, chosen in plan:
        at = 0
        for length, copies in chosen:
            out.setdefault(length, []).append((ranks.get(length, 0), copies, first, at))
            ranks[length] = ranks.get(length, 0) + times * copies
            at += length * copies
        first += times
    return {k: np.array(v, np.int64).T for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null text is empty: one piece that holds the end id alone. Null ids and repeated rows are packed as any others. No
    rows in, no rows out. The driver holds a histogram of at most `capacity` lengths, by at most 4096 salts.
    """
    spark = docs.sparkSession
    cut = runtime.checkpoint(pieces(docs, tokenizer, capacity, end_id))
    n = cut.count()
    salts = int(min(4096, max(64, n // 200_000)))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = np.zeros((capacity + 1, salts), np.int64)
    for r in salted.groupBy("length", "salt").count().toLocalIterator():
        before[r["length"], r["salt"]] = r["count"]
    plan = bins({i: int(c) for i, c in enumerate(before.sum(1)) if c}, capacity)
    before = np.cumsum(before, 1) - before
    shared = spark.sparkContext.broadcast((before, places(plan)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_rank, runs = shared.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = first_rank[length, b.column("salt").to_numpy(zero_copy_only=False)] + b.column("rank").to_numpy(zero_copy_only=False) - 1
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                since, copies, first, at = runs[int(k)]
                run = np.searchsorted(since, rank[own], "right") - 1
                inner = rank[own] - since[run]
                sequence[own] = first[run] + inner // copies[run]
                offset[own] = at[run] + inner % copies[run] * k
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
