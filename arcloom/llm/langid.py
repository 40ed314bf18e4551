"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three, over letters folded to lower case,
anything else being one blank), most frequent first. A document's own list is compared with each profile by the
out-of-place distance: the sum over its n-grams of how far apart the two ranks are, an n-gram that the profile lacks
counting as far as the profile is long. The nearest profile names the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

#: N-grams of a profile and of a document's list; documents of each language that profiles are learned from.
PROFILE, LEARN_PER_LANGUAGE = 400, 4000
_CHUNK = 1 << 20
_fold: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point the lower-case letter's, or 32 for what is no letter."""
    if not _fold:
        table = np.full(0x110000, 32, np.int64)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _fold.append(table)
    return _fold[0]


def _count(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[new], np.diff(np.append(new, len(x)))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, ascending, and their counts; of none if there is no letter."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([[32], c, [32]])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    if len(c) < 3:
        return none, none
    parts = []
    for at in range(0, len(c), _CHUNK):  # a very long text is counted by parts
        x = c[at : at + _CHUNK + 2]
        two = x[:-1] << 21 | x[1:]
        own = x[:_CHUNK]
        parts.append(_count(np.concatenate([own[own != 32], two[:_CHUNK], (two[:-1] << 21 | x[2:])[:_CHUNK]])))
    if len(parts) == 1:
        return parts[0]
    x, n = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[new], np.add.reduceat(n, new)


def ranked(x: np.ndarray, n: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The `most` n-grams of the highest counts, highest first; ties go by the n-gram."""
    if len(x) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        sure = np.flatnonzero(n > least)
        even = np.flatnonzero(n == least)[: most - len(sure)]
        own = np.sort(np.concatenate([sure, even]))
        x, n = x[own], n[own]
    return x[np.argsort(-n, kind="stable")]


class Profiles:
    def __init__(self, by_language: dict[str, np.ndarray]):
        self.languages = sorted(by_language)
        self.grams = np.unique(np.concatenate([by_language[k] for k in self.languages])) if self.languages else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.languages), len(self.grams)), -1, np.int64)
        for k, name in enumerate(self.languages):
            self.ranks[k, np.searchsorted(self.grams, by_language[name])] = np.arange(len(by_language[name]))

    def distances(self, top: np.ndarray) -> np.ndarray:
        """To each language, as a part of the largest that can be."""
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        theirs = np.where(self.grams[at] == top, self.ranks[:, at], -1)
        apart = np.where(theirs < 0, PROFILE, np.minimum(PROFILE, np.abs(theirs - np.arange(len(top)))))
        return apart.sum(1) / (PROFILE * len(top))

    def predict(self, text: str | None) -> tuple[str, float]:
        top = ranked(*grams(text))
        if not len(top) or not self.languages:
            return "und", 0.0
        d = self.distances(top)
        best = int(np.argmin(d))
        second = float(np.min(np.delete(d, best))) if len(d) > 1 else 1.0
        whole = float(d[best]) + second
        return self.languages[best], second / whole if whole else 0.5


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, per_language: int = LEARN_PER_LANGUAGE) -> Profiles:
    """Profiles from about `per_language` documents of each language, chosen by a hash of their ids."""
    known = runtime.pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({})
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / v)))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                x, n = (np.concatenate(p) for p in zip(*found, strict=True))
                if not len(x):
                    continue
                order = np.argsort(x, kind="stable")
                x, n = x[order], n[order]
                new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(new)), pa.array(x[new]), pa.array(np.add.reduceat(n, new))], ["lang", "gram", "n"])

    counts = chosen.select("text", "lang").mapInArrow(tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # each salt's best holds all of the language's best, so what comes to the driver is bounded
    top = counts.groupBy("lang", F.pmod(F.xxhash64("gram"), F.lit(16)).alias("salt")).agg(F.slice(F.sort_array(F.collect_list(F.struct("n", (-F.col("gram")).alias("g"))), False), 1, PROFILE).alias("top"))
    best: dict[str, list] = {}
    for r in top.collect():
        best.setdefault(r["lang"], []).extend((-n, -g) for n, g in r["top"])
    return Profiles({k: np.array([g for _, g in sorted(v)[:PROFILE]], np.int64) for k, v in best.items()})


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    `und` with score 0 where the text is null or has no letter, or no language was learned. Ties between languages go
    to the first by name. Null ids and repeated rows pass through; other columns are not looked at.
    """

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runtime.alone("language")
        for b in batches:
            lang, score = zip(*(profiles.predict(t.as_py()) for t in b.column(1)), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = runtime.pick(docs, "doc_id", "text").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(guess, "doc_id long, held_out boolean, lang_pred string, score double")
