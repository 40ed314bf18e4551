"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

A text is a bag of hashed n-grams: its words, its pairs of words, and its pairs of word shapes (case, digits, marks,
length, whether the word repeats the one before). The raw model counts them over all texts, the target model over
texts labelled good. A text's log weight is the sum over its n-grams of log p_target - log p_raw. To each is added
Gumbel noise drawn from a hash of the id, and the k largest are kept: a sample without replacement in which the odds of
a text are its weight. k is the number of texts whose weight is at least `cut`: the weight that all but LOSS of the
labelled good texts reach (0 at most), or, where the labelled poor texts lie below that, the middle between the two.

The target model and the cut come from a bounded sample, SAMPLE labelled rows; the raw model covers every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textvec
from .langid import held_out

#: Buckets of each kind of n-gram; labelled good texts that the target model and the cut are made from, at most.
BUCKETS, SAMPLE, LOSS, SEED, PRIOR = 1 << 14, 20_000, 0.001, 17, 10.0
KINDS = 3
_CLASS = np.zeros((3, 256), np.int32)
_CLASS[0, 65:91] = 1  # capitals
_CLASS[1, 48:58] = 1  # digits
_CLASS[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1  # marks


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of the documents, the kinds one after another, and the document of each."""
    h, s, e, begin = textvec.words(data, offsets, lower=False)
    n_words = np.diff(begin)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    if not len(h):
        return np.zeros(0, np.int64), doc
    shape = np.minimum(np.frexp(e - s)[1], 6).astype(np.int64)
    for row, most in zip(_CLASS, (2, 2, 3), strict=True):
        total = np.concatenate([[0], np.cumsum(row[data])])
        shape = shape * (most + 1) + np.minimum(total[e] - total[s], most)
    inside = doc[1:] == doc[:-1]
    same = h[1:] == h[:-1]
    pair = textvec.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inside]
    shapes = textvec.mix((shape[:-1] * 8192 + shape[1:] * 2 + same).astype(np.uint64) + np.uint64(99))[inside]
    size = np.uint64(BUCKETS)
    return np.concatenate([(h % size).astype(np.int64), (pair % size).astype(np.int64) + BUCKETS, (shapes % size).astype(np.int64) + 2 * BUCKETS]), np.concatenate([doc, doc[1:][inside], doc[1:][inside]])


def _ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket. The target model is drawn towards the raw one by PRIOR counts, so that
    n-grams of which a sample cannot tell weigh nothing."""
    out = np.zeros(KINDS * BUCKETS)
    for k in range(KINDS):
        own = slice(k * BUCKETS, (k + 1) * BUCKETS)
        expected = raw[own] * (target[own].sum() / max(1.0, raw[own].sum()))
        out[own] = np.log((target[own] + PRIOR) / (expected + PRIOR))
    return out


class Model:
    def __init__(self, ratio: np.ndarray, cut: float):
        self.ratio, self.cut = ratio, cut


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, q: the label where the row is in the sample."""
    known = runtime.pick(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("q"))
    ids = [r for q in (0, 1) for r in known.where(F.col("q") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, q int")  # SAMPLE of each label at most
    return runtime.pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id", "left")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Both models and the cut. Without labelled good texts every weight is 0 and all texts are kept."""
    marked = _marked(docs, labels)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runtime.alone("quality")
        raw, target = np.zeros(KINDS * BUCKETS, np.int64), np.zeros(KINDS * BUCKETS, np.int64)
        for b in batches:
            data, off = runtime.utf8(b.column(0))
            on = b.column(1).fill_null(0).to_numpy(zero_copy_only=False) == 1
            for lo, hi in runtime.steps(off):
                g, of = ngrams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                raw += np.bincount(g, minlength=KINDS * BUCKETS)
                target += np.bincount(g[on[lo:hi][of]], minlength=KINDS * BUCKETS)
        own = np.flatnonzero(raw)
        runtime.trim()
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(raw[own]), pa.array(target[own])], ["bucket", "raw", "target"])

    raw, target = np.zeros(KINDS * BUCKETS), np.zeros(KINDS * BUCKETS)
    for r in marked.select("text", "q").mapInArrow(tally, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[r[0]], target[r[0]] = r[1], r[2]
    if not target.sum():
        return Model(np.zeros(KINDS * BUCKETS), 0.0)
    ratio = _ratio(target, raw)
    seen = weights(marked.where("q is not null").select(F.col("q").cast("long").alias("doc_id"), "text"), ratio).groupBy("doc_id")
    seen = {r[0]: r[1:] for r in seen.agg(F.percentile_approx("log_weight", LOSS, 100_000), F.percentile_approx("log_weight", 0.99, 100_000)).collect()}
    cut = min(0.0, seen[1][0])
    if 0 in seen and seen[0][1] < cut:
        cut = (cut + seen[0][1]) / 2
    return Model(ratio, cut)


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, log_weight of every whole text; 0 for a text that is null or has no words."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runtime.alone("quality")
        for b in batches:
            data, off = runtime.utf8(b.column(1))
            w = np.zeros(b.num_rows)
            for lo, hi in runtime.steps(off):
                g, of = ngrams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                w[lo:hi] = np.bincount(of, shared.value[g], hi - lo)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w)], ["doc_id", "log_weight"])
        runtime.trim()

    return runtime.pick(docs, "doc_id", "text").mapInArrow(weigh, "doc_id long, log_weight double")


def kth_largest(rows: DataFrame, column: str, k: int, few: int = 4096, cells: int = 1024) -> float:
    """The k-th largest value, exactly: histograms narrow it down until `few` values are left."""
    if k <= 0:
        return float("inf")
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return float("-inf")
    above = 0
    while True:
        part = rows.where(F.col(column).between(lo, hi))
        width = (hi - lo) / cells
        if width <= 0 or lo + width == lo:
            return lo if above + part.count() >= k and lo == hi else hi
        cell = F.least(F.floor((F.col(column) - lo) / width), F.lit(cells - 1)).alias("cell")
        found = part.groupBy(cell).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("cell")).collect()
        if sum(r["n"] for r in found) <= few:
            values = sorted((r[0] for r in part.select(column).collect()), reverse=True)
            return values[min(k - above, len(values)) - 1]
        for r in found:
            if above + r["n"] >= k:
                if r["lo"] == r["hi"]:
                    return r["lo"]
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
        else:
            return found[-1]["lo"]


def resample(docs: DataFrame, model: Model, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, log_weight, gumbel_key, selected of every whole text.

    The k texts of the largest keys are selected (`k` None: as many as have a weight of at least the cut); texts that
    tie with the last are selected too. Null ids draw one noise, repeated rows the same one; each row stays a row.
    """
    scored, least = _drawn(docs, model, k, seed)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "log_weight", "gumbel_key", (F.col("gumbel_key") >= least).alias("selected"))


def gumbel(id_, seed: int = SEED):
    """Gumbel noise of each id."""
    return -F.log(-F.log((F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)))


def _drawn(docs: DataFrame, model: Model, k: int | None, seed: int) -> tuple[DataFrame, float]:
    """The keys, and the least of the selected."""
    scored = runtime.checkpoint(weights(docs, model.ratio).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)))
    if k is None:
        k = scored.where(F.col("log_weight") >= model.cut).count()
    return scored, kth_largest(scored, "gumbel_key", k)


def selected(docs: DataFrame, model: Model, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The selected rows with all their columns, whatever they are called. Weights are made again, which costs less than
    moving texts.

    A text that is null, empty or without a word has the weight 0. Null ids draw one noise, rows that repeat an id the
    same one; each is judged by its own text. An empty table gives no rows.
    """
    _, least = _drawn(docs, model, k, seed)
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)
    flat, names = runtime.numbered(docs)
    text, noise = names.index("text"), gumbel(F.col(f"_c{names.index('doc_id')}"), seed)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runtime.alone("quality")
        for b in batches:
            data, off = runtime.utf8(b.column(text))
            w = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).copy()
            for lo, hi in runtime.steps(off):
                g, of = ngrams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                w[lo:hi] += np.bincount(of, shared.value[g], hi - lo)
            yield b.select(range(b.num_columns - 1)).filter(pa.array(w >= least))
        runtime.trim()

    return flat.withColumn("_noise", noise).mapInArrow(keep, flat.schema).toDF(*names)
