"""Exact n-gram Jaccard self-join by universe partition and pigeonhole.

A document is the set of its distinct word shingles. Sets of a size band [2^b, 2^(b+1)) hash each shingle into one of
the band's m segments, and a signature is the hash of the shingles in one segment. Two sets of sizes s <= l that are
similar enough differ in at most H = (s+l)(1-t)/(1+t) shingles. The smaller one gives its segments allowances: 0 (not
looked at), 1 (the segments must be equal) or 2 (they may differ by one shingle, found by also indexing what is left of
a segment when one shingle is taken away). If the allowances add up to more than H, some segment must match within its
allowance. Empty segments get 0. Segments whose signature many sets share are costly; they get 0 wherever the rest of
the set still adds up to more than H. The m of a band is the least for which sets of the band can afford that; a
set that can't is joined again with more segments. A larger set also visits the band below, if its size allows a
partner there.

Signatures are packed into binary rows, a row for each Arrow batch and bucket, so that a shuffle moves five bytes and a
little for each, and a node and size for each set. Equal sets are one node: a group of copies sends one signature a batch. Pairs that share a signature are
verified on the whole sets, unless they share fewer segments than similar sets must. Of a costly signature the arms of
a star are verified first; what then is in one class needs no further pair. Sets of different classes that still meet
in a signature which one of them could not afford to pass over go through a second, finest partition, in which each
shingle is a segment (`_second`). No pair is lost, and no step makes all pairs of a run.

A node is a 63-bit hash of its set, and sets of one hash count as equal without a further look; shingles are compared by
48 bits of their hashes. "Exact" holds up to such collisions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import components, runtime, textvec

#: Shingle width in words; the threshold as a fraction.
WIDTH, NUM, DEN = 5, 3, 4
#: A signature of more sets than this is costly; segments of each band whose one-deletion neighbourhoods are indexed.
COSTLY, SPARE = 8, 2
#: Signatures that are looked at together, about; the parts of a full bucket, which are looked at one by one; buckets
#: from which on they are filled before there are more.
PER_BUCKET, PARTS, ENOUGH = 500_000, 4, 64
#: Bits for each document in the filter of those whose sets are looked up again, and the most bits that are broadcast
#: (beyond, documents are chosen by a join).
FILTER_RATE, FILTER_BITS = 16, 1 << 30
#: Bytes of text whose signatures one packed row may hold; 64-bit words of a set's parity sketch.
FLUSH_BYTES, SKETCH = 4 << 20, 8
_SKETCH = [f"s{k}" for k in range(SKETCH)]
#: Runs by which two sets that meet in many runs agree on the one that pairs them (`_once`).
FIRSTS = 6


@dataclass(frozen=True)
class Bands:
    """Segment counts. `factor` multiplies them; `only` are the bands in use (None: all)."""

    #: part of a set that may lie in costly segments, of passages that many documents share, without being looked at
    common = 0.5

    num: int = NUM
    den: int = DEN
    factor: int = 1
    only: tuple[int, ...] | None = None

    def errors(self, size: int) -> int:
        """The most by which a set of this size may differ from a larger partner."""
        larger = size * self.den // self.num
        return (size + larger) * (self.den - self.num) // (self.den + self.num)

    def segments(self, band: int) -> int:
        """The least m with which a set of the band, but for a chance of about 1e-6, has errors + 1 segments that are
        filled by the part of it that is not common."""
        top = (2 << band) - 1
        need = self.errors(top) + 1
        lo, hi = need, 64 * top + 64
        while lo < hi:
            m = (lo + hi) // 2
            rare = top * (1 - self.common)
            e = math.exp(-rare / m)
            filled, spread = m * (1 - e), math.sqrt(max(0.0, m * e * (1 - (1 + rare / m) * e)))
            lo, hi = (lo, m) if filled - 5 * spread - 1 >= need or m >= 32 * top else (m + 1, hi)
        return lo * self.factor

    def table(self) -> np.ndarray:
        return np.array([self.segments(b) for b in range(40)], np.int64)


def sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, ascending, with the document's number."""
    h, _, _, begin = textvec.words(data, offsets)
    return textvec.distinct(*textvec.shingles(h, begin, width))


def identity(x: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hash of each set, a node of the graph; 0 for an empty one."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(textvec.mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    out = textvec.mix(total[begin[1:]] - total[begin[:-1]] + n.astype(np.uint64)) >> np.uint64(1)
    return np.where(n > 0, np.maximum(out, np.uint64(1)), np.uint64(0)).astype(np.int64)


def signatures(x: np.ndarray, of: np.ndarray, band: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
    """For sets (shingle, set number; the band and m of each set): signature, set and cost of each; then the sum of
    allowances that each set can give, and the number of its filled segments."""
    count = len(band)
    if not len(x):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(count, np.int64), np.zeros(count, np.int64)
    y = textvec.mix(x + (band[of].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    # a multiply-shift on the upper half picks the segment
    segment = ((y >> np.uint64(32)) * m[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    key = of * (int(m.max()) + 1) + segment
    order = np.argsort(key, kind="stable")
    key, y = key[order], textvec.mix(y[order] ^ np.uint64(0x5DEECE66D1234567))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    total = np.add.reduceat(y, first)
    owner, seg = of[order][first], segment[order][first]
    salt = seg.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + band[owner].astype(np.uint64)
    spare = (seg < SPARE) & (size >= 2)
    # what is left of a spare segment without one of its shingles
    wide = np.repeat(spare, size)
    seg_of = np.repeat(np.arange(len(first)), size)[wide]
    left = total[seg_of] - y[wide]
    sig = textvec.mix(np.concatenate([total, left]) ^ np.concatenate([salt, salt[seg_of]]))
    sets_of = np.concatenate([owner, owner[seg_of]])
    cost = np.concatenate([1 + spare, np.full(len(left), 2)]).astype(np.int8)
    filled = np.bincount(owner, minlength=count)
    return sig, sets_of, cost, filled + np.bincount(owner[spare], minlength=count), filled


def _band(n: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(n, 1))[1].astype(np.int64) - 1


def parities(x: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    """Of each set, for each of 64 * SKETCH cells the parity of its shingles there. Each shingle that two sets do not
    share turns one cell, so sets that differ in d shingles have sketches that differ in d bits at most."""
    cells = 64 * SKETCH
    bits = np.bincount(of * cells + (textvec.mix(x ^ np.uint64(0x1234567)) % np.uint64(cells)).astype(np.int64), minlength=count * cells) & 1
    return np.packbits(bits.astype(np.uint8).reshape(count, cells), axis=1).view(np.int64).reshape(count, SKETCH)


def described(docs: DataFrame, bands: Bands, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, n (size of the set), node, filled (segments), spare (what allowances add up to beyond the
    errors), and the parity sketch."""
    table = bands.table()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runtime.alone("near copies")
        for b in batches:
            data, off = runtime.utf8(b.column(1))
            for lo, hi in runtime.steps(off):
                x, of = sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
                n = np.bincount(of, minlength=hi - lo)
                begin = np.concatenate([[0], np.cumsum(n)])
                band = _band(n)
                _, _, _, allowance, filled = signatures(x, of, band, table[band])
                errors = (n + n * bands.den // bands.num) * (bands.den - bands.num) // (bands.den + bands.num)
                sketch = parities(x, of, hi - lo)
                columns = [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(n), pa.array(identity(x, begin, n)), pa.array(filled), pa.array(allowance - errors - 1), *(pa.array(sketch[:, k]) for k in range(SKETCH))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "node", "filled", "spare", *_SKETCH])
        runtime.trim()

    rows = runtime.pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.mapInArrow(describe, "doc_id long, text_hash long, n long, node long, filled long, spare long" + "".join(f", {c} long" for c in _SKETCH))


_PACKED = "bucket long, sig binary, own binary, cost binary, node binary, n binary"


def _buckets(count: float) -> int:
    """How many buckets so many signatures go to. A set's node is sent once for each bucket that its signatures fall
    into, so few full buckets are less to shuffle than many; but each is one task's."""
    return int(max(8, min(ENOUGH, count // PER_BUCKET), count // (PARTS * PER_BUCKET)))


def _packed(sig: np.ndarray, owner: np.ndarray, cost: np.ndarray, node: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket, in order of its sets: the low 40 bits of signatures; how many are each set's; costs, two
    bits each; nodes, sizes. Counts and sizes are as wide as the row's largest needs."""
    bucket = ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort((bucket * len(node) + owner) * 4 + cost.astype(np.int64), kind="stable")
    sig, owner, cost, bucket = sig[order], owner[order], cost[order].astype(np.uint8), bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rows = []
    for at, end in zip(first, np.append(first[1:], len(bucket)), strict=True):
        head = np.flatnonzero(np.concatenate([[True], owner[at + 1 : end] != owner[at : end - 1]]))
        used, count = owner[at:end][head], np.diff(np.append(head, end - at))
        low = sig[at:end].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        four = np.pad(cost[at:end], (0, -(end - at) % 4)).reshape(-1, 4) << np.arange(0, 8, 2, np.uint8)
        rows.append((int(bucket[at]), low.tobytes(), _narrow(count, "<u1"), np.bitwise_or.reduce(four, axis=1).tobytes(), node[used].tobytes(), _narrow(n[used], "<u2")))
    k, *rest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), *(pa.array(r, pa.binary()) for r in rest)], ["bucket", "sig", "own", "cost", "node", "n"])


def _narrow(v: np.ndarray, kind: str) -> bytes:
    return v.astype(kind if v.max() <= np.iinfo(kind).max else "<u4").tobytes()


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a bucket: signatures, the place of each one's set among all rows' sets, costs; nodes and sizes of these sets."""
    sig, own, cost, node, n, held = [], [], [], [], [], 0
    for s, o, c, v, size in zip(*(table[k].to_pylist() for k in ("sig", "own", "cost", "node", "n")), strict=True):
        raw = np.zeros((len(s) // 5, 8), np.uint8)
        raw[:, :5] = np.frombuffer(s, np.uint8).reshape(-1, 5)
        sig.append(raw.view("<u8").ravel())
        node.append(np.frombuffer(v, np.int64))
        count = len(node[-1])
        own.append(np.repeat(np.arange(held, held + count, dtype=np.int32), np.frombuffer(o, "<u1" if len(o) == count else "<u4")))
        cost.append((np.frombuffer(c, np.uint8)[:, None] >> np.arange(0, 8, 2, np.uint8) & np.uint8(3)).ravel()[: len(raw)].astype(np.int8))
        n.append(np.frombuffer(size, "<u2" if len(size) == 2 * count else "<u4").astype(np.int64))
        held += count
    return tuple(np.concatenate(v) for v in (sig, own, cost, node, n))


def packed_signatures(docs: DataFrame, bands: Bands, buckets: int, width: int = WIDTH) -> DataFrame:
    """bucket, sig, own, cost, node, n: the signatures of a batch's sets that fall into one bucket, and those sets."""
    table = bands.table()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runtime.alone("near copies")
        seen: set[int] = set()
        for b in batches:
            whole, ends = runtime.utf8(b.column(1))
            for first_row, last_row in runtime.steps(ends, FLUSH_BYTES):
                part = packed(whole[ends[first_row] : ends[last_row]], ends[first_row : last_row + 1] - ends[first_row], seen)
                if part is not None:
                    yield part
        runtime.trim()

    def packed(data: np.ndarray, off: np.ndarray, seen: set[int]) -> pa.RecordBatch | None:
        nodes, sizes, sigs, owners, costs, held = [], [], [], [], [], 0
        for lo, hi in runtime.steps(off):
            x, of = sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
            n = np.bincount(of, minlength=hi - lo)
            node = identity(x, np.concatenate([[0], np.cumsum(n)]), n)
            keep = np.zeros(hi - lo, bool)
            if len(seen) > 500_000:
                seen.clear()
            for i, v in enumerate(node.tolist()):  # copies in one task are one, as far as it remembers
                if v and v not in seen:
                    seen.add(v)
                    keep[i] = True
            number = np.cumsum(keep) - 1
            own = keep[of]
            x, of, node, n = x[own], number[of[own]], node[keep], n[keep]
            band = _band(n)
            for down in (0, 1):
                use = np.ones(len(n), bool) if not down else (band > 0) & (-(-n * bands.num // bands.den) < (1 << np.maximum(band, 0)))
                if bands.only is not None:
                    use &= np.isin(band - down, bands.only)
                if not use.any():
                    continue
                put, pick = np.cumsum(use) - 1, use[of]
                s, o, c, *_ = signatures(x[pick], put[of[pick]], band[use] - down, table[band[use] - down])
                sigs.append(s)
                owners.append(np.flatnonzero(use)[o] + held)
                costs.append(c if not down else np.zeros_like(c))  # a visitor gives no allowance
            nodes.append(node)
            sizes.append(n)
            held += len(n)
        if not sigs:
            return None
        return _packed(*(np.concatenate(v) for v in (sigs, owners, costs, nodes, sizes)), buckets)

    return runtime.pick(docs, "doc_id", "text").mapInArrow(emit, _PACKED)


def _runs(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a bucket, the signatures that several sets share, each set once for each: node, n, cost, signature, the size of
    its run, and its place there."""
    sig, own, cost, node, n = _unpacked(table)
    top, kept = sig >> np.uint64(38), []
    for part in range(PARTS):  # in order of signatures; only what several sets share is kept
        here = np.flatnonzero(top == part)
        here = here[np.argsort(sig[here], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], sig[here[1:]] != sig[here[:-1]]])) if len(here) else here
        size = np.diff(np.append(first, len(here)))
        kept.append(here[np.repeat(size > 1, size)])
    order = np.concatenate(kept)
    cost, sig, node, n = cost[order], sig[order], node[own[order]], n[own[order]]
    run = np.cumsum(np.concatenate([[False], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    # copies that came from other batches are one
    order = np.lexsort((-cost, node, run))
    node, n, cost, run, sig = node[order], n[order], cost[order], run[order], sig[order]
    one = np.ones(len(node), bool)
    one[1:] = (node[1:] != node[:-1]) | (run[1:] != run[:-1])
    node, n, cost, run, sig = node[one], n[one], cost[one], run[one], sig[one]
    begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(run)))
    return node, n, cost, sig, np.repeat(size, size), np.arange(len(run)) - np.repeat(begin, size)


def _within(node: np.ndarray, n: np.ndarray, width: np.ndarray, place: np.ndarray, bands: Bands, ask: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Pairs inside runs that are not costly, the smaller set first, once each: places i and j, and in how many runs they
    meet. Pairs neither of which asks are left out, and those whose sizes no similar sets have."""
    found = []
    for gap in range(1, COSTLY):
        i = np.flatnonzero((width <= COSTLY) & (place + gap < width))
        found.append(np.stack([i, i + gap], 1) if ask is None else np.stack([i, i + gap], 1)[ask[i] | ask[i + gap]])
    i, j = np.concatenate(found).T
    turn = (n[i] > n[j]) | (n[i] == n[j]) & (node[i] > node[j])
    i, j = np.where(turn, j, i), np.where(turn, i, j)
    fits = n[i] * bands.den >= n[j] * bands.num
    i, j = i[fits], j[fits]
    order = np.lexsort((node[j], node[i]))
    i, j = i[order], j[order]
    head = np.flatnonzero(np.concatenate([[True], (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1])])) if len(i) else np.zeros(0, np.int64)
    return i[head], j[head], np.diff(np.append(head, len(i)))


def _collisions(bands: Bands):
    """For one bucket: sets that share a signature. kind 0: a pair (the smaller set first) and how many signatures it
    shares here. kind 1: each member of a costly signature's run."""

    def find(table: pa.Table) -> pa.Table:
        node, n, cost, sig, width, place = _runs(table)
        i, j, shared = _within(node, n, width, place, bands, cost > 0)
        hot = width > COSTLY
        both = lambda u, v: pa.array(np.concatenate([u, v]).astype(np.int64))
        k, h = len(i), int(hot.sum())
        none = np.zeros(h, np.int64)
        return pa.table({"kind": pa.array(np.repeat([0, 1], [k, h]).astype(np.int32)), "a": both(node[i], none), "b": both(node[j], node[hot]), "na": both(n[i], n[hot]), "nb": both(n[j], width[hot]), "c": both(shared, cost[hot]), "run": both(np.zeros(k, np.int64), sig[hot].astype(np.int64))})

    return find


def _shared_shingles(bands: Bands):
    """For one bucket of single shingles. kind 0: a pair that shares shingles which are not costly, and how many. kind 1:
    of a set, how many costly shingles it has here, and their hash (added bit by bit, so that buckets' add up)."""

    def find(table: pa.Table) -> pa.Table:
        node, n, _, sig, width, place = _runs(table)
        i, j, shared = _within(node, n, width, place, bands)
        hot = np.flatnonzero(width > COSTLY)
        hot = hot[np.argsort(node[hot], kind="stable")]
        head = np.flatnonzero(np.concatenate([[True], node[hot][1:] != node[hot][:-1]])) if len(hot) else np.zeros(0, np.int64)
        digest = np.bitwise_xor.reduceat(textvec.mix(sig[hot] + np.uint64(0xBB67AE8584CAA73B)), head).astype(np.int64) if len(hot) else head
        both = lambda u, v: pa.array(np.concatenate([u, v]).astype(np.int64))
        own = hot[head]
        return pa.table({"kind": pa.array(np.repeat([0, 1], [len(i), len(own)]).astype(np.int32)), "a": both(node[i], node[own]), "b": both(node[j], digest), "na": both(n[i], n[own]), "nb": both(n[j], n[own]), "c": both(shared, np.diff(np.append(head, len(hot))))})

    return find


def _rebuilt(docs: DataFrame, first: DataFrame, nodes: DataFrame, make, schema: str, width: int) -> DataFrame:
    """make(shingles, their set's number, node, n) over the sets of one document of each of `nodes` (`first`: node, doc_id).

    Documents are found by a filter of FILTER_RATE bits each, so a few others come along, or, where they are so many
    that the filter would be over FILTER_BITS, by a join.
    """
    ids = runtime.checkpoint(first.join(nodes.select("node").distinct(), "node").select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id")))
    count = ids.count()
    bits = 1 << max(20, (FILTER_RATE * count).bit_length())
    rows = runtime.pick(docs, "doc_id", "text").withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    if bits > FILTER_BITS:
        rows, shared = rows.join(ids, "doc_id", "left_semi").withColumn("p", F.lit(0)), None
    else:
        filled = np.zeros(bits // 8, np.uint8)
        position = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
        for r in ids.select(position.alias("p")).groupBy((F.col("p") / 32768).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("m")).toLocalIterator():
            filled[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(r["m"], np.uint8)
        rows, shared = rows.select("doc_id", "text", position.alias("p")), docs.sparkSession.sparkContext.broadcast(filled)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runtime.alone("near copies")
        for b in batches:
            own = np.arange(b.num_rows)
            if shared is not None:
                p = b.column(2).to_numpy(zero_copy_only=False)
                own = np.flatnonzero(shared.value[p >> 3] >> (p & 7).astype(np.uint8) & 1)
            if not len(own):
                continue
            data, off = runtime.utf8(b.column(1).take(pa.array(own)))
            for lo, hi in runtime.steps(off):
                x, of = sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
                n = np.bincount(of, minlength=hi - lo)
                out = make(x, of, identity(x, np.concatenate([[0], np.cumsum(n)]), n), n)
                if out is not None:
                    yield out
        runtime.trim()

    return rows.mapInArrow(rebuild, schema)


def _whole(x: np.ndarray, of: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    begin = 6 * np.concatenate([[0], np.cumsum(n)])
    raw = x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array([raw[begin[i] : begin[i + 1]] for i in range(len(n))], pa.binary())], ["node", "items"])


def verified(docs: DataFrame, first: DataFrame, pairs: DataFrame, bands: Bands, width: int = WIDTH) -> DataFrame:
    """a, b, similar for each pair of nodes, from the whole sets of one document of each (node, doc_id in `first`)."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    found = _rebuilt(docs, first, nodes, _whole, "node long, items binary", width)
    # written, so that the joins below are no more than joins, of which Spark splits large keys: a star has many arms
    found = runtime.fitted(runtime.checkpoint(found.where(F.col("node") != 0).groupBy("node").agg(F.first("items").alias("items"))))
    left = pairs.select("a", "b").join(found.withColumnRenamed("node", "a").withColumnRenamed("items", "x"), "a")
    both = left.join(found.withColumnRenamed("node", "b").withColumnRenamed("items", "y"), "b").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(v: bytes) -> np.ndarray:
            raw = np.zeros((len(v) // 6, 8), np.uint8)
            raw[:, 2:] = np.frombuffer(v, np.uint8).reshape(-1, 6)
            return raw.view(">u8").ravel().astype(np.uint64)

        for b in batches:
            out = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = read(x.as_py()), read(y.as_py())
                z = np.sort(np.concatenate([x, y]))
                common = int((z[1:] == z[:-1]).sum())
                out[i] = common * bands.den >= (len(x) + len(y) - common) * bands.num
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], ["a", "b", "similar"])

    return both.mapInArrow(compare, "a long, b long, similar boolean")


def _once() -> F.Column:
    """Whether this run is the one in which a and b are paired. `first_a` and `first_b` hold, for each of FIRSTS classes
    of runs, the least one in which a (b) looks. Where these agree, both are there, and the first such run pairs them; sets
    that agree nowhere are paired in each run that they share. So no pair is lost, and few are made more than once."""
    same = [F.when(F.get("first_a", k) == F.get("first_b", k), F.get("first_a", k)) for k in range(FIRSTS)]
    return F.coalesce(*same, F.col("run")) == F.col("run")


def _met(looks: DataFrame, there: DataFrame, fits: F.Column) -> DataFrame:
    """node_a, node_b: those of `looks` with those of `there` in the same run, of different groups."""
    return looks.join(there, "run").where((F.col("digest_a") != F.col("digest_b")) & _once() & fits).select("node_a", "node_b")


def _second(docs: DataFrame, first: DataFrame, asks: DataFrame, member: DataFrame, info: DataFrame, bands: Bands, width: int) -> DataFrame:
    """a, b: pairs left to verify, of the sets of `member` (run, node, n, root), of which `asks` (run, node) must look.

    Each shingle is now a segment. It is costly where more than COSTLY of these sets have it. Similar sets of different
    classes either share a shingle that is not costly, and are paired by it, or all that they share is costly. Of the
    latter kind each set has at least NUM/DEN of itself in costly shingles. Sets whose costly parts are equal form a
    group, and its smallest set stands for it: if A of one group and B of another are similar, then so are A and B's
    stand-in, both stand-ins, and A's stand-in and B, as they share as much and are no larger; in one group both are
    similar to its stand-in. So a set meets stand-ins alone, a row for each group in a run and not one for each set.
    """
    sets_ = runtime.checkpoint(member.select("node", "n", "root").distinct())
    total = sets_.agg(F.sum("n")).first()[0] or 0
    buckets = _buckets(total)

    def emit(x: np.ndarray, of: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
        return _packed(textvec.mix(x + np.uint64(0x3C6EF372FE94F82B)), of, np.zeros(len(x)), node, n, buckets) if len(x) else None

    found = _rebuilt(docs, first, sets_, emit, _PACKED, width).groupBy("bucket").applyInArrow(_shared_shingles(bands), "kind int, a long, b long, na long, nb long, c long")
    found = runtime.fitted(runtime.checkpoint(found))
    part = found.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("c").alias("p"), F.bit_xor("b").alias("digest"))
    sketch = F.array(*_SKETCH).alias("sketch")
    own = runtime.fitted(runtime.checkpoint(sets_.join(part, "node", "left").join(info.select("node", sketch), "node").select("node", "n", "root", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("digest", F.lit(0)).alias("digest"), "sketch")))
    end = lambda k: own.select(*[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "root", "p", "sketch")])
    apart = sum((F.bit_count(F.get("sketch_a", k).bitwiseXOR(F.get("sketch_b", k))) for k in range(SKETCH)), F.lit(0))
    both, least = F.col("n_a") + F.col("n_b"), F.least("p_a", "p_b")
    up = bands.num + bands.den
    # sketches that differ in more bits than similar sets differ in shingles rule a pair out
    fits = (F.col("root_a") != F.col("root_b")) & (apart * up <= both * (bands.den - bands.num))
    rare = found.where("kind = 0").groupBy(F.col("a").alias("node_a"), F.col("b").alias("node_b")).agg(F.sum("c").alias("c")).join(end("a"), "node_a").join(end("b"), "node_b")
    pairs = rare.where(fits & ((F.col("c") + least) * up >= both * bands.num)).select("node_a", "node_b")
    near = own.where(F.col("p") * bands.den >= F.col("n") * bands.num)
    one = near.groupBy("digest", "p").agg(F.min(F.struct("n", "node", "root", "sketch")).alias("o"))
    near = runtime.fitted(runtime.checkpoint(near.join(one, ["digest", "p"])))
    common = least * up >= both * bands.num
    side = lambda df, k, by=(), of="": df.select(*by, *[F.col(f"{of}{c}").alias(f"{c}_{k}") for c in ("node", "n", "root", "sketch")], F.col("p").alias(f"p_{k}"), F.col("digest").alias(f"digest_{k}"))
    inside = near.where("node != o.node").select("*", F.col("o.node").alias("x"))
    inside = side(inside, "a").join(side(near.select("digest", "p", "o").distinct(), "b", of="o."), (F.col("digest_a") == F.col("digest_b")) & (F.col("p_a") == F.col("p_b")) & (F.col("node_a") != F.col("node_b")))
    pairs = pairs.union(inside.where(fits & common).select("node_a", "node_b"))
    here = member.select("run", "node").join(near.select("node", "root", "digest", "p", F.col("o.root").alias("o_root")), "node")
    mixed = here.groupBy("run").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("o_root").alias("z"), F.max("o_root").alias("w")).where("least(x, z) != greatest(y, w)").select("run")
    here = here.join(mixed, "run", "left_semi").join(asks.select("run", "node", F.lit(True).alias("look")), ["run", "node"], "left")
    here = runtime.fitted(runtime.checkpoint(here.select("run", "node", "digest", "p", "look")))
    # the least run of each class in which a set looks, and in which any set of a group does
    least_runs = [F.min(F.when(F.pmod(F.xxhash64("run"), F.lit(FIRSTS)) == k, F.col("run"))).alias(f"r{k}") for k in range(FIRSTS)]
    runs = [f"r{k}" for k in range(FIRSTS)]
    own_runs = here.where("look").groupBy("node", "digest", "p").agg(*least_runs)
    group_runs = own_runs.groupBy("digest", "p").agg(*[F.min(c).alias(c) for c in runs]).select("digest", "p", F.array(*runs).alias("group_first"))
    near = near.join(own_runs.select("node", F.array(*runs).alias("first")), "node", "left").join(group_runs, ["digest", "p"], "left")
    here = runtime.fitted(runtime.checkpoint(here.select("run", "node", "look").join(near, "node")))
    looks = here.where("look")
    each = lambda df, k: side(df, k, ("run", F.col("first").alias(f"first_{k}")))
    group = lambda df, k: side(df.select("run", "digest", "p", "o", "group_first").distinct(), k, ("run", F.col("group_first").alias(f"first_{k}")), "o.")
    pairs = pairs.union(_met(each(looks, "a"), group(here, "b"), fits & common)).union(_met(group(looks, "a"), group(here, "b").union(each(here, "b")).distinct(), fits & common))
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _round(docs: DataFrame, sets_: DataFrame, first: DataFrame, bands: Bands, width: int) -> DataFrame:
    """The links (a, b) found with these bands: enough that components are those of all links."""
    total = sets_.agg(F.sum("n")).first()[0] or 0
    buckets = _buckets(total * 0.8 * bands.factor)
    found = packed_signatures(docs, bands, buckets, width).groupBy("bucket").applyInArrow(_collisions(bands), "kind int, a long, b long, na long, nb long, c long, run long")
    found = runtime.fitted(runtime.checkpoint(found))
    runtime.free_shuffles(docs.sparkSession)
    info = sets_.groupBy("node").agg(F.min("n").alias("n"), F.min("filled").alias("filled"), F.min("spare").alias("spare"), *[F.min(c).alias(c) for c in _SKETCH])
    hot = found.where("kind = 1").select("run", F.col("b").alias("node"), F.col("na").alias("n"), F.col("nb").alias("size"), F.col("c").alias("cost"))
    paid = hot.groupBy("node").agg(F.sum("cost").alias("paid"))
    info = runtime.fitted(runtime.checkpoint(info.join(paid, "node", "left").select("node", "n", "filled", "spare", F.coalesce("paid", F.lit(0)).alias("paid"), *_SKETCH)))
    # each shingle in which two sets differ spoils one segment at most, so similar sets share all but `errors` segments,
    # those that were costly, and so are not counted here, aside
    plain = found.where("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("shared"), F.max("nb").alias("nb"))
    plain = plain.join(info.select(F.col("node").alias("a"), "n", "filled", "paid"), "a")
    errors = F.floor((F.col("n") + F.col("nb")) * (bands.den - bands.num) / (bands.den + bands.num))
    pairs = plain.where(F.col("shared") + F.col("paid") >= F.col("filled") - errors).select("a", "b")
    # Arms of stars are a short cut: where they turn out to be links, whole groups are one class. The star of a run is
    # the set that shares most of itself with others: of edited copies that is what they were made from.
    common = info.select("node", (F.col("paid") / F.greatest("filled", F.lit(1))).alias("common"))
    stars = hot.select("run", "node").join(common, "node").groupBy("run").agg(F.max_by("node", F.struct("common", "node")).alias("star"))
    arms = hot.select("run", "node").join(stars, "run").where("star != node").groupBy("star", "node").agg(F.count("*").alias("shared"))
    arms = arms.join(info.select("node", "filled"), "node").where(F.col("shared") * 4 >= F.col("filled")).select(F.least("star", "node").alias("a"), F.greatest("star", "node").alias("b"))
    pairs = runtime.fitted(runtime.checkpoint(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(arms).distinct()))
    seen = runtime.fitted(runtime.checkpoint(verified(docs, first, pairs, bands, width)))
    runtime.free_shuffles(docs.sparkSession)
    links = seen.where("similar").select("a", "b")
    # a set that can afford it gives its costliest signatures no allowance; in the others it must look
    asks = hot.where("cost > 0").join(info.where("paid > spare").select("node", "spare"), "node")
    asks = asks.withColumn("skipped", F.sum("cost").over(Window.partitionBy("node").orderBy(F.desc("size"), "run").rowsBetween(Window.unboundedPreceding, 0)))
    asks = runtime.checkpoint(asks.where(F.col("skipped") > F.col("spare")).select("run", "node"))
    if asks.isEmpty():
        return links
    asks = runtime.fitted(asks)
    roots = components.components(links)
    member = hot.join(asks.select("run").distinct(), "run", "left_semi").select("run", "node", "n").join(roots, "node", "left").select("run", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = member.groupBy("run").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("run")
    member = runtime.checkpoint(member.join(mixed, "run", "left_semi"))
    if member.isEmpty():
        return links
    member = runtime.fitted(member)
    more = runtime.checkpoint(_second(docs, first, asks.join(mixed, "run", "left_semi"), member, info, bands, width).join(seen, ["a", "b"], "left_anti"))
    if more.isEmpty():
        return links
    return links.union(verified(docs, first, runtime.fitted(more), bands, width).where("similar").select("a", "b"))


def _classes(docs: DataFrame, num: int, den: int, width: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, node, text_hash of each row; and node, root: the class of each set."""
    bands = Bands(num, den)
    sets_ = runtime.fitted(runtime.checkpoint(described(docs, bands, width)))
    filled = sets_.where("node != 0")
    first = runtime.fitted(runtime.checkpoint(filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"))))
    links = _round(docs, filled, first, bands, width)
    short = sorted(r["band"] for r in filled.where("spare < 0").select(F.floor(F.log2("n")).cast("int").alias("band")).distinct().collect())
    factor = 1
    while short:  # sets that chance left with too few filled segments
        factor *= 4
        again = Bands(num, den, factor, tuple(short))
        now = runtime.fitted(runtime.checkpoint(described(docs, again, width).where("node != 0")))
        links = links.union(_round(docs, now, first, again, width))
        short = sorted(r["band"] for r in now.where("spare < 0").select(F.floor(F.log2("n")).cast("int").alias("band")).distinct().collect() if r["band"] in short)
    roots = components.components(links)
    return sets_, first.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def join(docs: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id of every whole text.

    component_id is the smallest doc_id that links reach, the document's own included. A null or empty text, or one
    without words, has no shingle and no link. Texts of equal sets are linked. A null id counts as larger than any.
    Repeated rows each get a row. Other columns are not looked at. An empty table gives no rows.
    """
    sets_, roots = _classes(docs, num, den, width)
    ids = sets_.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(roots, "node")
    named = runtime.fitted(runtime.checkpoint(ids.select("node", "root", "doc_id")))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id")
    return sets_.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH) -> DataFrame:
    """Of each class the row of the smallest id, with all its columns, whatever they are called.

    A null id counts as larger than any. Of rows of one id in a class that of the least hash of its text stays, and of
    rows that repeat one id and text the one of the least hash of all columns; rows of one id in different classes all
    stay, as their texts differ. Rows without a word are in no class and stay. An empty table gives no rows.
    """
    sets_, roots = _classes(docs, num, den, width)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = sets_.where("node != 0").join(roots, "node").select("root", key.alias("key"))
    best = rows.groupBy("root").agg(F.min("key").alias("key"))
    kept = runtime.fitted(runtime.checkpoint(best.select("key.doc_id", "key.text_hash", "root")))
    repeated = not rows.groupBy("root", "key").count().where("count > 1").isEmpty()
    runtime.free_shuffles(docs.sparkSession)  # whole rows are dealt out next
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    id_, text = F.col(f"_c{names.index('doc_id')}"), F.col(f"_c{names.index('text')}")
    flat = flat.withColumn("_h", F.xxhash64(F.coalesce(text, F.lit("")))).withColumn("_worded", F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    out = flat.where("_worded").join(kept, id_.eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("text_hash")), "left_semi")
    if repeated:
        order = Window.partitionBy(id_, "_h").orderBy(F.xxhash64(*[f"_c{i}" for i in range(len(names))]))
        out = out.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    return out.union(flat.where("NOT _worded")).drop("_h", "_worded").toDF(*names)
