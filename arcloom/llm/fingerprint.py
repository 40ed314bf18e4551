"""Order MinHash fingerprints, in DataFrame functions alone.

A text is cut into tokens (runs of at most TOKEN_CHARS characters that are not white space); its k-mers are the runs of
K tokens, or the whole sequence where there are fewer. Equal k-mers of a text are told apart by their occurrence
numbers. The hash of (k-mer, occurrence number) falls into one of BINS bins by its leading bits. Of each bin the TUPLE
smallest hashes are kept, put back into their order in the text, and hashed as one tuple. The fingerprint is the list
of bins with their tuple hashes, and the likeness of two is the share of the bins, used in either, that agree. Moving
text about changes the order inside the tuples, so that likeness follows edit distance and not the set of k-mers alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

K, BIN_BITS, TOKEN_CHARS = 2, 6, 12
#: Of a packed 64-bit number: bits of the hash, and of the place in the text below them.
HASH_BITS, PLACE_BITS = 34, 29
_PLACE = (1 << PLACE_BITS) - 1


def _packed(h: Column, place: Column) -> Column:
    """The hash's HASH_BITS bits above the place: sorting such numbers sorts by hash, then by place."""
    return F.shiftleft(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)), PLACE_BITS).bitwiseOR(place.cast("long"))


def _bin(x: Column) -> Column:
    return F.shiftright(x, HASH_BITS + PLACE_BITS - BIN_BITS)


def kmers(text: Column) -> Column:
    """Each k-mer's hash, packed with its place."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S{1,%d}" % TOKEN_CHARS), F.lit(0))
    last = lambda t: F.greatest(F.size(t) - K, F.lit(0))
    # let-binding by a one-element transform: the tokens are made once
    return F.element_at(
        F.transform(
            F.array(tokens),
            lambda t: F.when(F.size(t) == 0, F.array().cast("array<long>")).otherwise(
                F.transform(F.slice(t, 1, last(t) + 1), lambda x, i: _packed(F.xxhash64(x, *[F.get(t, i + j) for j in range(1, K)]), i))
            ),
        ),
        1,
    )


def _numbered(s: Column) -> Column:
    """From the sorted packed k-mers, the packed hashes of (k-mer, occurrence number)."""
    same = lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)
    n = F.size(s)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~same(F.get(s, i), F.get(s, F.greatest(i - 1, F.lit(0)))))
    bound = F.transform(
        F.array(F.named_struct(F.lit("s"), s, F.lit("b"), starts)),
        lambda x: F.transform(
            F.arrays_zip(x["s"].alias("v"), F.flatten(F.transform(x["b"], lambda v, j: F.sequence(F.lit(1), F.coalesce(F.get(x["b"], j + 1), F.size(x["s"])) - v))).alias("o")),
            lambda y: _packed(F.xxhash64(F.shiftright(y["v"], PLACE_BITS), y["o"]), y["v"].bitwiseAND(F.lit(_PLACE))),
        ),
    )
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(F.element_at(bound, 1))


def _tuples(s: Column) -> Column:
    """From the sorted packed hashes, each used bin with its tuple's hash: two smallest of the bin, in text order."""
    first = F.filter(s, lambda x, i: (i == 0) | (_bin(F.get(s, F.greatest(i - 1, F.lit(0)))) != _bin(x)))
    nexts = F.filter(s, lambda x, i: (i > 0) & (_bin(F.get(s, F.greatest(i - 1, F.lit(0)))) == _bin(x)) & ((i == 1) | (_bin(F.get(s, F.greatest(i - 2, F.lit(0)))) != _bin(x))))
    seconds = F.map_from_arrays(F.transform(nexts, _bin), nexts)

    def sketch(x: Column, m: Column) -> Column:
        y = F.try_element_at(m, _bin(x))
        hx, hy = F.shiftright(x, PLACE_BITS), F.shiftright(y, PLACE_BITS)
        in_order = x.bitwiseAND(F.lit(_PLACE)) < y.bitwiseAND(F.lit(_PLACE))
        h = F.when(y.isNull(), F.xxhash64(hx)).when(in_order, F.xxhash64(hx, hy)).otherwise(F.xxhash64(hy, hx))
        return F.concat(F.lpad(F.hex(_bin(x)), 2, "0"), F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFFFF))), 10, "0"))

    return F.element_at(F.transform(F.array(F.named_struct(F.lit("f"), first, F.lit("m"), seconds)), lambda z: F.transform(z["f"], lambda x: sketch(x, z["m"]))), 1)


def _let(value: Column, use) -> Column:
    """use(value), the value being computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketches(text: Column) -> Column:
    """The used bins with their tuple hashes, as 12 hexadecimal digits each; empty for a text without tokens."""
    return _let(F.array_sort(kmers(text)), lambda s: _let(F.array_sort(_numbered(s)), _tuples))


def fingerprint(sketch: Column) -> Column:
    return F.array_join(sketch, " ")


def likeness(a: Column, b: Column) -> Column:
    """The share of the bins used in either that agree; 1 for two empty sketches."""
    used = F.size(F.array_union(F.transform(a, lambda x: F.substring(x, 1, 2)), F.transform(b, lambda x: F.substring(x, 1, 2))))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def with_next(docs: DataFrame, rows_per_range: int = 200, inner: int = 128) -> DataFrame:
    """Each document with its sketch, and the text and the sketch of the next one by descending doc_id; after the last
    comes the first.

    The ids are cut into ranges at quantiles, so that a window over one range sees that range alone; the document
    that a range's last needs is the first of the range below, of which there is one a range. Documents of one id
    follow each other by text, descending. A null id stands after all others.
    """
    docs = runtime.pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    n = docs.select("doc_id").count()
    ranges = int(min(16384, max(1, n // rows_per_range)))
    bounds = docs.agg(F.percentile_approx("doc_id", [(i + 1) / ranges for i in range(ranges - 1)] or [0.5], 20 * ranges).alias("b")).first()["b"] or []
    bounds = sorted({*bounds})
    longs = lambda x: F.array(*[F.lit(v).cast("long") for v in x])
    number = F.lit(0)
    if bounds:
        block = F.size(F.filter(longs(bounds[::inner]), lambda b: b <= F.col("doc_id")))
        within = F.array(*[longs(bounds[i : i + inner]) for i in range(0, len(bounds), inner)])
        number = F.when(block == 0, 0).otherwise((block - 1) * inner + F.size(F.filter(F.get(within, block - 1), lambda b: b <= F.col("doc_id"))))
    dealt = docs.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(number))
    w = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    own = dealt.select("doc_id", "text", "range", sketches(F.col("text")).alias("sketch"))
    rows = own.select("*", F.lead(F.struct("text", "sketch")).over(w).alias("next"))
    # a row for each of the ranges, whose number is bounded; in descending order, each with the one below
    ids = dealt.groupBy("range").agg(F.max("doc_id").alias("head"))
    below = ids.select(F.coalesce(F.lead("range").over(Window.orderBy(F.desc("range"))), F.max("range").over(Window.orderBy(F.asc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("below"), "range")
    heads = dealt.join(F.broadcast(ids.select(F.col("range").alias("r"), "head")), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("head"))).groupBy(F.col("range").alias("below")).agg(F.max("text").alias("after"))
    after = below.join(heads, "below").select("range", "after")
    rows = rows.join(after, "range", "left")
    return rows.select("doc_id", "text", "sketch", F.coalesce(F.col("next")["text"], "after", F.lit("")).alias("next_text"), F.coalesce(F.col("next")["sketch"], sketches(F.col("after"))).alias("next_sketch"))


def half_replaced(text: Column, next_text: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many, or all, of the next text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))
