"""Message passing: nodes onto edges, a message, an aggregate for each destination.

`propagate` is the primitive that every layer is made of. Vectors rest as ARRAY<DOUBLE>. A sum of vectors is taken
place by place inside one aggregate (`sum_vectors`), so that partial sums shrink the shuffle and no long form is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.functions.durable import durable
from arcloom.functions.portable import added, dot, linear, relu, scaled
from arcloom.operators import edges as E


def sum_vectors(vector: Column | str, width: int) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.array(*[F.coalesce(F.sum(F.get(v, i)), F.lit(0.0)) for i in range(width)])


def mean_vectors(vector: Column | str, width: int) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.array(*[F.coalesce(F.avg(F.get(v, i)), F.lit(0.0)) for i in range(width)])


def max_vectors(vector: Column | str, width: int) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.array(*[F.coalesce(F.max(F.get(v, i)), F.lit(0.0)) for i in range(width)])


AGGREGATES = {"sum": sum_vectors, "add": sum_vectors, "mean": mean_vectors, "max": max_vectors}


def zeros(width: int) -> Column:
    return F.array(*[F.lit(0.0)] * width)


def propagate(nodes: DataFrame, edges: DataFrame, width: int, message: Callable[[Column, Column, Column], Column] | None = None, agg: str = "sum", flow: str = "source_to_target") -> DataFrame:
    """id, x: for each node the aggregate over its incoming edges of message(x of the sender, x of the receiver, w).

    The default message is w * x of the sender; a receiver's own x is joined only where a message asks for it. Nodes
    without edges get zeros. `target_to_source` turns the edges round.
    """
    if flow == "target_to_source":
        edges = E.reversed_(edges)
    j = edges.join(nodes.select(F.col("id").alias("src"), F.col("x").alias("x_j")), "src")
    if message is None:
        value = scaled(F.col("x_j"), F.col("w"))
    else:
        j = j.join(nodes.select(F.col("id").alias("dst"), F.col("x").alias("x_i")), "dst")
        value = message(F.col("x_j"), F.col("x_i"), F.col("w"))
    out = j.select("dst", value.alias("m")).groupBy(F.col("dst").alias("id")).agg(AGGREGATES[agg]("m", width).alias("x"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("x", zeros(width)).alias("x"))


def spmm(nodes: DataFrame, edges: DataFrame, width: int, transpose: bool = True) -> DataFrame:
    """transpose: the sum over incoming edges (A^T X); else over outgoing ones (A X)."""
    return propagate(nodes, edges, width, flow="source_to_target" if transpose else "target_to_source")


def spmm_compressed(nodes: DataFrame, layout: DataFrame, width: int) -> DataFrame:
    """The same from a compressed layout (id, place, other, w): each row's run of places is summed."""
    own = layout.join(nodes.select(F.col("id").alias("other"), F.col("x").alias("x_j")), "other")
    out = own.groupBy("id").agg(sum_vectors(scaled(F.col("x_j"), F.col("w")), width).alias("x"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("x", zeros(width)).alias("x"))


def spmm_blocks(nodes: DataFrame, edges: DataFrame, width: int, blocks: int) -> DataFrame:
    """The same from blocks: each block of senders gives a partial product, and the partial products are added up. A
    receiver of very many senders is summed in `blocks` tasks first."""
    sent = nodes.select(F.col("id").alias("src"), F.col("x").alias("x_j"))
    j = edges.join(sent, "src").select("dst", F.pmod(F.col("src"), F.lit(blocks)).alias("block"), scaled(F.col("x_j"), F.col("w")).alias("m"))
    partial = j.groupBy("dst", "block").agg(sum_vectors("m", width).alias("m"))
    out = partial.groupBy(F.col("dst").alias("id")).agg(sum_vectors("m", width).alias("x"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("x", zeros(width)).alias("x"))


def four_steps(nodes: DataFrame, edges: DataFrame, width: int, on_edge: Callable[[Column, Column], Column], on_vertex: Callable[[Column], Column], end: str = "src") -> DataFrame:
    """Scatter one end's x to the edges, on_edge(x, w) there, sum to the other end, on_vertex(sum) there."""
    other = "dst" if end == "src" else "src"
    carried = edges.join(nodes.select(F.col("id").alias(end), "x"), end)
    formed = carried.select(F.col(other).alias("id"), on_edge(F.col("x"), F.col("w")).alias("m"))
    summed = formed.groupBy("id").agg(sum_vectors("m", width).alias("x"))
    return nodes.select("id").join(summed, "id", "left").select("id", on_vertex(F.coalesce("x", zeros(width))).alias("x"))


def gcn_norm(edges: DataFrame, nodes: DataFrame, fill: float = 1.0, loops: bool = True) -> DataFrame:
    """deg(src)^-1/2 * w * deg(dst)^-1/2 with degrees by destination; 0 where a degree is 0."""
    e = E.add_remaining_self_loops(edges, nodes, fill) if loops else edges.select("src", "dst", "w")
    deg = e.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("deg"))
    s, d = deg.select(F.col("id").alias("src"), F.col("deg").alias("ds")), deg.select(F.col("id").alias("dst"), F.col("deg").alias("dd"))
    j = e.join(s, "src", "left").join(d, "dst", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return j.select("src", "dst", (E.inverse_power(zero("ds"), -0.5) * F.col("w") * E.inverse_power(zero("dd"), -0.5)).alias("w"))


def sage_norm(edges: DataFrame) -> DataFrame:
    """w over the degree of the destination."""
    deg = edges.groupBy("dst").agg(F.sum("w").alias("dd"))
    return edges.join(deg, "dst").select("src", "dst", (F.col("w") * E.inverse_power(F.col("dd"), -1.0)).alias("w"))


def cluster_norm(edges: DataFrame, nodes: DataFrame, boost: float = 0.0) -> DataFrame:
    """w over the degree of the source, loops made stronger by `boost` times their own value."""
    e = E.add_remaining_self_loops(edges, nodes)
    deg = degrees_by_destination(e)
    j = e.join(deg.select(F.col("id").alias("src"), "deg"), "src", "left")
    w = F.col("w") * E.inverse_power(F.coalesce("deg", F.lit(0.0)), -1.0)
    return j.select("src", "dst", F.when(F.col("src") == F.col("dst"), w * (1 + boost)).otherwise(w).alias("w"))


def degrees_by_destination(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("deg"))


def mapped(nodes: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return nodes.select("id", fn(F.col("x")).alias("x"))


def mixed(a: DataFrame, b: DataFrame, fa: float, fb: float) -> DataFrame:
    """fa * a + fb * b, node by node."""
    j = a.join(b.select("id", F.col("x").alias("y")), "id")
    return j.select("id", F.zip_with("x", "y", lambda u, v: u * fa + v * fb).alias("x"))


def gcn_conv(nodes, edges, weights, bias=None):
    """A (X W) + b: the narrow side is propagated."""
    w = len(weights[0])
    out = propagate(mapped(nodes, lambda x: linear(x, weights)), gcn_norm(edges, nodes), w)
    return mapped(out, lambda x: added(x, F.array(*[F.lit(float(v)) for v in (bias or [0.0] * w)])))


def gcn_conv_columns(nodes, edges, weights, bias, parts: int):
    """The same with the columns of X W split into `parts`, each propagated for itself, as where they are too many for
    one row; the adjacency is written once."""
    a, w = durable(gcn_norm(edges, nodes)), len(weights[0])
    cuts = [w * k // parts for k in range(parts + 1)]
    whole = nodes.select("id")
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if hi > lo:
            own = propagate(mapped(nodes, lambda x, lo=lo, hi=hi: linear(x, [row[lo:hi] for row in weights])), a, hi - lo)
            whole = whole.join(own.select("id", F.col("x").alias(f"x{k}")), "id")
    return whole.select("id", added(F.concat(*[c for c in whole.columns if c != "id"]), F.array(*[F.lit(float(v)) for v in bias])).alias("x"))


def hops(nodes: DataFrame, adjacency: DataFrame, k: int, width: int) -> list[DataFrame]:
    """[X, AX, ..., A^k X]. The adjacency is made and written once, and each step too where others build on it."""
    out = [nodes.select("id", "x")]
    if k > 1:
        adjacency = durable(adjacency)
    for i in range(k):
        x = propagate(out[-1], adjacency, width)
        out.append(durable(x) if i < k - 1 else x)
    return out


def sg_conv(nodes, edges, k, weights, bias=None):
    x = hops(nodes, gcn_norm(edges, nodes), k, 2)[-1]
    return mapped(x, lambda v: linear(v, weights, bias))


def appnp(nodes, edges, k, alpha, width):
    """x <- (1 - alpha) A x + alpha h, k times."""
    a = durable(gcn_norm(edges, nodes))
    x = nodes.select("id", "x")
    for i in range(k):
        x = mixed(propagate(x, a, width), nodes.select("id", "x"), 1 - alpha, alpha)
        x = durable(x) if i < k - 1 else x
    return x


def polynomial(tokens: list[DataFrame], coefficients: list[float], width: int) -> DataFrame:
    """The sum of coefficient times basis, as one aggregate over the union."""
    parts = [t.select("id", scaled(F.col("x"), F.lit(float(c))).alias("x")) for t, c in zip(tokens, coefficients, strict=True) if c]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole.groupBy("id").agg(sum_vectors("x", width).alias("x"))


def gpr_coefficients(kind: str, alpha: float, k: int) -> list[float]:
    if kind == "SGC":
        return [float(i == int(alpha)) for i in range(k + 1)]
    if kind == "PPR":
        return [alpha * (1 - alpha) ** i for i in range(k)] + [(1 - alpha) ** k]
    if kind == "NPPR":
        raw = [alpha**i for i in range(k + 1)]
        total = sum(map(abs, raw))
        return [v / total for v in raw]
    raise ValueError(kind)


def gprgnn(nodes, edges, k, alpha, width, kind="PPR"):
    return polynomial(hops(nodes, gcn_norm(edges, nodes), k, width), gpr_coefficients(kind, alpha, k), width)


def bernstein(nodes, edges, theta: list[float], width: int):
    """Sum over i of C(K,i)/2^K * theta_i * (2I-L)^(K-i) L^i x, with the symmetric Laplacian L."""
    from math import comb

    k = len(theta) - 1
    lap = durable(E.laplacian(edges, nodes, "sym"))
    rest = lap.select("src", "dst", (-F.col("w")).alias("w")).unionAll(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(2.0).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    powers = [nodes.select("id", "x")]
    rest = durable(rest)
    for _ in range(k):
        powers.append(durable(propagate(powers[-1], rest, width)))
    terms = []
    for i in range(k + 1):
        x = powers[k - i]
        for _ in range(i):
            x = propagate(x, lap, width)
        terms.append(x)
    return polynomial(terms, [comb(k, i) / 2**k * theta[i] for i in range(k + 1)], width)


def scaled_laplacian(edges, nodes, lambda_max: float | None = 2.0):
    """2 L / lambda_max - I, with the symmetric Laplacian."""
    lap = E.laplacian(edges, nodes, "sym")
    return lap.select("src", "dst", (F.col("w") * (2.0 / lambda_max)).alias("w")).unionAll(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(-1.0).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def chebyshev_basis(nodes, operator, k, width):
    """T_0 x .. T_k x by the three-term recurrence."""
    basis = [nodes.select("id", "x")]
    if k > 1:
        operator = durable(operator)
    if k:
        first = propagate(basis[0], operator, width)
        basis.append(durable(first) if k > 1 else first)
    for i in range(k - 1):
        x = mixed(propagate(basis[-1], operator, width), basis[-2], 2.0, -1.0)
        basis.append(durable(x) if i < k - 2 else x)
    return basis


def cheb_conv(nodes, edges, coefficients, width):
    return polynomial(chebyshev_basis(nodes, scaled_laplacian(edges, nodes), len(coefficients) - 1, width), coefficients, width)


def interpolation_coefficients(values: list[float]) -> list[float]:
    """Chebyshev coefficients of the polynomial that takes the values at the Chebyshev nodes."""
    from math import cos, pi

    k = len(values) - 1
    at = [cos((j + 0.5) * pi / (k + 1)) for j in range(k + 1)]

    def t(i: int, x: float) -> float:
        a, b = 1.0, x
        if i == 0:
            return a
        for _ in range(i - 1):
            a, b = b, 2 * x * b - a
        return b

    out = [2 / (k + 1) * sum(v * t(i, x) for v, x in zip(values, at, strict=True)) for i in range(k + 1)]
    return [out[0] / 2, *out[1:]]


def chebnet2(nodes, edges, values, width):
    return cheb_conv(nodes, edges, interpolation_coefficients(values), width)


def even_net(nodes, edges, k, alpha, width):
    """PPR coefficients on even hops alone."""
    c = [v if i % 2 == 0 else 0.0 for i, v in enumerate(gpr_coefficients("PPR", alpha, k))]
    return polynomial(hops(nodes, gcn_norm(edges, nodes), k, width), c, width)


def sage_conv(nodes, edges, w_near, w_own, bias=None):
    """mean of the neighbours W1 + x W2 + b."""
    near = propagate(nodes, edges.select("src", "dst", F.lit(1.0).alias("w")), 2, agg="mean").select("id", F.col("x").alias("m"))
    j = nodes.select("id", "x").join(near, "id")
    return j.select("id", added(linear(F.col("m"), w_near, bias), linear(F.col("x"), w_own)).alias("x"))


def cluster_gcn_conv(nodes, edges, boost, w_out, w_root):
    near = propagate(nodes, cluster_norm(edges, nodes, boost), 2).select("id", F.col("x").alias("m"))
    return nodes.select("id", "x").join(near, "id").select("id", added(linear(F.col("m"), w_out), linear(F.col("x"), w_root)).alias("x"))


def edge_softmax(scored: DataFrame, by: tuple[str, ...] = ("dst",), score: str = "score") -> DataFrame:
    """alpha: the softmax of a score among the edges of each destination, shifted by the maximum."""
    top = scored.groupBy(*by).agg(F.max(score).alias("_top"))
    shifted = scored.join(top, list(by)).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = shifted.groupBy(*by).agg(F.sum("_e").alias("_sum"))
    return shifted.join(total, list(by)).withColumn("alpha", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def gat_conv(nodes, edges, weights, a_src, a_dst, slope=0.2):
    """relu(X W); leaky score of both ends; softmax by destination; weighted sum of the senders."""
    h = mapped(nodes, lambda x: relu(linear(x, weights)))
    width = len(weights[0])
    vec = lambda a: F.array(*[F.lit(float(v)) for v in a])
    j = edges.select("src", "dst").join(h.select(F.col("id").alias("src"), F.col("x").alias("x_j")), "src").join(h.select(F.col("id").alias("dst"), F.col("x").alias("x_i")), "dst")
    raw = dot(F.col("x_j"), vec(a_src)) + dot(F.col("x_i"), vec(a_dst))
    scored = j.withColumn("score", F.when(raw > 0, raw).otherwise(raw * slope))
    out = edge_softmax(scored).groupBy(F.col("dst").alias("id")).agg(sum_vectors(scaled(F.col("x_j"), F.col("alpha")), width).alias("x"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("x", zeros(width)).alias("x"))


def gcn2_conv(nodes, edges, alpha, beta, w1, w2):
    """(1-b)(1-a) A x + b A x W1 + (1-b) a x0 + b x0 W2."""
    near = propagate(nodes, gcn_norm(edges, nodes), 2).select("id", F.col("x").alias("m"))
    j = nodes.select("id", "x").join(near, "id")
    first = added(scaled(F.col("m"), F.lit((1 - beta) * (1 - alpha))), scaled(linear(F.col("m"), w1), F.lit(beta)))
    second = added(scaled(F.col("x"), F.lit((1 - beta) * alpha)), scaled(linear(F.col("x"), w2), F.lit(beta)))
    return j.select("id", added(first, second).alias("x"))


def transformer_conv(nodes, edges, wq, wk, wv, width):
    """Scaled dot attention on edges, normalised for each destination."""
    q = mapped(nodes, lambda x: linear(x, wq)).select(F.col("id").alias("dst"), F.col("x").alias("q"))
    kv = nodes.select(F.col("id").alias("src"), linear(F.col("x"), wk).alias("k"), linear(F.col("x"), wv).alias("v"))
    scored = edges.select("src", "dst").join(kv, "src").join(q, "dst").withColumn("score", dot(F.col("q"), F.col("k")) / (width**0.5))
    out = edge_softmax(scored).groupBy(F.col("dst").alias("id")).agg(sum_vectors(scaled(F.col("v"), F.col("alpha")), width).alias("x"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("x", zeros(width)).alias("x"))


def ppr(nodes, edges, alpha, k, width):
    """alpha * sum over i of (1-alpha)^i A^i x: the power series of personalised PageRank, cut after k terms."""
    a = gcn_norm(E.to_undirected(edges, "max"), nodes)
    return polynomial(hops(nodes, a, k, width), [alpha * (1 - alpha) ** i for i in range(k + 1)], width)


def opt_basis(nodes, edges, k, width):
    """Basis vectors orthogonal in each column, by the three-term recurrence with column norms."""
    a = gcn_norm(edges, nodes)

    def unit(x: DataFrame) -> DataFrame:
        n = x.agg(F.array(*[F.sqrt(F.sum(F.get("x", i) * F.get("x", i))) for i in range(width)]).alias("n"))
        return x.crossJoin(F.broadcast(n)).select("id", F.zip_with("x", "n", lambda v, s: F.when(s > 0, v / s).otherwise(0.0)).alias("x"))

    def minus(x: DataFrame, h: DataFrame) -> DataFrame:
        j = x.join(h.select("id", F.col("x").alias("h")), "id")
        d = j.agg(F.array(*[F.sum(F.get("x", i) * F.get("h", i)) for i in range(width)]).alias("d"))
        return j.crossJoin(F.broadcast(d)).select("id", F.transform(F.arrays_zip("x", "h", "d"), lambda t: t["x"] - t["h"] * t["d"]).alias("x"))

    a = durable(a)
    basis = [durable(unit(nodes.select("id", "x")))]
    for _ in range(k):
        x = durable(propagate(basis[-1], a, width))
        x = minus(x, basis[-1])
        if len(basis) > 1:
            x = minus(x, basis[-2])
        basis.append(durable(unit(x)))
    return basis
