"""Point clouds: radius graphs, triplets, angles, and radial functions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tasks for each shuffle partition over which points and stars are dealt: what comes of them grows with
#: their square and more.
SPREAD = 4


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys over a number of tasks that adaptive execution keeps, as small rows give very many."""
    spark = df.sparkSession
    return df.repartition(SPREAD * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def radius_graph(points: DataFrame, r: float, inclusive: bool = False, loop: bool = False, most: int | None = None, places: bool = False) -> DataFrame:
    """i, j, dist of points (gid, id, x, y, z) of one graph nearer than r.

    A grid of cells as wide as r: a point is listed in its own cell, its partners in the 27 around it, so the join is on
    equality and sees near points alone. With `most`, the first that many j by index of each i; with `places`, the
    coordinates of both as well.
    """
    cell = lambda c: F.floor(F.col(c) / r).cast("long")
    own = points.select("gid", F.col("id").alias("i"), *[F.col(c).alias(f"{c}i") for c in "xyz"], cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in product((-1, 0, 1), repeat=3)])
    other = points.withColumn("s", F.explode(near)).select("gid", F.col("id").alias("j"), *[F.col(c).alias(f"{c}j") for c in "xyz"], (cell("x") + F.col("s")["a"]).alias("cx"), (cell("y") + F.col("s")["b"]).alias("cy"), (cell("z") + F.col("s")["c"]).alias("cz"))
    cells = ["gid", "cx", "cy", "cz"]  # few rows give very many pairs, so they are dealt over more tasks than their size asks for
    j = _dealt(own, *cells).join(_dealt(other, *cells).hint("merge"), cells)
    d = F.sqrt(sum(((F.col(f"{c}i") - F.col(f"{c}j")) * (F.col(f"{c}i") - F.col(f"{c}j")) for c in "xyz"), F.lit(0.0)))
    j = j.withColumn("dist", d).where(F.col("dist") <= r if inclusive else F.col("dist") < r)
    if not loop:
        j = j.where("i <> j")
    if most is not None:
        j = j.withColumn("_k", F.row_number().over(Window.partitionBy("gid", "i").orderBy("j"))).where(F.col("_k") <= most)
    return j.select("gid", "i", "j", "dist", *([f"{c}{e}" for e in "ij" for c in "xyz"] if places else []))


def triplets(edges: DataFrame) -> DataFrame:
    """gid, k, j, i: paths k -> j -> i with k <> i."""
    first = edges.select("gid", F.col("src").alias("k"), F.col("dst").alias("j"))
    second = edges.select("gid", F.col("src").alias("j"), F.col("dst").alias("i"))
    return first.join(second, ["gid", "j"]).where("k <> i").select("gid", "k", "j", "i")


def stars(points: DataFrame, r: float) -> DataFrame:
    """gid, j, x, y, z and `near`, the points (id, x, y, z) nearer than r, of each point that has any. Triplets and torsions
    come from stars inside the row; only edges are shuffled, with the coordinates that angles need."""
    e = radius_graph(points, r, places=True)
    own = e.select("gid", F.col("i").alias("j"), *[F.col(f"{c}i").alias(c) for c in "xyz"], F.struct(F.col("j").alias("id"), *[F.col(f"{c}j").alias(c) for c in "xyz"]).alias("s"))
    return _dealt(own, "gid", "j").groupBy("gid", "j").agg(*[F.first(c).alias(c) for c in "xyz"], F.collect_list("s").alias("near"))


def star_triplets(star: DataFrame) -> DataFrame:
    """gid, k, j, i: paths k -> j -> i with k <> i of a radius graph, and a (j to k) and b (j to i) as ax .. bz."""
    rel = lambda v, n: [(F.col(f"{v}.{c}") - F.col(c)).alias(f"{n}{c}") for c in "xyz"]
    one = star.select("gid", "j", *"xyz", "near", F.explode("near").alias("_k"))
    one = one.select("gid", "j", *"xyz", "near", F.col("_k.id").alias("k"), *rel("_k", "a"))
    two = one.select("gid", "j", "k", *"xyz", "ax", "ay", "az", F.explode("near").alias("_i")).where("k <> _i.id")
    return two.select("gid", "k", "j", F.col("_i.id").alias("i"), "ax", "ay", "az", *rel("_i", "b"))


def star_torsions(star: DataFrame) -> DataFrame:
    """gid, k, j, i, l, torsion: of all paths k -> j -> i -> l of different ends, about (j, i). A star meets that of each of
    its points once; the plane of k, j and i is worked out once for all l."""
    arm = star.select("gid", "j", *[F.col(c).alias(f"{c}j") for c in "xyz"], "near", F.explode("near").alias("_i"))
    arm = arm.select("gid", "j", *[f"{c}j" for c in "xyz"], "near", F.col("_i.id").alias("i"), *[F.col(f"_i.{c}").alias(f"{c}i") for c in "xyz"])
    met = _dealt(arm, "gid", "i").join(_dealt(star.select("gid", F.col("j").alias("i"), F.col("near").alias("far")), "gid", "i").hint("merge"), ["gid", "i"])
    g = {c: F.col(f"{c}i") - F.col(f"{c}j") for c in "xyz"}
    one = met.select("gid", "j", "i", *[F.col(f"{c}j") for c in "xyz"], *[F.col(f"{c}i") for c in "xyz"], *[v.alias(f"g{c}") for c, v in g.items()], "far", F.explode("near").alias("_k")).where("_k.id <> i")
    f = [F.col(f"{c}j") - F.col(f"_k.{c}") for c in "xyz"]
    gs = [F.col(f"g{c}") for c in "xyz"]
    one = one.select("gid", "j", "i", *[f"{c}i" for c in "xyz"], *[f"g{c}" for c in "xyz"], "far", F.col("_k.id").alias("k"), *[v.alias(f"p{c}") for c, v in zip("xyz", _cross(f, gs), strict=True)])
    two = one.select("gid", "k", "j", "i", *[f"{c}i" for c in "xyz"], *[f"g{c}" for c in "xyz"], *[f"p{c}" for c in "xyz"], F.explode("far").alias("_l")).where("_l.id <> j AND _l.id <> k")
    h = [F.col(f"_l.{c}") - F.col(f"{c}i") for c in "xyz"]
    two = two.select("gid", "k", "j", "i", F.col("_l.id").alias("l"), *[f"g{c}" for c in "xyz"], *[f"p{c}" for c in "xyz"], *[v.alias(f"q{c}") for c, v in zip("xyz", _cross(gs, h), strict=True)])
    t = two.select("gid", "k", "j", "i", "l", _about([F.col(f"p{c}") for c in "xyz"], [F.col(f"q{c}") for c in "xyz"], gs).alias("t"))
    return t.select("gid", "k", "j", "i", "l", F.when(F.col("t") < 0, F.col("t") + 6.283185307179586).otherwise(F.col("t")).alias("torsion"))


def rounded(v: Column, digits: int) -> Column:
    """round() of a number that is not negative by arithmetic on doubles, as SQL engines do it, for very many rows."""
    return F.floor(v * 10.0**digits + 0.5) / 10.0**digits


def with_coordinates(df: DataFrame, points: DataFrame, column: str) -> DataFrame:
    return df.join(points.select("gid", F.col("id").alias(column), *[F.col(c).alias(f"{c}_{column}") for c in "xyz"]), ["gid", column])


def angle(ax: list[Column], bx: list[Column]) -> Column:
    """atan2(|a x b|, a . b)."""
    cross = [ax[1] * bx[2] - ax[2] * bx[1], ax[2] * bx[0] - ax[0] * bx[2], ax[0] * bx[1] - ax[1] * bx[0]]
    return F.atan2(F.sqrt(sum((c * c for c in cross), F.lit(0.0))), sum((a * b for a, b in zip(ax, bx, strict=True)), F.lit(0.0)))


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _about(p: list[Column], q: list[Column], b: list[Column]) -> Column:
    """The signed angle between the normals p and q, about b."""
    dt = lambda u, v: sum((x * y for x, y in zip(u, v, strict=True)), F.lit(0.0))
    return F.atan2(dt(_cross(p, q), b) / F.sqrt(dt(b, b)), dt(p, q))


def torsion(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """The angle in [0, 2 pi) between the planes (a, b) and (b, c), about b."""
    t = _about(_cross(a, b), _cross(b, c), b)
    return F.when(t < 0, t + 6.283185307179586).otherwise(t)


def gaussian_smearing(d: Column, start: float, stop: float, n: int) -> Column:
    step = (stop - start) / (n - 1)
    return F.array(*[F.exp(-0.5 / step**2 * (d - (start + k * step)) * (d - (start + k * step))) for k in range(n)])


def cosine_cutoff(d: Column, r: float) -> Column:
    return 0.5 * (F.cos(d * 3.141592653589793 / r) + 1.0)


def shifted_softplus(v: Column) -> Column:
    return F.log1p(F.exp(v)) - 0.6931471805599453


def envelope(d: Column, exponent: int) -> Column:
    """1/d + a d^(p-1) + b d^p + c d^(p+1) below 1, else 0; null at 0."""
    p = exponent + 1
    a, b, c = -(p + 1) * (p + 2) / 2, p * (p + 2), -p * (p + 1) / 2
    low = d
    for _ in range(p - 2):
        low = low * d
    return F.when(d < 1, F.try_divide(F.lit(1.0), d) + low * (a + d * (b + d * c))).otherwise(F.lit(0.0))


def bessel(d: Column, cutoff: float, k: Column, exponent: int) -> Column:
    s = d / cutoff
    return envelope(s, exponent) * F.sin((k + 1) * 3.141592653589793 * s)


def bessel_basis(d: Column, cutoff: float, n: int, exponent: int) -> Column:
    return F.array(*[bessel(d, cutoff, F.lit(k), exponent) for k in range(n)])


def centred(points: DataFrame, weight: str | None = None) -> DataFrame:
    """Coordinates less the graph's (weighted) centre."""
    w = F.col(weight) if weight else F.lit(1.0)
    mid = points.groupBy("gid").agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(f"m{c}") for c in "xyz"])
    return points.join(mid, "gid").select("gid", "id", *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"])


def all_pairs(points: DataFrame) -> DataFrame:
    """gid, i, j and the coordinates xi .. zj of all pairs of a graph's points. The result is quadratic; what is shuffled is
    each point once, and SPREAD * SPREAD times as a partner, so that large graphs are dealt over that many tasks."""
    parts = SPREAD * SPREAD
    own = points.select("gid", F.col("id").alias("i"), *[F.col(c).alias(f"{c}i") for c in "xyz"], F.pmod(F.hash("id"), F.lit(parts)).alias("part"))
    other = points.select("gid", F.col("id").alias("j"), *[F.col(c).alias(f"{c}j") for c in "xyz"], F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return _dealt(own, "gid", "part").join(_dealt(other, "gid", "part").hint("merge"), ["gid", "part"]).drop("part")


def coordinate_update(points: DataFrame, edges: DataFrame) -> DataFrame:
    """gid, id, x, y, z moved by the mean over neighbours of (own - other) / (1 + squared distance)."""
    j = with_coordinates(with_coordinates(edges.select("gid", "i", "j"), points, "i"), points, "j")
    rel = {c: F.col(f"{c}_i") - F.col(f"{c}_j") for c in "xyz"}
    d2 = sum((rel[c] * rel[c] for c in "xyz"), F.lit(0.0))
    moved = j.groupBy("gid", F.col("i").alias("id")).agg(*[F.avg(rel[c] / (1 + d2)).alias(f"d{c}") for c in "xyz"])
    return points.join(moved, ["gid", "id"], "left").select("gid", "id", *[(F.col(c) + F.coalesce(f"d{c}", F.lit(0.0))).alias(c) for c in "xyz"])
