"""Queries for recommendation and ranking measures. Users are customers, items parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arcloom.functions.portable import draw, draw_sql, long_form, r6
from arcloom.operators import propagate as P
from arcloom.operators import ranking as R
from arcloom.operators import sampling as S
from arcloom.plans.registry import query
from arcloom.plans.sqltext import mix, step
from arcloom.sources import views as V

_P = f"WITH {V.SQL_PAIRS}, us AS (SELECT max(user_id) + 1 AS beyond FROM p)"
_SPLIT = _P + f""", r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {draw_sql('user_id', 'item_id', 42)}, item_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM p), sp AS (SELECT user_id, item_id, CAST(CASE WHEN k <= floor(c * 0.8) THEN 0 WHEN k <= floor(c * 0.8) + floor(c * 0.1) THEN 1 ELSE 2 END AS INTEGER) AS part FROM r)"""
_SCORES = _SPLIT + f""", u AS (SELECT DISTINCT user_id FROM p), it AS (SELECT DISTINCT item_id FROM p), sc AS (SELECT u.user_id, it.item_id, CAST({draw_sql('u.user_id', 'it.item_id', 9)} AS DOUBLE) AS score FROM u, it), fr AS (SELECT sc.* FROM sc LEFT JOIN sp ON sp.user_id = sc.user_id AND sp.item_id = sc.item_id AND sp.part = 0 WHERE sp.user_id IS NULL), tk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM fr), rl AS (SELECT tk.user_id, tk.item_id, tk.rank, t.user_id IS NOT NULL AS rel, c.n_pos FROM tk LEFT JOIN (SELECT user_id, item_id FROM sp WHERE part = 2) t ON t.user_id = tk.user_id AND t.item_id = tk.item_id JOIN (SELECT user_id, count(*) AS n_pos FROM sp WHERE part = 2 GROUP BY user_id) c ON c.user_id = tk.user_id WHERE rank <= 200)"""


def _split(spark, sf):
    return R.ratio_split(V.pairs(spark, sf), "user_id", draw(F.col("user_id"), F.col("item_id"), 42), ["item_id"], (0.8, 0.1))


def _lists(spark, sf, k=200):
    return R.drawn_lists(R.by_user(_split(spark, sf)), k, 9)


@query("bipartite_edges", f"{_P} SELECT user_id AS src, item_id + beyond AS dst, CAST(1 AS DOUBLE) AS w FROM p, us UNION ALL SELECT item_id + beyond, user_id, CAST(1 AS DOUBLE) FROM p, us")
def _(spark, sf):
    return R.bipartite(V.pairs(spark, sf))


_LG = _P + f""", e AS (SELECT user_id AS src, item_id + beyond AS dst, 1.0 AS w FROM p, us UNION ALL SELECT item_id + beyond, user_id, 1.0 FROM p, us), n AS (SELECT DISTINCT src AS id FROM e), f AS (SELECT id, 0 AS pos, CAST(id % 7 AS DOUBLE) AS v FROM n UNION ALL SELECT id, 1, CAST(id % 11 AS DOUBLE) FROM n), dg AS (SELECT dst AS id, sum(w) AS d FROM e GROUP BY dst), a AS (SELECT e.src, e.dst, pow(s.d, -0.5) * pow(t.d, -0.5) AS w FROM e JOIN dg s ON s.id = e.src JOIN dg t ON t.id = e.dst), {step('h1', 'a', 'f')}, {step('h2', 'a', 'h1')}"""


def _lg(spark, sf):
    e = R.bipartite(V.pairs(spark, sf))
    n = e.select(F.col("src").alias("id")).distinct().select("id", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")).alias("x"))
    return n, P.gcn_norm(e, n, loops=False)


for _name, _first, _mix in (("lightgcn_propagation", True, [(1 / 3, "f"), (1 / 3, "h1"), (1 / 3, "h2")]), ("lightgcn_propagation_no_e0", False, [(0.5, "h1"), (0.5, "h2")])):
    @query(_name, f"{_LG}, {mix('o', _mix)} SELECT id, CAST(pos AS INTEGER) AS pos, round(v, 5) AS v FROM o")
    def _(spark, sf, first=_first):
        feature = F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double"))
        return long_form(R.light_mean(R.bipartite(V.pairs(spark, sf)), feature, 2, 2, first)).select("id", "pos", F.round("v", 5).alias("v"))


@query("simgcl_perturbation", f"{_LG} SELECT id, CAST(pos AS INTEGER) AS pos, round(v + sign(v) * 0.1 * ({draw_sql('id', 'pos', 4)} / 1000033.0), 6) AS v FROM f")
def _(spark, sf):
    n, _a = _lg(spark, sf)
    out = R.perturbed(n, 0.1, lambda i, k: draw(i, k.cast("long"), 4) / F.lit(1_000_033.0))
    return long_form(out).select("id", "pos", r6("v").alias("v"))


_EMB = "WITH e AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, label FROM embeddings)"


def _emb(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *[F.get("embedding", k).cast("double").alias(c) for k, c in enumerate("abc")], "label")


@query("info_nce_loss", f"{_EMB}, u AS (SELECT id, a / sqrt(a*a+b*b) AS p, b / sqrt(a*a+b*b) AS q, b / sqrt(b*b+c*c) AS r, c / sqrt(b*b+c*c) AS s FROM e), x AS (SELECT l.id, m.id AS j, exp((l.p * m.r + l.q * m.s) / 0.5) AS e FROM u l, u m) SELECT id, round(-ln(sum(CASE WHEN id = j THEN e END) / sum(e)), 5) AS loss FROM x GROUP BY id")
def _(spark, sf):
    e = _emb(spark, sf)
    return R.info_nce(e.select("id", F.array("a", "b").alias("x")), e.select("id", F.array("b", "c").alias("x")), 0.5).select("id", F.round("loss", 5).alias("loss"))


@query("directau_alignment", f"{_EMB} SELECT round(avg(pow(sqrt((a-b)*(a-b) + (b-c)*(b-c)), 2)), 5) AS alignment FROM e")
def _(spark, sf):
    d = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) + (F.col("b") - F.col("c")) * (F.col("b") - F.col("c"))
    return _emb(spark, sf).agg(F.round(F.avg(d), 5).alias("alignment"))


@query("directau_uniformity", f"{_EMB} SELECT round(ln(avg(exp(-2 * ((l.a-m.a)*(l.a-m.a) + (l.b-m.b)*(l.b-m.b))))), 5) AS uniformity FROM e l, e m WHERE l.id <> m.id")
def _(spark, sf):
    return R.uniformity(_emb(spark, sf)).select(F.round("uniformity", 5).alias("uniformity"))


for _name, _eps in (("bpr_loss", 1e-8), ("bpr_loss_gamma", 1e-3)):
    @query(_name, f"SELECT round(avg(-ln(1 / (1 + exp(-(l_quantity - 25) / 10.0)) + {_eps!r})), 5) AS loss FROM lineitem")
    def _(spark, sf, eps=_eps):
        s = V.table(spark, sf, "lineitem").select((F.col("l_quantity") / 10).alias("pos"), F.lit(2.5).alias("neg"))
        return R.bpr(s, eps).select(F.round("loss", 5).alias("loss"))


@query("embedding_l2_loss", f"{_EMB} SELECT round(sum(a*a + b*b + c*c) / 2 / count(*), 5) AS loss FROM e")
def _(spark, sf):
    return _emb(spark, sf).agg(F.round(F.sum(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c")) / 2 / F.count("*"), 5).alias("loss"))


@query("split_dataset", f"{_SPLIT} SELECT user_id, item_id, part FROM sp")
def _(spark, sf):
    return _split(spark, sf).select("user_id", "item_id", "part")


@query("full_item_topk", f"{_SCORES} SELECT user_id, rank, item_id, score FROM tk WHERE rank <= 20")
def _(spark, sf):
    rows = R.list_rows(_lists(spark, sf, 20).select("user_id", "best"))
    return rows.select("user_id", "rank", "item_id", draw(F.col("user_id"), F.col("item_id"), 9).cast("double").alias("score"))


@query("relevance_matrix", f"{_SCORES} SELECT user_id, rank, item_id, CAST(rel AS INTEGER) AS rel, n_pos FROM rl WHERE rank <= 20")
def _(spark, sf):
    rows = R.list_rows(_lists(spark, sf, 20).where("size(truth) > 0").select("user_id", "truth", F.size("truth").cast("long").alias("n_pos"), "best"))
    return rows.select("user_id", "rank", "item_id", F.array_contains("truth", F.col("item_id")).cast("int").alias("rel"), "n_pos")


_METRICS = _SCORES + ", ids AS (SELECT k, sum(1 / log2(k + 1)) OVER (ORDER BY k) AS idcg FROM unnest(range(1, 201)) t(k)), me AS (SELECT user_id, max(n_pos) AS n, max(CAST(rel AS DOUBLE)) AS hit, coalesce(max(CASE WHEN rel THEN 1.0 / rank END), 0) AS mrr, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(CAST(rel AS INTEGER)) AS found FROM rl GROUP BY user_id), mm AS (SELECT user_id, hit, mrr, dcg / idcg AS ndcg, found / n AS recall FROM me JOIN ids ON ids.k = least(n, 200))"
for _name in ("hit", "mrr", "ndcg", "recall"):
    @query(f"{_name}_at_k", f"{_METRICS} SELECT user_id, round({_name}, 6) AS {_name} FROM mm")
    def _(spark, sf, name=_name):
        return R.lists_metrics(_lists(spark, sf), 200).select("user_id", r6(name).alias(name))


@query("metric_means", f"{_METRICS} SELECT round(avg(hit), 4) AS hit, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(recall), 4) AS recall FROM mm")
def _(spark, sf):
    return R.lists_metrics(_lists(spark, sf), 200).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("hit", "mrr", "ndcg", "recall")])


_RANK = "WITH s AS (SELECT l_orderkey AS query, l_linenumber % 5 AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1 AS positive FROM lineitem)"


@query("mrr_evaluator", f"{_RANK}, p AS (SELECT query, max(score) AS p FROM s WHERE positive GROUP BY query) SELECT s.query, round(1 / (0.5 * (sum(CAST(score > p AS INTEGER)) + sum(CAST(score >= p AS INTEGER))) + 1), 6) AS mrr FROM s JOIN p ON p.query = s.query WHERE NOT positive GROUP BY s.query")
def _(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(*V.LINE_ORDER)
    s = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_linenumber") % 5).alias("score"), (F.row_number().over(w) == 1).alias("positive"))
    return R.mean_rank_reciprocal(s).select("query", r6("mrr").alias("mrr"))


@query("auc_average_precision", "WITH b AS (SELECT l_quantity AS score, sum(CAST(l_returnflag = 'R' AS INTEGER)) AS p, sum(CAST(l_returnflag <> 'R' AS INTEGER)) AS n FROM lineitem GROUP BY l_quantity), c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM b) SELECT round(sum(n * (tp - p + p / 2.0)) / max(pp * nn), 6) AS auc, round(sum(p * tp / (tp + fp)) / max(pp), 6) AS ap FROM c")
def _(spark, sf):
    s = V.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return R.auc_ap(s).select(r6("auc").alias("auc"), r6("ap").alias("ap"))


@query("accuracy", "SELECT l_linestatus AS klass, round(avg(CASE WHEN (l_quantity > 25) = (l_returnflag = 'R') THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lineitem GROUP BY l_linestatus")
def _(spark, sf):
    ok = F.when((F.col("l_quantity") > 25) == (F.col("l_returnflag") == "R"), 1.0).otherwise(0.0)
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("klass")).agg(r6(F.avg(ok)).alias("accuracy"))


@query("recsys_negatives", f"{_P}, c AS (SELECT p_partkey AS neg, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM (SELECT DISTINCT p_partkey FROM part)), z AS (SELECT count(*) AS size FROM c), h AS (SELECT user_id, count(*) AS d FROM p GROUP BY user_id), a AS (SELECT p.user_id, p.item_id, x.t, ({draw_sql('p.user_id', 'p.item_id', 6)} + x.t) % z.size AS place FROM p JOIN h ON h.user_id = p.user_id, z, unnest(range(least(h.d + 2, z.size))) x(t)), f AS (SELECT a.user_id, a.item_id, c.neg, row_number() OVER (PARTITION BY a.user_id, a.item_id ORDER BY a.t) AS k FROM a JOIN c ON c.place = a.place LEFT JOIN p ON p.user_id = a.user_id AND p.item_id = c.neg WHERE p.user_id IS NULL) SELECT user_id, item_id, k, neg FROM f WHERE k <= 2")
def _(spark, sf):
    return S.negatives(V.pairs(spark, sf), V.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id")), 2, 6).select("user_id", "item_id", "k", "neg")


_SEQ = _P + ", s AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY first_day, item_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM p)"


@query("sasrec_sequences", f"{_SEQ} SELECT user_id, CAST(k - greatest(c - 10, 0) - 1 AS INTEGER) AS pos, greatest(item_id - (SELECT min(item_id) FROM p), 0) AS v FROM s WHERE k > c - 10")
def _(spark, sf):
    p = V.pairs(spark, sf)
    least = p.agg(F.min("item_id").alias("m"))
    back = p.withColumn("_b", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("first_day"), F.desc("item_id")))).where("_b <= 10")
    rows = back.crossJoin(F.broadcast(least)).withColumn("v", F.greatest(F.col("item_id") - F.col("m"), F.lit(0).cast("long")))
    lists = rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_b")).alias("o"), "v"))), lambda s: s["v"]).alias("x"))
    return long_form(lists, key=("user_id",))


@query("sasrec_last_item", f"{_SEQ} SELECT user_id, item_id AS last_item FROM s WHERE k = c")
def _(spark, sf):
    return V.pairs(spark, sf).groupBy("user_id").agg(F.max_by("item_id", F.struct("first_day", "item_id")).alias("last_item"))


@query("session_graph", f"WITH s AS (SELECT l_orderkey AS session, l_partkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS alias FROM lineitem), t AS (SELECT session, alias AS src, lead(alias) OVER (PARTITION BY session ORDER BY place) AS dst FROM s) SELECT DISTINCT session, src, dst FROM t WHERE dst IS NOT NULL")
def _(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(*V.LINE_ORDER)
    rows = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("item"), F.row_number().over(w).alias("place"))
    return R.session_graph(rows)


@query("star_node_mean", f"WITH {V.SQL_NODES} SELECT l_orderkey AS session, round(avg(x0), 6) AS m0, round(avg(x1), 6) AS m1 FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN n ON id = l_partkey GROUP BY l_orderkey")
def _(spark, sf):
    d = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().join(V.nodes(spark, sf), F.col("l_partkey") == F.col("id"))
    return d.groupBy(F.col("l_orderkey").alias("session")).agg(r6(F.avg(F.get("x", 0))).alias("m0"), r6(F.avg(F.get("x", 1))).alias("m1"))

