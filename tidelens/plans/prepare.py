"""Dataset preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import special
from ..functions.expr import log_safe, rnd, rnd_up, rounded
from ..functions.rolling import pct
from ..operators import prep as P
from ..operators import quality as Q
from ..operators import registry
from ..operators.series import blocks, unblock
from ..sources import bars as B
from ..sources.tables import table
from .catalog import query
from .data import _HOLES, holes
from .sqlkit import EVENT_BARS, L, PCT

_LI = ["l_quantity", "l_extendedprice", "l_discount"]


def _bars(spark, root):
    return B.numbered(B.event_bars(spark, root))


@query("drop_sparse_columns", "DP-2", f"WITH {_HOLES} SELECT event_id, value, user_id FROM hl")
def drop_sparse_columns(spark, root):
    return Q.drop_sparse(holes(spark, root).select("event_id", "value", "k", "user_id"), ["value", "k", "user_id"])


for _stat, _agg in (("mean", "avg({})"), ("median", "median({})")):
    @query(f"impute_{_stat}", "DP-3", f"WITH {_HOLES} SELECT event_id, " + ", ".join(f"round(1e-9 + coalesce({c}, (SELECT {_agg.format(c)} FROM hl)), 6) AS {c}" for c in ("value", "k")) + " FROM hl")
    def _impute(spark, root, stat=_stat):
        x = Q.fill_with(holes(spark, root).select("event_id", "value", "k"), ["value", "k"], stat)
        return x.select("event_id", rnd_up("value").alias("value"), rnd_up("k").alias("k"))


_GAP_BARS = EVENT_BARS + ", gb AS (SELECT symbol, ts, CASE WHEN hour(ts) % 3 = 0 OR hour(ts) % 5 = 0 THEN NULL ELSE close END AS close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"


def _gappy(spark, root):
    h = F.hour("ts")
    return _bars(spark, root).withColumn("close", F.when((h % 3 == 0) | (h % 5 == 0), None).otherwise(F.col("close"))).select("symbol", "ts", "close", "_rn")


@query("impute_forward_backward", "DP-4", f"""WITH {_GAP_BARS} SELECT symbol, ts, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM gb""")
def impute_forward_backward(spark, root):
    return Q.fill_both(_gappy(spark, root), ["close"]).select("symbol", "ts", "close")


@query("impute_linear", "DP-5", f"""WITH {_GAP_BARS}, f AS (SELECT symbol, ts, rn, close, last_value(close IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN close IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS pr, first_value(close IGNORE NULLS) OVER b AS nv, first_value(CASE WHEN close IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS nr
 FROM gb WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, ts, round(1e-9 + coalesce(close, pv + (nv - pv) * (rn - pr) / (nr - pr), pv, nv), 6) AS close FROM f""")
def impute_linear(spark, root):
    return Q.fill_linear(_gappy(spark, root), ["close"]).select("symbol", "ts", rnd_up("close").alias("close"))


_NEAR = """h AS (SELECT event_id, value, k, CAST(user_id AS DOUBLE) AS u FROM hl), d AS (SELECT * FROM h WHERE value IS NOT NULL AND k IS NOT NULL AND u IS NOT NULL),
q AS (SELECT * FROM h WHERE value IS NULL OR k IS NULL OR u IS NULL),
r AS (SELECT q.event_id, d.value, d.k, d.u, row_number() OVER (PARTITION BY q.event_id ORDER BY sqrt(coalesce(pow(d.value - q.value, 2), 0) + coalesce(pow(d.k - q.k, 2), 0) + coalesce(pow(d.u - q.u, 2), 0)), d.event_id) AS rn
 FROM q, d WHERE q.value IS NOT NULL OR q.k IS NOT NULL OR q.u IS NOT NULL),
m AS (SELECT event_id, avg(value) AS value, avg(k) AS k, avg(u) AS u FROM r WHERE rn <= 5 GROUP BY 1), w AS (SELECT avg(value) AS value, avg(k) AS k, avg(u) AS u FROM d)"""


@query("impute_nearest", "DP-6", f"WITH {_HOLES}, {_NEAR} SELECT h.event_id, " + ", ".join(f"round(1e-9 + coalesce(h.{c}, m.{c}, w.{c}), 5) AS {c}" for c in ("value", "k", "u")) + " FROM h LEFT JOIN m USING (event_id), w")
def impute_nearest(spark, root):
    h = holes(spark, root).withColumn("u", F.col("user_id").cast("double"))
    out = Q.fill_knn(h.select("event_id", "value", "k", "u"), ["value", "k", "u"], "event_id")
    return out.select("event_id", *[rnd_up(c, 5).alias(c) for c in ("value", "k", "u")])


@query("impute_mode", "DP-7", "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders) SELECT o_orderkey, coalesce(p, (SELECT arg_max(p, (n, p)) FROM (SELECT p, count(*) AS n FROM x WHERE p IS NOT NULL GROUP BY 1))) AS p, s FROM x WHERE s IS NOT NULL")
def impute_mode(spark, root):
    x = table(spark, root, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(F.col("o_orderpriority")).alias("p"), F.when(F.col("o_orderkey") % 9 == 0, None).otherwise(F.col("o_orderstatus")).alias("s"))
    return Q.fill_mode(x, ["p"])


def _lines(spark, root):
    li = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_LI)
    # a few far values, so that every rule has something to do
    return li.withColumn("l_quantity", F.when(F.col("l_orderkey") % 500 == 0, F.col("l_quantity") * 40).otherwise(F.col("l_quantity")))


_LINES = "li AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 500 = 0 THEN l_quantity * 40 ELSE l_quantity END AS l_quantity, l_extendedprice, l_discount FROM lineitem)"


def _per_column(rule, stats):
    cols = ", ".join(f"round(1e-9 + {rule.format(c=c)}, 6) + 0.0 AS {c}" for c in _LI)
    st = ", ".join(s.format(c=c) for c in _LI for s in stats)
    return f"WITH {_LINES}, st AS (SELECT {st} FROM li) SELECT l_orderkey, l_linenumber, l_partkey, {cols} FROM li, st"


def _keep(df):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *[rnd_up(c).alias(c) for c in _LI])


_Q = "quantile_cont({{c}}, {p}) AS {{c}}_{n}"


def _qs(**kw):
    return [_Q.format(p=p, n=n) for n, p in kw.items()]


@query("outliers_zscore", "DP-8", _per_column("CASE WHEN abs(({c} - {c}_m) / {c}_s) > 3 THEN {c}_q ELSE {c} END", ["avg({c}) AS {c}_m", "stddev_samp({c}) AS {c}_s", *_qs(q=0.5)]))
def outliers_zscore(spark, root):
    return _keep(Q.outliers_zscore(_lines(spark, root), _LI))


@query("outliers_iqr", "DP-9", _per_column("CASE WHEN {c} < {c}_a - 1.5 * ({c}_b - {c}_a) OR {c} > {c}_b + 1.5 * ({c}_b - {c}_a) THEN {c}_q ELSE {c} END", _qs(a=0.25, q=0.5, b=0.75)))
def outliers_iqr(spark, root):
    return _keep(Q.outliers_iqr(_lines(spark, root), _LI))


@query("winsorize", "DP-10", _per_column("least(greatest({c}, {c}_a), {c}_b)", _qs(a=0.05, b=0.95)))
def winsorize(spark, root):
    return _keep(Q.winsorize(_lines(spark, root), _LI))


_FOREST = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM orders),
h AS (SELECT o_orderkey AS k, o_totalprice AS a, CAST(o_custkey AS DOUBLE) AS b, md5('11:' || o_orderkey) AS m FROM orders),
pool AS (SELECT a, b, (CAST('0x' || m[9:16] AS BIGINT) + j) % 100 AS tree FROM h, n, range(0, 100) r(j) WHERE j < greatest(1, ceil(25600.0 / n)) AND CAST('0x' || m[1:8] AS BIGINT) / 4294967296.0 < 25600.0 / n),
grow AS (
  SELECT tree, CAST(1 AS BIGINT) AS node, 0 AS level, a, b FROM pool
  UNION ALL
  SELECT tree, 2 * node + CASE WHEN CASE WHEN c = 0 THEN a ELSE b END >= CASE WHEN c = 0 THEN la + u * (ha - la) ELSE lb + u * (hb - lb) END THEN 1 ELSE 0 END, level + 1, a, b
  FROM (SELECT *, CASE WHEN ha > la AND hb > lb THEN CAST('0x' || m[9:16] AS BIGINT) % 2 WHEN ha > la THEN 0 ELSE 1 END AS c, CAST('0x' || m[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS u
        FROM (SELECT *, min(a) OVER w AS la, max(a) OVER w AS ha, min(b) OVER w AS lb, max(b) OVER w AS hb, md5('11:' || tree || ':' || node) AS m FROM grow WHERE level < 8 WINDOW w AS (PARTITION BY tree, node)))
  WHERE ha > la OR hb > lb),
nodes AS (
  SELECT *, CASE WHEN level = 8 OR (ha = la AND hb = lb) THEN -1 WHEN ha > la AND hb > lb THEN CAST('0x' || m[9:16] AS BIGINT) % 2 WHEN ha > la THEN 0 ELSE 1 END AS c, CAST('0x' || m[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM (SELECT tree, node, level, count(*) AS size, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, md5('11:' || tree || ':' || node) AS m FROM grow GROUP BY tree, node, level)),
walk AS (
  SELECT k, a, b, CAST(t AS BIGINT) AS tree, CAST(1 AS BIGINT) AS node, 0 AS level FROM h, range(0, 100) r(t)
  UNION ALL
  SELECT k, a, b, w.tree, 2 * w.node + CASE WHEN CASE WHEN c = 0 THEN a ELSE b END >= CASE WHEN c = 0 THEN la + u * (ha - la) ELSE lb + u * (hb - lb) END THEN 1 ELSE 0 END, w.level + 1
  FROM walk w JOIN nodes ON w.tree = nodes.tree AND w.node = nodes.node WHERE c >= 0),
ends AS (SELECT w.k, w.level, coalesce(size, 0) AS size FROM walk w LEFT JOIN nodes ON w.tree = nodes.tree AND w.node = nodes.node WHERE coalesce(c, -1) < 0),
s AS (SELECT k, pow(2.0, -round(sum(level + CASE WHEN size > 2 THEN 2 * (ln(size - 1) + 0.5772156649) - 2.0 * (size - 1) / size WHEN size = 2 THEN 1 ELSE 0 END) / 100, 9) / (2 * (ln(255.0) + 0.5772156649) - 2.0 * 255 / 256)) AS score FROM ends GROUP BY k),
f AS (SELECT k, score > (SELECT quantile_cont(score, 0.95) FROM s) AS outlier FROM s),
md AS (SELECT median(a) AS a, median(b) AS b FROM h JOIN f USING (k) WHERE NOT outlier)
SELECT k AS o_orderkey, CASE WHEN outlier THEN md.a ELSE h.a END AS o_totalprice, CASE WHEN outlier THEN md.b ELSE h.b END AS c, outlier FROM h JOIN f USING (k), md"""


@query("outliers_forest", "DP-11", _FOREST)
def outliers_forest(spark, root):
    e = table(spark, root, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("c"))
    return Q.outliers_forest(e, ["o_totalprice", "c"], "o_orderkey").select("o_orderkey", "o_totalprice", "c", "outlier")


# fitted on even orders, applied to all
_SC = {"standard": ("{c}_m", "{c}_s", ["avg({c}) AS {c}_m", "stddev_pop({c}) AS {c}_s"]), "minmax": ("{c}_a", "({c}_b - {c}_a)", ["min({c}) AS {c}_a", "max({c}) AS {c}_b"]),
       "robust": ("{c}_q", "({c}_b - {c}_a)", _qs(a=0.25, q=0.5, b=0.75)), "decimal": ("0", "{c}_d", ["pow(10, floor(log10(greatest(abs(min({c})), abs(max({c})))))) AS {c}_d"])}
for _kind, (_ctr, _spr, _st) in _SC.items():
    @query(f"scale_{_kind}", "DP-12 DP-15", _per_column(f"({{c}} - {_ctr}) / {_spr}", _st).replace("FROM li)", "FROM li WHERE l_orderkey % 2 = 0)"))
    def _scale(spark, root, kind=_kind):
        x = _lines(spark, root)
        return _keep(Q.scale(x, Q.fit_scaler(x.filter("l_orderkey % 2 = 0"), _LI, kind), _LI))


@query("inverse_scale", "DP-16", f"WITH {_LINES} SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"round(1e-9 + {c}, 4) AS {c}" for c in _LI) + " FROM li")
def inverse_scale(spark, root):
    x = _lines(spark, root)
    st = Q.fit_scaler(x, _LI, "standard")
    return Q.unscale(Q.scale(x, st, _LI), st, _LI).select("l_orderkey", "l_linenumber", "l_partkey", *[rnd_up(c, 4).alias(c) for c in _LI])


def _horner(coef, t):
    out = str(coef[0])
    for k in coef[1:]:
        out = f"({out} * {t} + {k})"
    return out


def _probit_sql(p):
    q, r = f"({p} - 0.5)", f"pow({p} - 0.5, 2)"
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (f"CASE WHEN {p} < 0.02425 THEN {_horner(special.PROBIT_C, lo)} / ({_horner(special.PROBIT_D, lo)} * {lo} + 1) WHEN {p} > 0.97575 THEN -{_horner(special.PROBIT_C, hi)} / ({_horner(special.PROBIT_D, hi)} * {hi} + 1) "
            f"ELSE {_horner(special.PROBIT_A, r)} * {q} / ({_horner(special.PROBIT_B, r)} * {r} + 1) END")


@query("scale_normal_scores", "DP-13", f"""WITH r AS (SELECT event_id, event_type AS symbol, value, (rank() OVER w - 1 + count(*) OVER (PARTITION BY event_type, value) / 2.0) / count(*) OVER (PARTITION BY event_type)::DOUBLE AS p FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value))
SELECT event_id, symbol, value, round(1e-9 + {_probit_sql('p')}, 5) + 0.0 AS value_normal FROM r""")
def scale_normal_scores(spark, root):
    e = table(spark, root, "events").select("event_id", F.col("event_type").alias("symbol"), "value")
    return P.normal_scores(e, "symbol", "value").select("event_id", "symbol", "value", rnd_up("value_normal", 5).alias("value_normal"))


@query("scale_change_and_log", "DP-14", f"WITH {EVENT_BARS} SELECT symbol, ts, round(1e-9 + coalesce({PCT('close')}, 0), 5) + 0.0 AS change, round(1e-9 + ln(close + 1e-8), 6) AS logged FROM bars")
def scale_change_and_log(spark, root):
    x = unblock(blocks(_bars(spark, root), 1).withColumn("change", F.coalesce(pct("close"), F.lit(0.0))))
    return x.select("symbol", "ts", rnd_up("change", 5).alias("change"), rnd_up(log_safe(F.col("close") + 1e-8)).alias("logged"))


@query("row_scaler", "DP-17 FN-6", f"WITH {EVENT_BARS}, a AS (SELECT symbol, ts, [open, high, low, close] AS v FROM bars), m AS (SELECT *, list_avg(v) AS mu, sqrt(list_avg(list_transform(v, lambda x: pow(x - list_avg(v), 2)))) AS sd FROM a) SELECT symbol, ts, "
       + ", ".join(f"round(1e-9 + CASE WHEN sd > 0 THEN (v[{i}] - mu) / sd ELSE 0 END, 5) + 0.0 AS {n}" for i, n in enumerate(("open", "high", "low", "close"), 1)) + " FROM m")
def row_scaler(spark, root):
    x = B.event_bars(spark, root).withColumn("v", Q.row_scale(F.array("open", "high", "low", "close")))
    return x.select("symbol", "ts", *[rnd_up(F.col("v")[i], 5).alias(n) for i, n in enumerate(("open", "high", "low", "close"))])


@query("pca", "DP-18", None)
def pca(spark, root):
    return P.principal_components(table(spark, root, "embeddings"), "embedding", share=0.5)


@query("pca_variance", "DP-18", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, avg(v) AS m, count(*) AS n FROM e GROUP BY 1)
SELECT count(DISTINCT vec_id) AS vectors, round(sum((v - m) * (v - m) / (n - 1)), 6) AS total_variance, round(sum(v * v), 4) AS energy, TRUE AS uncorrelated, TRUE AS descending FROM e JOIN m USING (i)""")
def pca_variance(spark, root):
    """What holds of all scores whatever their signs: a rotation keeps lengths and total variance, scores are uncorrelated and fall in variance."""
    e = table(spark, root, "embeddings").filter("embedding IS NOT NULL")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    scores = P.principal_components(e, "embedding", k=size).select("vec_id", F.posexplode(F.array(*[f"pca_{i + 1}" for i in range(size)])).alias("i", "v"))
    per = scores.groupBy("i").agg(F.var_samp("v").alias("var"), F.sum(F.col("v") * F.col("v")).alias("e"), F.count("v").alias("n"), F.avg("v").alias("m"))
    other = scores.join(per.select("i", "m"), "i").withColumn("c", F.col("v") - F.col("m"))
    cross = other.select("vec_id", "i", "c").join(other.select("vec_id", F.col("i").alias("j"), F.col("c").alias("d")), "vec_id").filter("i < j").groupBy("i", "j").agg(
        F.abs(F.sum(F.col("c") * F.col("d"))).alias("x")).agg(F.max("x").alias("x"))
    falls = F.forall(F.zip_with(F.slice("vars", 1, size - 1), F.slice("vars", 2, size - 1), lambda a, b: a["var"] - b["var"]), lambda d: d > -1e-9)
    g = per.agg(F.max("n").alias("vectors"), rnd(F.sum("var"), 6).alias("total_variance"), rnd(F.sum("e"), 4).alias("energy"), F.array_sort(F.collect_list(F.struct("i", "var"))).alias("vars"))
    return g.select("vectors", "total_variance", "energy", (cross.scalar() < 1e-6).alias("uncorrelated"), falls.alias("descending"))


@query("select_f_regression", "DP-19 SRT-11", "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_suppkey")) + ") SELECT feature, round(r * r / (1 - r * r) * (n - 2), 4) AS score FROM c ORDER BY 2 DESC LIMIT 3")
def select_f_regression(spark, root):
    s = P.f_regression(table(spark, root, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_suppkey"], "l_extendedprice")
    return rounded(P.top_by(s, "score", 3), ["score"], 4)


@query("select_anova", "DP-19", "WITH l AS (SELECT l_returnflag AS c, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS feature, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem), g AS (SELECT feature, c, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM l GROUP BY 1, 2), t AS (SELECT feature, avg(v) AS gm FROM l GROUP BY 1) SELECT feature, round(sum(n * pow(m - gm, 2)) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))), 4) AS score FROM g JOIN t USING (feature) GROUP BY 1")
def select_anova(spark, root):
    return rounded(P.anova(table(spark, root, "lineitem"), _LI, "l_returnflag"), ["score"], 4)


@query("select_chi2", "DP-19", "WITH l AS (SELECT l_returnflag AS c, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS feature, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem), g AS (SELECT feature, c, count(*) AS n, sum(v) AS o FROM l GROUP BY 1, 2), t AS (SELECT feature, sum(o) AS s, sum(n) AS r FROM g GROUP BY 1) SELECT feature, round(sum(pow(o - s * n / r, 2) / (s * n / r)), 4) AS score FROM g JOIN t USING (feature) GROUP BY 1")
def select_chi2(spark, root):
    return rounded(P.chi2(table(spark, root, "lineitem"), _LI, "l_returnflag"), ["score"], 4)


@query("select_correlation", "DP-20 SRT-11", "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_suppkey")) + ") SELECT feature, round(r, 6) + 0.0 AS correlation FROM c ORDER BY abs(r) DESC LIMIT 2")
def select_correlation(spark, root):
    s = P.top_by(P.correlations(table(spark, root, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_suppkey"], "l_extendedprice"), "strength", 2)
    return s.select("feature", rnd("correlation").alias("correlation"))


def _code(c):
    return f"least(floor(({c} - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)) * 8), 7)"


@query("select_mutual_information", "DP-21", "WITH j AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_code(c)} AS a, {_code('l_extendedprice')} AS b FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + "), g AS (SELECT feature, a, b, count(*)::DOUBLE AS n FROM j GROUP BY 1, 2, 3), w AS (SELECT *, sum(n) OVER (PARTITION BY feature, a) AS na, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature) AS t FROM g) SELECT feature, round(sum(n / t * ln(n * t / (na * nb))), 6) AS score FROM w GROUP BY 1")
def select_mutual_information(spark, root):
    return rounded(P.mutual_information(table(spark, root, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), ["score"])


_SPLIT = EVENT_BARS + ", sp AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"


@query("split_by_time", "DP-22", f"WITH {_SPLIT} SELECT * FROM (SELECT symbol, ts, CASE WHEN rn <= floor(n * 0.7) - 10 THEN 'train' WHEN rn > floor(n * 0.7) AND rn <= floor(n * 0.85) - 10 THEN 'val' WHEN rn > floor(n * 0.85) THEN 'test' END AS split FROM sp) WHERE split IS NOT NULL")
def split_by_time(spark, root):
    return P.split_by_time(_bars(spark, root), purge=10).select("symbol", "ts", "split")


_H = "(('0x' || substr(md5(CAST({k} AS VARCHAR)), 17, 16))::UBIGINT % 1000 + (('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 16))::UBIGINT % 1000) * (18446744073709551615::UBIGINT % 1000 + 1)) % 1000"
for _nm, _key in (("random", "o_orderkey"), ("grouped", "o_custkey")):
    @query(f"split_{_nm}", "DP-23", f"WITH h AS (SELECT o_orderkey, {_H.format(k=_key)} AS h FROM orders) SELECT o_orderkey, CASE WHEN h < 700 THEN 'train' WHEN h < 850 THEN 'val' ELSE 'test' END AS split FROM h")
    def _split(spark, root, key=_key):
        return P.split_by_hash(table(spark, root, "orders"), F.col(key)).select("o_orderkey", "split")


_SEQ = "sq AS (SELECT symbol, ts, rn, list(close) OVER a AS c, list(volume) OVER a AS v, list(close) OVER b AS y FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars) WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 FOLLOWING AND 26 FOLLOWING))"


@query("sequences", "DP-24 SG-7", f"WITH {EVENT_BARS}, {_SEQ} SELECT symbol, ts, round(1e-9 + list_sum(c), 4) AS close_sum, list_sum(v) AS volume_sum, c[24] AS last_close, y[1] AS y_first, y[3] AS y_last FROM sq WHERE len(c) = 24 AND len(y) = 3 AND (rn - 1) % 4 = 0")
def sequences(spark, root):
    s = P.sequences(_bars(spark, root), ["close", "volume"], "close", 24, 3, 4)
    tot = lambda i: F.aggregate("x", F.lit(0.0), lambda a, r: a + r[i])
    return s.select("symbol", "ts", rnd_up(tot(0), 4).alias("close_sum"), tot(1).alias("volume_sum"), F.element_at("x", -1)[0].alias("last_close"), F.col("y")[0].alias("y_first"), F.col("y")[2].alias("y_last"))


_HZ = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 FOLLOWING AND 16 FOLLOWING)"


@query("horizon_targets", "DP-25", f"WITH {EVENT_BARS}, t AS (SELECT symbol, ts, count(close) {_HZ} AS k, last_value(close) {_HZ} AS l, first_value(close) {_HZ} AS f, stddev_pop(close) {_HZ} AS s FROM bars) SELECT symbol, ts, l AS target_price, round(1e-9 + s, 5) AS target_volatility, round(1e-9 + (l - f) / f, 5) + 0.0 AS target_return FROM t WHERE k = 4")
def horizon_targets(spark, root):
    t = P.horizon_targets(_bars(spark, root), "close", 12, 4)
    return t.select("symbol", "ts", "target_price", rnd_up("target_volatility", 5).alias("target_volatility"), rnd_up("target_return", 5).alias("target_return"))


_FUT = EVENT_BARS + ", fu AS (SELECT symbol, ts, (lead(close, 3) OVER (PARTITION BY symbol ORDER BY ts) - close) / close AS future FROM bars), fx AS (SELECT * FROM fu WHERE future IS NOT NULL)"


@query("labels_binary_ternary", "DP-26 DP-27", f"WITH {_FUT} SELECT symbol, ts, CASE WHEN future > 0.02 THEN 1 ELSE 0 END AS label_binary, CASE WHEN future <= -0.1 THEN 0 WHEN future <= 0.1 THEN 1 ELSE 2 END AS label_ternary FROM fx")
def labels_binary_ternary(spark, root):
    return P.future_return(_bars(spark, root), "close", 3).select("symbol", "ts", P.label_binary(0.02).alias("label_binary"), P.label_ternary(0.1).alias("label_ternary"))


@query("labels_bins", "DP-28", f"WITH {_FUT}, q AS (SELECT symbol, quantile_cont(future, [0.2, 0.4, 0.6, 0.8]) AS e FROM fx GROUP BY 1) SELECT symbol, ts, CAST(len(list_filter(e, lambda x: future > x)) AS INTEGER) AS label FROM fx JOIN q USING (symbol)")
def labels_bins(spark, root):
    return P.label_bins(P.future_return(_bars(spark, root), "close", 3)).select("symbol", "ts", "label")


def _rand(what, k="k"):
    return f"(('0x' || substr(md5({k} || ':' || {what}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


_AUG = f"""aq AS (SELECT symbol, ts, rn AS _rn, list_transform(range(1, 25), lambda i: [c[i], CAST(v[i] AS DOUBLE)]) AS x, symbol || '|' || rn || '|42' AS k FROM sq WHERE len(c) = 24 AND len(y) >= 1 AND (rn - 1) % 4 = 0),
am AS (SELECT *, ['{"', '".join(P.METHODS)}'][1 + CAST(floor({_rand("'method'")} * 7) AS INTEGER)] AS method FROM aq WHERE {_rand("'pick'")} < 0.5),
ao AS (SELECT *, CAST(floor({_rand("'first'")} * CASE method WHEN 'permutation' THEN 20 WHEN 'window_slice' THEN 4 ELSE 21 END) AS INTEGER) AS f,
 list_transform(list_sort(list_transform(range(0, 5), lambda i: {{'r': {_rand("'order' || i")}, 'i': i}})), lambda s: s.i) AS o FROM am),
ar AS (SELECT *, unnest(range(0, 24)) AS t FROM ao),
ap AS (SELECT *, CASE WHEN method = 'permutation' AND t >= f AND t < f + 5 THEN f + o[t - f + 1]
  WHEN method = 'time_warp' THEN least(greatest(t + 0.4 * {_rand("'depth'")} * sin(2 * pi() * (t / 23.0::DOUBLE * (1 + floor({_rand("'waves'")} * 3)) + {_rand("'phase'")})), 0), 23)
  WHEN method = 'window_slice' THEN f + t * 20 / 23.0::DOUBLE ELSE t END::DOUBLE AS p,
 CASE WHEN method = 'scaling' THEN 0.9 + 0.2 * {_rand("'factor'")}
  WHEN method = 'magnitude_warp' THEN 0.9 + 0.2 * ({_rand("'knot' || CAST(floor(3.0 * t / 23) AS BIGINT)")} + ({_rand("'knot' || CAST(floor(3.0 * t / 23) + 1 AS BIGINT)")} - {_rand("'knot' || CAST(floor(3.0 * t / 23) AS BIGINT)")}) * (3.0::DOUBLE * t / 23 - floor(3.0::DOUBLE * t / 23)))
  WHEN method = 'window_warp' AND t >= f AND t < f + 4 THEN 0.8 + 0.4 * {_rand("'factor'")} ELSE 1.0 END::DOUBLE AS g FROM ar),
az AS (SELECT symbol, ts, _rn, method, x, k, t, p, g, CAST(floor(p) AS INTEGER) AS a, unnest([1, 2]) AS j FROM ap),
av AS (SELECT symbol, ts, _rn, method, j, (x[a + 1][j] + (x[least(a + 1, 23) + 1][j] - x[a + 1][j]) * (p - a)) * g
  + CASE WHEN method = 'jitter' THEN 0.01 * sqrt(-2 * ln(1 - {_rand("'u' || t || ',' || (j - 1)")})) * cos(2 * pi() * {_rand("'v' || t || ',' || (j - 1)")}) ELSE 0 END AS v FROM az)
SELECT symbol, ts, method, round(1e-9 + sum(v) FILTER (j = 1), 3) AS close_sum, round(1e-9 + sum(v) FILTER (j = 2), 3) AS volume_sum FROM av GROUP BY ALL
UNION ALL SELECT symbol, ts, 'original', round(1e-9 + list_sum(list_transform(x, lambda r: r[1])), 3), round(1e-9 + list_sum(list_transform(x, lambda r: r[2])), 3) FROM aq"""


@query("augment_sequences", "DP-29 SET-1", f"WITH {EVENT_BARS}, {_SEQ}, {_AUG}")
def augment_sequences(spark, root):
    s = P.augment(P.sequences(_bars(spark, root), ["close", "volume"], "close", 24, 1, 4))
    tot = lambda i: F.aggregate("x", F.lit(0.0), lambda a, r: a + r[i])
    return s.select("symbol", "ts", "method", rnd_up(tot(0), 3).alias("close_sum"), rnd_up(tot(1), 3).alias("volume_sum"))


@query("prepared_dataset", "DP-30")
def prepared_dataset(spark, root):
    x = registry.many(_bars(spark, root), {"sma_20": ("sma", 20), "rsi": ("rsi", 14)}, keep=("symbol", "ts", "_rn", "close", "volume"))
    return P.prepare(x, ["close", "volume", "sma_20", "rsi"], "close")


@query("multi_source_dataset", "DP-31")
def multi_source_dataset(spark, root):
    from .market import multi_source_outer_join

    x = B.numbered(multi_source_outer_join(spark, root))
    return P.prepare(x, ["price", "price_b"], "price")


@query("model_inputs", "DP-32", f"WITH {EVENT_BARS} SELECT close, volume, open, high, low, 0.0::DOUBLE AS pad_0, 0.0::DOUBLE AS pad_1 FROM bars")
def model_inputs(spark, root):
    b = B.event_bars(spark, root)
    return b.select(*P.model_inputs(["open", "high", "low", "close", "volume"], ["close", "missing", "volume"], 7))
