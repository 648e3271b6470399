"""The registered queries of sparse matrices, kernels, splits, made-up tables and further metrics, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import folds, images, neighbors, sparse, targets
from ..sources import synthetic
from . import tables as t
from .registry import BASE, query, rounded
from .registry_models import EV, ev, share_sql

C = F.col

# ---- sparse matrices

COO = "WITH m AS (SELECT l_orderkey AS i, l_linenumber AS j, sum(l_quantity) AS x FROM lineitem GROUP BY ALL), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)"


def coo(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("i"), C("l_linenumber").alias("j")).agg(F.sum("l_quantity").alias("x"))


def _rows(spark: SparkSession, sf: str) -> int:
    return t.read(spark, sf, "lineitem").select("l_orderkey").distinct().count()


@query(f"{COO} SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS x FROM m a JOIN m b ON a.i = b.i GROUP BY ALL")
def sparse_product(spark: SparkSession, sf: str) -> DataFrame:
    m = coo(spark, sf)
    return sparse.product(m.select(C("j").alias("i"), C("i").alias("j"), "x"), m)


@query(f"{COO} SELECT round(count(*) / (n * 7), 9) AS density FROM m, n WHERE x <> 0 GROUP BY n")
def sparse_density(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sparse.density(coo(spark, sf), _rows(spark, sf), 7), "density", digits=9)


@query(f"{COO} SELECT j, n, round(sum(x) / n, 6) AS mean, round(sum(x * x) / n - pow(sum(x) / n, 2), 5) AS var FROM m, n GROUP BY j, n")
def sparse_moments(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.column_moments(coo(spark, sf), _rows(spark, sf)).select("j", "n", F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"))


@query(f"{COO} SELECT j, n, round(sum(x) / n, 6) AS mean, round(sum(x * x) / n - pow(sum(x) / n, 2), 5) AS var FROM m, n GROUP BY j, n")
def sparse_moments_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Moments of even and of odd rows, merged, are those of all."""
    m, n = coo(spark, sf), _rows(spark, sf)
    even = t.read(spark, sf, "lineitem").select("l_orderkey").distinct().filter("l_orderkey % 2 = 0").count()
    both = sparse.merged_moments(sparse.column_moments(m.filter("i % 2 = 0"), even), sparse.column_moments(m.filter("i % 2 <> 0"), n - even))
    return both.select("j", "n", F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"))


@query(f"{COO} SELECT i, j, round(x * (1.0 / (j + 1)), 6) AS x FROM m")
def sparse_column_scale(spark: SparkSession, sf: str) -> DataFrame:
    m = coo(spark, sf)
    return rounded(sparse.scaled(m, m.select("j").distinct().withColumn("f", 1.0 / (C("j") + 1)), "j"), "x")


@query(f"{COO} SELECT i, j, round(x * (1.0 / (i + 1)), 6) AS x FROM m")
def sparse_row_scale(spark: SparkSession, sf: str) -> DataFrame:
    m = coo(spark, sf)
    return rounded(sparse.scaled(m, m.select("i").distinct().withColumn("f", 1.0 / (C("i") + 1)), "i"), "x")


@query(f"{COO} SELECT CASE i WHEN 1 THEN 5 WHEN 5 THEN 1 ELSE i END AS i, CASE j WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE j END AS j, x FROM m")
def sparse_swap(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.swapped(sparse.swapped(coo(spark, sf), "i", 1, 5), "j", 2, 3)


@query(f"{COO} SELECT i, j, round(x / sum(abs(x)) OVER (PARTITION BY i), 6) AS l1, round(x / sqrt(sum(x * x) OVER (PARTITION BY i)), 6) AS l2 FROM m")
def sparse_row_norms(spark: SparkSession, sf: str) -> DataFrame:
    m = coo(spark, sf)
    return rounded(sparse.normalized_rows(m, "l1").withColumnRenamed("x", "l1").join(sparse.normalized_rows(m, "l2").withColumnRenamed("x", "l2"), ["i", "j"]), "l1", "l2")


@query("SELECT l_returnflag, l_linenumber, round(w, 3) AS weight FROM (SELECT l_returnflag, l_linenumber, sum(l_quantity) AS w, row_number() OVER (PARTITION BY l_returnflag ORDER BY sum(l_quantity) DESC, l_linenumber) AS r FROM lineitem GROUP BY l_returnflag, l_linenumber) WHERE r = 1")
def weighted_mode(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sparse.weighted_mode(t.read(spark, sf, "lineitem"), "l_returnflag", "l_linenumber", C("l_quantity")), "weight", digits=3)


GRAPH = "RECURSIVE e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT user_id AS a, user_id * 7 % 50 AS b FROM events UNION ALL SELECT user_id, user_id + 1 FROM events)), g AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b)"


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    u = t.read(spark, sf, "events").select(C("user_id").alias("a")).distinct()
    e = u.select("a", (C("a") * 7 % 50).alias("b")).union(u.select("a", C("a") + 1)).filter("a <> b")
    return e.union(e.select("b", "a")).distinct()


@query(f"WITH {GRAPH}, p(node, d) AS (SELECT 0::BIGINT, 0 UNION SELECT g.b, p.d + 1 FROM p JOIN g ON g.a = p.node WHERE p.d < 4) SELECT 0::BIGINT AS start, node, CAST(min(d) AS DOUBLE) AS distance FROM p GROUP BY node")
def path_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.shortest_paths(_graph(spark, sf).withColumn("w", F.lit(1)), spark.createDataFrame([(0,)], "start long"), most=4)


@query(f"WITH {GRAPH}, p(start, node, d) AS (SELECT s, s, 0.0::DOUBLE FROM (SELECT unnest([0, 3]::BIGINT[]) AS s) UNION SELECT start, g.b, p.d + 1 + (g.a + g.b) % 3 FROM p JOIN g ON g.a = p.node WHERE p.d + 1 + (g.a + g.b) % 3 <= 6) SELECT start, node, min(d) AS distance FROM p GROUP BY start, node")
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.shortest_paths(_graph(spark, sf).withColumn("w", 1 + (C("a") + C("b")) % 3), spark.createDataFrame([(0,), (3,)], "start long"), most=6)


# ---- kernels and distances

ALL = f"{BASE}, q AS (SELECT a.id, b.id AS other, a.v, b.v AS w FROM vec a JOIN vec b ON a.id <> b.id)"
L1 = "list_sum(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2])))"
DOT = "list_sum(list_transform(list_zip(v, w), lambda z: z[1] * z[2]))"
CHI = "list_sum(list_transform(list_zip(v, w), lambda z: CASE WHEN abs(z[1]) + abs(z[2]) = 0 THEN 0 ELSE pow(abs(z[1]) - abs(z[2]), 2) / (abs(z[1]) + abs(z[2])) END))"


def _abs(a):  # noqa: ANN001, ANN202
    return F.transform(a, F.abs)


@query(f"{ALL} SELECT id, other, round(exp(-0.1 * {L1}), 6) AS laplacian, round(tanh(0.01 * {DOT} + 1), 6) AS sigmoid, round(pow(0.05 * {DOT} + 1, 3), 6) AS polynomial, round({DOT}, 6) AS linear, round(-{CHI}, 6) AS additive_chi2, round(exp(-0.5 * {CHI}), 6) AS chi2 FROM q")
def kernels(spark: SparkSession, sf: str) -> DataFrame:
    l1, dot, chi = C("manhattan"), C("dot"), C("chi2")
    k = {"laplacian": F.exp(-0.1 * l1), "sigmoid": F.tanh(0.01 * dot + 1.0), "polynomial": F.pow(0.05 * dot + 1.0, F.lit(3.0)), "linear": dot, "additive_chi2": -chi, "chi2": F.exp(-0.5 * chi)}
    v = t.vectors(spark, sf).select("id", "v")
    return neighbors.against_all(v, v, "manhattan", "dot", "chi2").select("id", "other", *[F.round(e, 6).alias(n) for n, e in k.items()])


NAN = "list_transform(list_zip({v}, range(len({v}))), lambda z: CASE WHEN ({i} + z[2]) % 5 = 0 THEN NULL ELSE z[1] END)"


@query(f"{BASE}, h AS (SELECT id, {NAN.format(v='v', i='id')} AS v FROM vec), d AS (SELECT a.id, b.id AS other, list_filter(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2)), lambda x: x IS NOT NULL) AS d, len(a.v) AS n FROM h a JOIN h b ON a.id % 20 = 0 AND a.id <> b.id) SELECT id, other, round(sqrt(list_sum(d) * n / len(d)), 6) AS distance FROM d")
def nan_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    holes = t.vectors(spark, sf).select("id", F.transform("v", lambda x, i: F.when((C("id") + i) % 5 != 0, x)).alias("v"))
    return neighbors.against_all(holes.filter("id % 20 = 0"), holes, "nan_squared").select("id", "other", F.round(F.sqrt("nan_squared"), 6).alias("distance"))


@query("SELECT event_id, round(2 * asin(sqrt(pow(sin(radians(event_id % 41 - user_id % 17) / 2), 2) + cos(radians(user_id % 17)) * cos(radians(event_id % 41)) * pow(sin(radians(event_id % 91) / 2), 2))), 9) AS distance FROM events")
def haversine(spark: SparkSession, sf: str) -> DataFrame:
    e = t.read(spark, sf, "events")
    d = vectors.haversine(F.radians(C("user_id") % 17), F.lit(0.0), F.radians(C("event_id") % 41), F.radians(C("event_id") % 91))
    return e.select("event_id", F.round(d, 9).alias("distance"))


@query(f"{BASE} SELECT a.id, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2)))), 6) AS euclidean, round(1 - list_cosine_similarity(a.v, b.v), 6) AS cosine FROM vec a JOIN vec b ON b.id = a.id + 1")
def paired_distances(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf)
    p = v.select("id", "v").join(v.select((C("id") - 1).alias("id"), C("v").alias("w")), "id")
    return p.select("id", F.round(F.sqrt(vectors.squared_distance(C("v"), C("w"))), 6).alias("euclidean"), F.round(vectors.cosine_distance(C("v"), C("w")), 6).alias("cosine"))


@query(f"{BASE}, f AS (SELECT id, unnest(range(len(v))) AS i, abs(unnest(v)) AS x FROM vec), g AS (SELECT id, i * 3 AS i, sqrt(0.8 * x) AS f FROM f UNION ALL SELECT id, i * 3 + 1, CASE WHEN x > 0 THEN sqrt(1.6 * x / cosh(pi() * 0.8)) * cos(0.8 * ln(x)) ELSE 0 END FROM f UNION ALL SELECT id, i * 3 + 2, CASE WHEN x > 0 THEN sqrt(1.6 * x / cosh(pi() * 0.8)) * sin(0.8 * ln(x)) ELSE 0 END FROM f) SELECT id, CAST(i AS INT) AS i, round(f, 6) AS f FROM g")
def additive_chi2_sampler(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf)
    return rounded(v.select("id", F.posexplode(vectors.additive_chi2_features(_abs(C("v")))).alias("i", "f")), "f")


@query(f"{BASE}, k AS (SELECT a.id AS i, b.id AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS k FROM vec a JOIN vec b ON a.id % 20 = 0), r AS (SELECT i, avg(k) AS r FROM k GROUP BY i), g AS (SELECT j, avg(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))) AS c FROM (SELECT id AS j, v FROM vec) a, vec c GROUP BY j), t AS (SELECT avg(c) AS t FROM g) SELECT i AS id, j AS other, round(k - r - c + t, 5) AS k FROM k JOIN r USING (i) JOIN g USING (j), t")
def kernel_center(spark: SparkSession, sf: str) -> DataFrame:
    """A linear kernel of queries against all rows, centred in the space of features: every mean of a linear kernel is a product with the mean vector, so one pass has them all."""
    v = t.vectors(spark, sf)
    mean = v.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    m = F.array(*[F.lit(r["m"]) for r in mean])
    c = v.select("id", F.zip_with("v", m, lambda x, y: x - y).alias("v"))
    return neighbors.against_all(c.filter("id % 20 = 0"), c, "dot", exclude_self=False).select("id", "other", F.round("dot", 5).alias("k"))


# ---- splits


@query(f"SELECT o_orderkey, CAST(floor({share_sql('o_orderkey', chr(39) + '0' + chr(39))} * 5) AS INT) AS fold FROM orders")
def digest_fold(spark: SparkSession, sf: str) -> DataFrame:
    return folds.by_digest(t.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)


@query(f"SELECT o_orderkey, CAST(r AS INT) AS repeat, CAST(floor({share_sql('o_orderkey', 'CAST(r AS VARCHAR)')} * 4) AS INT) AS fold FROM orders, (SELECT unnest([0, 1, 2]) AS r)")
def repeated_fold(spark: SparkSession, sf: str) -> DataFrame:
    return folds.repeated(t.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 4, 3)


@query(f"SELECT o_orderkey, CASE WHEN {share_sql('o_orderkey', chr(39) + '0' + chr(39))} < 0.25 THEN 'test' ELSE 'train' END AS part FROM orders")
def shuffle_split(spark: SparkSession, sf: str) -> DataFrame:
    return folds.digest_split(t.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN {share_sql('o_custkey', chr(39) + '0' + chr(39))} < 0.25 THEN 'test' ELSE 'train' END AS part FROM orders")
def group_shuffle_split(spark: SparkSession, sf: str) -> DataFrame:
    return folds.digest_split(t.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query(f"WITH b AS (SELECT o_orderkey, o_orderstatus, floor({share_sql('o_orderkey', chr(39) + '1' + chr(39))} * 16) AS k, {share_sql('o_orderkey', chr(39) + '0' + chr(39))} AS u FROM orders) SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus, k ORDER BY u, o_orderkey) <= round(count(*) OVER (PARTITION BY o_orderstatus, k) * 0.25) THEN 'test' ELSE 'train' END AS part FROM b")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return folds.stratified_split(t.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CAST(CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE (r - (n % 7) * (n // 7 + 1)) // (n // 7) + n % 7 END AS INT) AS fold FROM r")
def contiguous_fold(spark: SparkSession, sf: str) -> DataFrame:
    return folds.contiguous_fold(t.read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 7).select("o_orderkey", "fold")


@query("WITH g AS (SELECT DISTINCT event_type AS g FROM events), p AS (SELECT a.g AS a, b.g AS b, CAST(row_number() OVER (ORDER BY a.g, b.g) - 1 AS INT) AS split FROM g a JOIN g b ON a.g < b.g) SELECT event_id, event_type, split, CASE WHEN event_type IN (a, b) THEN 'test' ELSE 'train' END AS part FROM events, p")
def leave_groups_out(spark: SparkSession, sf: str) -> DataFrame:
    return folds.leave_groups_out(t.read(spark, sf, "events").select("event_id", "event_type"), "event_type", 2)


@query("WITH f AS (SELECT event_id, CAST(event_id % 4 - 1 AS INT) AS fold FROM events) SELECT event_id, f.fold, CAST(s AS INT) AS split, CASE WHEN f.fold = s THEN 'test' ELSE 'train' END AS part FROM f, (SELECT unnest([0, 1, 2]) AS s)")
def predefined_split(spark: SparkSession, sf: str) -> DataFrame:
    return folds.predefined(t.read(spark, sf, "events").select("event_id", (C("event_id") % 4 - 1).cast("int").alias("fold")), "fold")


_POISSON = "CASE WHEN u < exp(-1) THEN 0 WHEN u < 2 * exp(-1) THEN 1 WHEN u < 2.5 * exp(-1) THEN 2 WHEN u < (2.5 + 1 / 6.0::DOUBLE) * exp(-1) THEN 3 ELSE 4 END"


@query(f"SELECT o_orderkey, CAST({_POISSON} AS INT) AS times FROM (SELECT o_orderkey, {share_sql('o_orderkey', chr(39) + '0' + chr(39))} AS u FROM orders)")
def resample(spark: SparkSession, sf: str) -> DataFrame:
    return folds.resampled(t.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 4)


# ---- made-up tables

# a row for each event, or an entry for each line of an order: the values are made by digest of the row's number
MADE = "WITH r AS (SELECT event_id AS id FROM events)"


def made(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "events").select(C("event_id").alias("id"))


def cells(spark: SparkSession, sf: str, i: str = "l_orderkey", j: str = "l_linenumber") -> DataFrame:
    return t.read(spark, sf, "lineitem").select(C(i).cast("long").alias("i"), C(j).cast("int").alias("j")).distinct()


def u(name: str, *of: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', '{name}', {', '.join(of or ('id',))})), 1, 12) AS BIGINT) / 281474976710656.0)"


def g(name: str, *of: str) -> str:
    return f"(sqrt(-2 * ln(1 - {u(name + 'a', *of)})) * cos(2 * pi() * {u(name + 'b', *of)}))"


@query(f"{MADE} SELECT id, round(10 * sin(pi() * {u('x0')} * {u('x1')}) + 20 * pow({u('x2')} - 0.5, 2) + 10 * {u('x3')} + 5 * {u('x4')}, 6) AS y FROM r")
def make_friedman1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.friedman(made(spark, sf)).select("id", "y"), "y")


FR = f"{MADE}, x AS (SELECT id, 100 * {u('x0')} AS a, (520 * {u('x1')} + 40) * pi() AS b, {u('x2')} AS c, 10 * {u('x3')} + 1 AS d FROM r)"


@query(f"{FR} SELECT id, round(sqrt(a * a + pow(b * c - 1 / (b * d), 2)), 5) AS y FROM x")
def make_friedman2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.friedman(made(spark, sf), kind=2).select("id", "y"), "y", digits=5)


@query(f"{FR} SELECT id, round(atan((b * c - 1 / (b * d)) / a), 6) AS y FROM x")
def make_friedman3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.friedman(made(spark, sf), kind=3).select("id", "y"), "y")


@query(f"{MADE}, x AS (SELECT id, 3 * pi() * ({u('t')} - 0.5) AS t FROM r) SELECT id, round(sin(t), 6) AS x, round(2 * {u('y')}, 6) AS y, round(sign(t) * (cos(t) - 1), 6) AS z, round(t, 6) AS t FROM x")
def make_s_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.s_curve(made(spark, sf)), "x", "y", "z", "t")


@query(f"{MADE}, x AS (SELECT id, 1.5 * pi() * (1 + 2 * {u('t')}) AS t FROM r) SELECT id, round(t * cos(t), 6) AS x, round(21 * {u('y')}, 6) AS y, round(t * sin(t), 6) AS z, round(t, 6) AS t FROM x")
def make_swiss_roll(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.swiss_roll(made(spark, sf)), "x", "y", "z", "t")


@query(f"{MADE} SELECT id, CASE WHEN {' + '.join(f'pow({g(f"x{i}")}, 2)' for i in range(10))} > 9.34 THEN 1.0 ELSE -1.0 END::DOUBLE AS y FROM r")
def make_hastie(spark: SparkSession, sf: str) -> DataFrame:
    return synthetic.hastie(made(spark, sf)).select("id", "y")


@query(f"{MADE} SELECT id, round({g('x0')} + 2 * {g('x1')} - 2 * {g('x2')} - 1.5 * {g('x3')} + {g('noise')}, 6) AS y FROM r")
def make_sparse_uncorrelated(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.sparse_uncorrelated(made(spark, sf)).select("id", "y"), "y")


@query(f"{MADE} SELECT id, CAST(least(floor(3 * (1 - exp(-(pow({g('x0')}, 2) + pow({g('x1')}, 2)) / 2))), 2) AS INT) AS y FROM r")
def make_gaussian_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return synthetic.gaussian_quantiles(made(spark, sf)).select("id", "y")


BOARD = "WITH c AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS i, CAST(l_linenumber AS INT) AS j FROM lineitem), p AS (SELECT i, j, CAST(floor({row} * {a}) AS INT) AS row_part, CAST(floor({column} * {b}) AS INT) AS column_part FROM c)"
CELL = f"10 + 90 * {u('cell', 'row_part', 'column_part')} + {g('noise', 'i', 'j')}"


@query(f"{BOARD.format(row=u('row', 'i'), column=u('column', 'j'), a=3, b=4)} SELECT i, j, round({CELL}, 6) AS x, row_part, column_part FROM p")
def make_checkerboard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.checkerboard(cells(spark, sf)), "x")


@query(f"{BOARD.format(row=u('row', 'i'), column=u('column', 'j'), a=3, b=3)} SELECT i, j, round(CASE WHEN row_part = column_part THEN {CELL} ELSE {g('noise', 'i', 'j')} END, 6) AS x, row_part, column_part FROM p")
def make_biclusters(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.biclusters(cells(spark, sf)), "x")


@query(f"WITH c AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS i, CAST(l_linenumber AS INT) AS j FROM lineitem) SELECT i, j, round({' + '.join(f'{g(f"u{k}", "i")} * {g(f"v{k}", "j")} / {k + 1}' for k in range(3))}, 6) AS x FROM c")
def make_low_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.low_rank(cells(spark, sf)), "x")


SPD = "WITH c AS (SELECT i, j, least(i, j) AS lo, greatest(i, j) AS hi FROM (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS i, CAST(l_partkey AS INT)::BIGINT AS j FROM lineitem))"


@query(f"{SPD} SELECT i, j, round(CASE WHEN i = j THEN 50.0 ELSE 2 * {u('off', 'lo', 'hi')} - 1 END, 6) AS x FROM c")
def make_spd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.positive_definite(cells(spark, sf, "l_suppkey", "l_partkey"), 50), "x")


@query(f"{SPD} SELECT i, j, round(CASE WHEN i = j THEN 50.0 WHEN {u('zero', 'lo', 'hi')} < 0.9 THEN 0.0 ELSE 2 * {u('off', 'lo', 'hi')} - 1 END, 6) AS x FROM c")
def make_sparse_spd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.positive_definite(cells(spark, sf, "l_suppkey", "l_partkey"), 50, 0.9), "x")


@query(f"{MADE}, k AS (SELECT id, unnest([{', '.join(f'CAST(floor({u(f"at{k}")} * 20) AS INT)' for k in range(3))}]) AS word, unnest([{', '.join(g(f'weight{k}') for k in range(3))}]) AS w FROM r) SELECT id, {', '.join(f'round(sum(w * {g(f"row{d}", "word")}), 6) AS v{d}' for d in (0, 7))} FROM k GROUP BY id")
def make_sparse_coded(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.sparse_coded(made(spark, sf)).select("id", C("v")[0].alias("v0"), C("v")[7].alias("v7")), "v0", "v7")


@query(f"{MADE}, l AS (SELECT id, list_filter([{', '.join(f'CASE WHEN {u(f"class{k}")} < {k + 1} / 6.0::DOUBLE THEN {k} END' for k in range(5))}], lambda x: x IS NOT NULL) AS labels FROM r), d AS (SELECT id, len(labels) AS n_labels, list_count(list_filter([{', '.join(f'(CAST(floor({u(f"word{w}")} * 20) AS INT) + coalesce(labels[1], 0) * 4) % 20' for w in range(30))}], lambda x: x = 3)) AS c FROM l) SELECT id, CAST(n_labels AS INT) AS n_labels, CAST(c AS INT) AS count_3 FROM d")
def make_multilabel(spark: SparkSession, sf: str) -> DataFrame:
    return synthetic.multilabel(made(spark, sf)).select("id", F.size("labels").alias("n_labels"), C("counts")[3].alias("count_3"))


# ---- images and labels

PIX = "WITH m AS (SELECT l_orderkey // 7 AS i, l_orderkey % 7 * 7 + l_linenumber - 1 AS j, sum(l_quantity) AS x FROM lineitem GROUP BY ALL), s AS (SELECT max(i) + 1 AS rows FROM m)"


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    d = t.read(spark, sf, "lineitem")
    return d.groupBy(F.floor(C("l_orderkey") / 7).cast("long").alias("i"), (C("l_orderkey") % 7 * 7 + C("l_linenumber") - 1).alias("j")).agg(F.sum("l_quantity").alias("x"))


@query(f"{PIX}, d AS (SELECT i - di AS pi, j - dj AS pj, CAST(di AS INT) AS di, CAST(dj AS INT) AS dj, x FROM m, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1, 2]) AS dj)) SELECT d.* FROM d, s WHERE pi >= 0 AND pj >= 0 AND pi <= rows - 2 AND pj <= 46")
def image_patches(spark: SparkSession, sf: str) -> DataFrame:
    p = _pixels(spark, sf)
    return images.patches(p, 2, 3, p.agg(F.max("i") + 1).head()[0], 49)


@query(f"{PIX} SELECT i, j, round(x, 6) AS x FROM m")
def image_from_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of one pixel at least hold every pixel, so taking them apart and together gives the image again."""
    p = _pixels(spark, sf)
    return rounded(images.from_patches(images.patches(p, 2, 3, p.agg(F.max("i") + 1).head()[0], 49)), "x")


@query(f"{PIX} SELECT a.i AS ai, a.j AS aj, b.i AS bi, b.j AS bj, abs(a.x - b.x) AS gradient FROM m a JOIN m b ON (b.i = a.i + 1 AND b.j = a.j) UNION ALL SELECT a.i, a.j, b.i, b.j, abs(a.x - b.x) FROM m a JOIN m b ON (b.i = a.i AND b.j = a.j + 1)")
def image_links(spark: SparkSession, sf: str) -> DataFrame:
    return images.pixel_links(_pixels(spark, sf))


@query("SELECT 'l_returnflag' AS \"column\", 'multiclass' AS kind UNION ALL SELECT 'l_linestatus', CASE WHEN (SELECT count(DISTINCT l_linestatus) FROM lineitem) <= 2 THEN 'binary' ELSE 'multiclass' END UNION ALL SELECT 'l_extendedprice', 'continuous' UNION ALL SELECT 'l_quantity', CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity <> floor(l_quantity)) > 0 THEN 'continuous' ELSE 'multiclass' END")
def label_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return targets.kinds(t.read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity"])


@query("SELECT DISTINCT label FROM (SELECT l_returnflag AS label FROM lineitem UNION ALL SELECT o_orderstatus FROM orders)")
def all_labels(spark: SparkSession, sf: str) -> DataFrame:
    return targets.all_labels(t.read(spark, sf, "lineitem").select(C("l_returnflag").alias("label")), t.read(spark, sf, "orders").select("o_orderstatus"))


@query("SELECT o_orderkey, o_orderstatus, round(count(*) OVER () / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*) OVER (PARTITION BY o_orderstatus)), 6) AS weight FROM orders")
def sample_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(targets.sample_weights(t.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus"), "weight")


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {share_sql('o_orderkey', chr(39) + '0' + chr(39))}, o_orderkey) - 1 AS place FROM orders")
def shuffled_rows(spark: SparkSession, sf: str) -> DataFrame:
    return targets.shuffled(t.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT o_orderkey FROM orders ORDER BY {share_sql('o_orderkey', chr(39) + '0' + chr(39))}, o_orderkey LIMIT 100")
def drawn_rows(spark: SparkSession, sf: str) -> DataFrame:
    return targets.drawn(t.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("WITH m AS (SELECT user_id AS i, event_id % 50 AS j, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY ALL) SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, coalesce(a.x, 0) AS x, coalesce(b.x, 0) AS other FROM (SELECT * FROM m WHERE i < j) a FULL JOIN (SELECT * FROM m WHERE i > j) b ON a.i = b.j AND a.j = b.i WHERE coalesce(a.x, 0) <> coalesce(b.x, 0)")
def asymmetric_entries(spark: SparkSession, sf: str) -> DataFrame:
    m = t.read(spark, sf, "events").groupBy(C("user_id").alias("i"), (C("event_id") % 50).alias("j")).agg(F.count("*").cast("double").alias("x"))
    return targets.asymmetric(m)
