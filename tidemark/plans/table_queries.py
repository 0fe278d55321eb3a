"""Registered queries over tables: dates, features with fit and apply, dataset verbs, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import half_up
from tidemark.operators import dataset as d, metrics as m, tabular as t, temporal
from tidemark.plans.common import r4, registry
from tidemark.session import table

QUERIES, ORACLES, query = registry()
_D = "o_orderdate"


@query(
    f"""SELECT o_orderkey, year({_D}) AS o_order_Year, month({_D}) AS o_order_Month, weekofyear({_D}) AS o_order_Week, day({_D}) AS o_order_Day,
isodow({_D}) - 1 AS o_order_Dayofweek, dayofyear({_D}) AS o_order_Dayofyear, CAST({_D} AS DATE) = last_day({_D}) AS o_order_Is_month_end,
day({_D}) = 1 AS o_order_Is_month_start, CAST({_D} AS DATE) = last_day(date_trunc('quarter', {_D}) + INTERVAL 2 MONTH) AS o_order_Is_quarter_end,
CAST({_D} AS DATE) = date_trunc('quarter', {_D}) AS o_order_Is_quarter_start, month({_D}) = 12 AND day({_D}) = 31 AS o_order_Is_year_end,
dayofyear({_D}) = 1 AS o_order_Is_year_start, hour({_D}) AS o_order_Hour, minute({_D}) AS o_order_Minute, CAST(second({_D}) AS BIGINT) AS o_order_Second,
CAST(epoch({_D}) AS BIGINT) AS o_order_Elapsed FROM orders"""
)
def datepart(spark, sf_dir):
    """Parts of the order date."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _D)
    return t.add_datepart(orders, _D, "o_order", time=True).drop(_D)


_TURNS = {
    "weekday": f"(isodow({_D}) - 1) / 7", "day_month": f"(day({_D}) - 1) / day(last_day({_D}))", "month_year": f"(month({_D}) - 1) / 12",
    "day_year": f"(dayofyear({_D}) - 1) / dayofyear(make_date(year({_D}), 12, 31))",
}


@query(
    "SELECT o_orderkey, "
    + ", ".join(f"{r4(f'{k}({e} * 2 * pi())')} AS {n}_{k}" for n, e in _TURNS.items() for k in ("cos", "sin"))
    + " FROM orders"
)
def cyclic_datepart(spark, sf_dir):
    """The order date as points on circles."""
    found = t.add_cyclic_datepart(table(spark, sf_dir, "orders").select("o_orderkey", _D), _D).drop(_D)
    return found.select("o_orderkey", *[half_up(F.col(c)).alias(c) for c in found.columns[1:]])


_OW = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", _D, "o_orderstatus")


_ELAPSED = f"""SELECT o_orderkey, o_custkey, {_D}, o_orderstatus,
CAST(coalesce(date_diff('day', CAST(last_value(CASE WHEN o_orderstatus = 'F' THEN {_D} END IGNORE NULLS) OVER ({_OW} ROWS UNBOUNDED PRECEDING) AS DATE), CAST({_D} AS DATE)), 0) AS BIGINT) AS after,
CAST(coalesce(date_diff('day', CAST(first_value(CASE WHEN o_orderstatus = 'F' THEN {_D} END IGNORE NULLS) OVER ({_OW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DATE), CAST({_D} AS DATE)), 0) AS BIGINT) AS before FROM orders"""
_ROLLED = f"""SELECT o_orderkey, o_custkey, {_D}, CAST(sum(CAST(o_orderstatus = 'F' AS INT)) OVER ({_OW} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS bw,
CAST(sum(CAST(o_orderstatus = 'F' AS INT)) OVER ({_OW} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS BIGINT) AS fw FROM orders"""


@query(f"SELECT o_orderkey, after, before FROM ({_ELAPSED})")
def elapsed_after_before(spark, sf_dir):
    """Days since and until a customer's finished order."""
    found = t_elapsed(_orders(spark, sf_dir))
    return found.select("o_orderkey", "after", "before")


def t_elapsed(orders):
    """Elapsed days of finished orders."""
    return temporal.elapsed(orders, "o_custkey", _D, F.col("o_orderstatus") == "F", "o_orderkey")


@query(f"SELECT o_orderkey, bw, fw FROM ({_ROLLED})")
def rolling7_bw_fw(spark, sf_dir):
    """Finished orders among seven, back and ahead."""
    hit = (F.col("o_orderstatus") == "F").cast("long")
    return temporal.rolling_sums(_orders(spark, sf_dir), "o_custkey", _D, hit, "o_orderkey").select("o_orderkey", "bw", "fw")


@query(f"SELECT e.o_orderkey, e.after, e.before, r.bw, r.fw FROM ({_ELAPSED}) e LEFT JOIN ({_ROLLED}) r ON e.o_custkey = r.o_custkey AND e.{_D} = r.{_D}")
def elapsed_merge(spark, sf_dir):
    """Both, merged on customer and date; rows of one date pair up with each other."""
    hit = (F.col("o_orderstatus") == "F").cast("long")
    e = t_elapsed(_orders(spark, sf_dir)).select("o_orderkey", "o_custkey", _D, "after", "before")
    r = temporal.rolling_sums(_orders(spark, sf_dir), "o_custkey", _D, hit, "o_orderkey").select("o_custkey", _D, "bw", "fw")
    return e.join(r, ["o_custkey", _D], "left").select("o_orderkey", "after", "before", "bw", "fw")


@query(
    """WITH k AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS c FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment < 'H'))
SELECT c_custkey, coalesce(c, 0) AS c_mktsegment_code FROM customer LEFT JOIN k USING (c_mktsegment)"""
)
def categorify_fit_apply(spark, sf_dir):
    """Codes learnt on a third of the customers, without some segments, for all."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    fitted = t.Categorify(["c_mktsegment"]).fit(c.where("c_custkey % 3 = 0 and c_mktsegment < 'H'"))
    return fitted.apply(c).select("c_custkey", "c_mktsegment_code")


_HOLES = "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS size, p_retailprice AS full_price FROM part"


def _holes(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "IF(p_partkey % 7 = 0, NULL, p_retailprice) AS price", "IF(p_partkey % 5 = 0, NULL, p_size) AS size", "p_retailprice AS full_price"
    )


@query(
    f"""WITH h AS ({_HOLES}), f AS (SELECT median(price) AS mp FROM h WHERE p_partkey % 2 = 0),
g AS (SELECT size AS ms FROM h WHERE p_partkey % 2 = 0 AND size IS NOT NULL GROUP BY size ORDER BY count(*) DESC, size LIMIT 1)
SELECT p_partkey, {r4("coalesce(price, mp)")} AS price, price IS NULL AS price_na, CAST(coalesce(size, ms) AS BIGINT) AS size, size IS NULL AS size_na, full_price FROM h, f, g"""
)
def fill_missing(spark, sf_dir):
    """Holes of all parts filled by the median and the mode of half of them."""
    h = _holes(spark, sf_dir)
    train = h.where("p_partkey % 2 = 0")
    chain = t.Chain([t.FillMissing(["price", "full_price"]), t.FillMissing(["size"], "mode")]).fit(train)
    out = chain.apply(h)
    return out.select("p_partkey", half_up(F.col("price")).alias("price"), "price_na", F.col("size").cast("long").alias("size"), "size_na", "full_price")


@query(
    f"""WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer WHERE c_custkey % 4 <> 0)
SELECT c_custkey, {r4("(c_acctbal - m) / (1e-7 + sd)")} AS c_acctbal FROM customer, s"""
)
def normalize_fit_apply(spark, sf_dir):
    """All balances scaled by the figures of three quarters of the customers."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    out = t.Normalize(["c_acctbal"]).fit(c.where("c_custkey % 4 <> 0")).apply(c)
    return out.select("c_custkey", half_up(F.col("c_acctbal")).alias("c_acctbal"))


@query(
    """WITH c AS (SELECT count(DISTINCT p_size) AS s, count(DISTINCT p_partkey) AS k FROM part)
SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS name,
unnest([CASE WHEN k > 60 THEN 'cont' ELSE 'cat' END, 'cat', 'cat', 'cat', CASE WHEN s > 60 THEN 'cont' ELSE 'cat' END, 'cont']) AS kind FROM c"""
)
def cont_cat_split(spark, sf_dir):
    """Which columns of parts are continuous."""
    cont, cat = t.cont_cat_split(table(spark, sf_dir, "part"), 60)
    return spark.createDataFrame([(c, "cont") for c in cont] + [(c, "cat") for c in cat], "name string, kind string")


@query(
    """WITH c AS (SELECT unnest(['p_brand', 'p_type', 'p_size']) AS "column", unnest([count(DISTINCT p_brand) + 1, count(DISTINCT p_type) + 1, count(DISTINCT p_size) + 1]) AS n FROM part)
SELECT "column", n, CAST(least(600, floor(1.6 * pow(n, 0.56) + 0.5)) AS BIGINT) AS size FROM c"""
)
def emb_sizes(spark, sf_dir):
    """Vector sizes of the parts' categories."""
    return t.cardinalities(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query(
    f"""WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderstatus, n, {r4("1.0::DOUBLE / n", 9)} AS weight, CAST(max(n) OVER () * count(*) OVER () AS BIGINT) AS draws FROM c"""
)
def oversample_weights(spark, sf_dir):
    """Weights that make order states equally likely."""
    return t.oversample_weights(table(spark, sf_dir, "orders"), "o_orderstatus").withColumn("weight", half_up(F.col("weight"), 9))


_TURN = "(CASE WHEN i < 0.3::DOUBLE THEN 0.04 + (1.0 - 0.04) / 2 * (cos(pi() * (1 - i / 0.3::DOUBLE)) + 1) ELSE 0.001::DOUBLE + (1.0 - 0.001::DOUBLE) / 2 * (cos(pi() * (i - 0.3::DOUBLE) / 0.7::DOUBLE) + 1) END)"


@query(
    f"""WITH s AS (SELECT o_orderkey, o_orderkey % 1000 / 1000::DOUBLE AS i FROM orders)
SELECT o_orderkey, {r4("0.1 + (0.9) * i")} AS linear, {r4("0.1 * pow(10.0, i)")} AS exp, {r4("1.0 + (0.1 - 1.0) / 2 * (cos(pi() * i) + 1)")} AS cos,
{r4("1.0 + (0.1 - 1.0) * pow(1 - i, 2)")} AS poly, {r4(_TURN)} AS cycle FROM s"""
)
def schedules(spark, sf_dir):
    """Annealing schedules at each order's share of the way, one of them in two phases."""
    share = (F.col("o_orderkey") % 1000) / 1000
    kinds = {"linear": "linear", "exp": "exp", "cos": "cos", "poly": "poly2"}
    columns = [half_up(t.schedule(k, 0.1, 1.0, share)).alias(n) for n, k in kinds.items()]
    cycle = t.phases([(0.3, "cos", 0.04, 1.0), (0.7, "cos", 1.0, 0.001)], share)
    return table(spark, sf_dir, "orders").select("o_orderkey", *columns, half_up(cycle).alias("cycle"))


@query(
    f"""SELECT a.vec_id, {r4("1 + 4 / (1 + exp(-(list_dot_product(a.embedding, b.embedding)::DOUBLE + a.label * 0.1 - b.label * 0.1)))", 3)} AS rating
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def dot_bias_score(spark, sf_dir):
    """A rating from two vectors and their biases."""
    e = table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v"), F.col("label").alias("l"))
    score = t.dot_bias(F.transform("embedding", lambda x: x.cast("double")), F.transform("v", lambda x: x.cast("double")), F.col("label") * 0.1, F.col("l") * -0.1, 1.0, 5.0)
    return e.join(other, "vec_id").select("vec_id", half_up(score, 3).alias("rating"))


_DRAW = "CAST('0x' || substr(md5('{0}|' || {1}), 1, 8) AS BIGINT)"


def _placed(seed: int, key: str, of: str) -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY {_DRAW.format(seed, key)}, {key}) AS place, count(*) OVER () AS total FROM {of})"


@query(f"SELECT doc_id, CASE WHEN place <= floor(0.2 * total) THEN 'valid' ELSE 'train' END AS split FROM {_placed(7, 'doc_id', 'documents')}")
def split_rand_pct(spark, sf_dir):
    """A fifth of the documents held out."""
    return d.split_by_rand_pct(table(spark, sf_dir, "documents").select("doc_id"), 0.2, 7, "doc_id")


@query(
    f"""SELECT doc_id, CASE WHEN place <= floor(0.3 * total) THEN 'train' ELSE 'valid' END AS split FROM {_placed(8, 'doc_id', 'documents')}
WHERE place <= floor(0.3 * total) OR place > total - floor(0.1 * total)"""
)
def split_subsets(spark, sf_dir):
    """The first three tenths and the last tenth in seeded order."""
    return d.split_subsets(table(spark, sf_dir, "documents").select("doc_id"), 0.3, 0.1, 8, "doc_id")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'valid' ELSE 'train' END AS split FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)")
def split_by_list(spark, sf_dir):
    """Documents that a table names held out."""
    named = table(spark, sf_dir, "labels").where("toxic = 1")
    return d.split_by_list(table(spark, sf_dir, "documents").select("doc_id"), named, "doc_id").select("doc_id", "split")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'valid' ELSE 'train' END AS split FROM orders")
def split_by_col(spark, sf_dir):
    """Pending orders held out."""
    return d.split_from_column(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "P").drop("o_orderstatus")


@query(f"SELECT o_orderkey FROM {_placed(9, 'o_orderkey', 'orders')} WHERE place <= floor(0.25 * total)")
def use_partial(spark, sf_dir):
    """Exactly a quarter of the orders."""
    return d.use_partial(table(spark, sf_dir, "orders").select("o_orderkey"), 0.25, 9, "o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE {_DRAW.format(10, 'o_orderkey')} < floor(0.1 * 4294967296)")
def filter_rand(spark, sf_dir):
    """About a tenth of the orders."""
    return d.filter_rand(table(spark, sf_dir, "orders").select("o_orderkey"), 0.1, 10, "o_orderkey")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3') AND source <> 'src2' AND NOT (n_chars > 3000)")
def filter_include_exclude(spark, sf_dir):
    """Documents of some folders, without long ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    some = d.filter_folder(docs, path, ["src1", "src2", "src3"], ["src2"])
    return d.drop_if(some, F.col("n_chars") > 3000).select("doc_id", "source")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS label FROM pages")
def label_from_regex(spark, sf_dir):
    """The host as a label."""
    return table(spark, sf_dir, "pages").select("page_id", d.label_from_re(F.col("url"), "^https?://([^/:]+)").alias("label"))


@query("SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def label_codes(spark, sf_dir):
    """Segments as class numbers."""
    return d.label_codes(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "c_mktsegment", "code")


_CLASSES = ["BRASS", "COPPER", "ECONOMY", "LARGE", "PROMO", "STANDARD", "STEEL", "TIN"]


@query(
    f"""WITH k AS (SELECT p_partkey, list_sort(list_distinct(list_filter([list_position({_CLASSES!r}, w) - 1 FOR w IN string_split(upper(p_type || ' ' || p_name), ' ')], lambda i: i >= 0))) AS codes FROM part)
SELECT p_partkey, CAST(codes AS BIGINT[]) AS codes, [CAST(list_contains(codes, i) AS BIGINT) FOR i IN range({len(_CLASSES)})] AS hot FROM k"""
)
def label_multicat(spark, sf_dir):
    """Several classes of a part as codes and as a 0/1 vector."""
    parts = table(spark, sf_dir, "part")
    words = F.split(F.upper(F.concat_ws(" ", "p_type", "p_name")), " ")
    return d.multi_labels(parts, words, _CLASSES).select("p_partkey", "codes", "hot")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority < '3')")
def drop_unknown(spark, sf_dir):
    """Orders whose priority is known."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return d.drop_unknown(orders, "o_orderpriority", orders.where("o_orderpriority < '3'")).select("o_orderkey", "o_orderpriority")


_CM = "cm AS (SELECT label AS target, CASE WHEN vec_id % 7 < 4 THEN label ELSE (label + vec_id % 3 + 1) % 10 END AS pred, count(*) AS n FROM embeddings GROUP BY ALL)"


def _cm(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").selectExpr(
        "CAST(label AS BIGINT) AS target", "CAST(IF(vec_id % 7 < 4, label, (label + vec_id % 3 + 1) % 10) AS BIGINT) AS pred", "vec_id"
    )
    return m.confusion(rows)


@query(f"WITH {_CM} SELECT CAST(target AS BIGINT) AS target, CAST(pred AS BIGINT) AS pred, n FROM cm")
def confusion(spark, sf_dir):
    """Predictions by class."""
    return _cm(spark, sf_dir)


_SCORES = f"""{_CM}, s AS (SELECT c AS class, sum(t) AS support, sum(p) AS p, sum(tp) AS tp FROM (SELECT target AS c, n AS t, 0 AS p, CASE WHEN target = pred THEN n ELSE 0 END AS tp FROM cm
UNION ALL SELECT pred, 0, n, 0 FROM cm) GROUP BY c),
r AS (SELECT *, tp / (p + 1e-9) AS pr, tp / (support + 1e-9) AS re FROM s), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM r)"""


@query(f"WITH {_SCORES} SELECT CAST(class AS BIGINT) AS class, CAST(support AS BIGINT) AS support, {r4('pr')} AS \"precision\", {r4('re')} AS recall, {r4('f')} AS fbeta FROM f")
def class_scores(spark, sf_dir):
    """Precision, recall and F1 of each class."""
    s = m.class_scores(_cm(spark, sf_dir))
    return s.select("class", "support", *[half_up(F.col(c)).alias(c) for c in ("precision", "recall", "fbeta")])


@query(
    f"""WITH {_SCORES} SELECT 'macro' AS average, {r4("avg(pr)")} AS "precision", {r4("avg(re)")} AS recall, {r4("avg(f)")} AS fbeta FROM f
UNION ALL SELECT 'micro', {r4("sum(tp) / sum(support)")}, {r4("sum(tp) / sum(support)")}, {r4("sum(tp) / sum(support)")} FROM f
UNION ALL SELECT 'weighted', {r4("sum(pr * support) / sum(support)")}, {r4("sum(re * support) / sum(support)")}, {r4("sum(f * support) / sum(support)")} FROM f"""
)
def prf_scores(spark, sf_dir):
    """Their averages."""
    return m.averaged(_cm(spark, sf_dir))


@query(
    f"""WITH {_CM}, r AS (SELECT target, sum(n) AS r FROM cm GROUP BY 1), c AS (SELECT pred, sum(n) AS c FROM cm GROUP BY 1),
e AS (SELECT sum(power(target - pred, 2) * r * c) AS e FROM r, c), o AS (SELECT sum(power(target - pred, 2) * n) AS o, sum(n) AS t FROM cm)
SELECT {r4("1 - o * t / e")} AS kappa FROM e, o"""
)
def kappa(spark, sf_dir):
    """Quadratic kappa."""
    return m.kappa(_cm(spark, sf_dir), "quadratic")


@query(
    f"""WITH {_SCORES}, g AS (SELECT sum(tp)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(p * support)::DOUBLE AS pt, sum(p * p)::DOUBLE AS pp, sum(support * support)::DOUBLE AS tt FROM f)
SELECT {r4("(c * s - pt) / (sqrt(s * s - pp) * sqrt(s * s - tt))")} AS mcc FROM g"""
)
def mcc(spark, sf_dir):
    """Matthews correlation."""
    return m.matthews(_cm(spark, sf_dir))


_LAB = "lab AS (SELECT l.doc_id, CAST(quality AS BIGINT) AS target, d.source, (n_chars * 7 + l.doc_id * 13) % 101 AS score, CAST((n_chars * 7 + l.doc_id * 13) % 101 > 30 AS BIGINT) AS pred, n_chars FROM labels l JOIN documents d USING (doc_id))"


def _lab(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").selectExpr(
        "doc_id", "CAST(quality AS BIGINT) AS target", "source", "(n_chars * 7 + doc_id * 13) % 101 AS score",
        "CAST((n_chars * 7 + doc_id * 13) % 101 > 30 AS BIGINT) AS pred", "n_chars",
    )


@query(
    f"""WITH {_LAB} SELECT {r4("avg(CAST(pred = target AS INT))")} AS accuracy, {r4("1 - avg(CAST(pred = target AS INT))")} AS error_rate,
{r4("avg(CAST(CAST(score > 50 AS BIGINT) = target AS INT))")} AS accuracy_thresh, {r4("avg(CAST(pred = target AS INT)) FILTER (target <> 0)")} AS foreground_acc FROM lab"""
)
def accuracy_set(spark, sf_dir):
    """Accuracies."""
    return m.accuracies(_lab(spark, sf_dir), "score", 50, 0)


@query(f"WITH {_LAB} SELECT source, {r4('sum(pred * target) * 2.0 / (sum(pred + target) + 1e-9)')} AS dice, {r4('sum(pred * target) / (sum(pred + target) - sum(pred * target) + 1e-9)')} AS iou FROM lab GROUP BY source")
def dice_iou(spark, sf_dir):
    """Overlap of predictions and targets of each source."""
    return m.overlap(_lab(spark, sf_dir), "source")


_P, _T = "CAST(l_extendedprice AS DOUBLE)", "CAST(l_quantity * 1000 + 500 AS DOUBLE)"
_E = f"({_T} - {_P})"


@query(
    f"""SELECT {r4(f"avg({_E} * {_E})", 2)} AS mse, {r4(f"sqrt(avg({_E} * {_E}))")} AS rmse, {r4(f"avg(abs({_E}))")} AS mae, {r4(f"avg(pow(ln(1 + {_P}) - ln(1 + {_T}), 2))")} AS msle,
{r4(f"sqrt(avg(pow({_E} / {_T}, 2)))")} AS rmspe, {r4(f"1 - avg({_E} * {_E}) / var_pop({_T})")} AS r2, {r4(f"1 - var_samp({_E}) / var_samp({_T})")} AS explained FROM lineitem"""
)
def regression_metrics(spark, sf_dir):
    """Errors of a price guess."""
    li = table(spark, sf_dir, "lineitem")
    out = m.regression(li, F.col("l_extendedprice"), F.col("l_quantity") * 1000 + 500)
    return out.withColumn("mse", half_up(F.col("mse"), 2))


_ROC = f"""{_LAB}, b AS (SELECT score, sum(target) AS p, count(*) AS n FROM lab GROUP BY score),
pts AS (SELECT score, sum(n - p) OVER w / sum(n - p) OVER () AS fpr, sum(p) OVER w / sum(p) OVER () AS tpr FROM b WINDOW w AS (ORDER BY score DESC))"""


@query(f"WITH {_ROC} SELECT score, {r4('fpr')} AS fpr, {r4('tpr')} AS tpr FROM pts")
def roc_points(spark, sf_dir):
    """Rates at each score."""
    return m.roc_points(_lab(spark, sf_dir)).select("score", half_up(F.col("fpr")).alias("fpr"), half_up(F.col("tpr")).alias("tpr"))


@query(
    f"""WITH {_ROC}, t AS (SELECT fpr - coalesce(lag(fpr) OVER w, 0) AS dx, (tpr + coalesce(lag(tpr) OVER w, 0)) / 2 AS y FROM pts WINDOW w AS (ORDER BY score DESC))
SELECT {r4("sum(dx * y)")} AS auc FROM t"""
)
def auc(spark, sf_dir):
    """Area under the curve."""
    return m.auc(_lab(spark, sf_dir))


@query(f"WITH {_LAB} SELECT doc_id, score FROM lab ORDER BY score DESC, doc_id LIMIT 20")
def topk_losses(spark, sf_dir):
    """The twenty largest scores: a top-k report."""
    return m.top_losses(_lab(spark, sf_dir).select("doc_id", "score"), "score", "doc_id", 20)


@query(f"WITH {_CM} SELECT CAST(target AS BIGINT) AS target, CAST(pred AS BIGINT) AS pred, n FROM cm WHERE target <> pred AND n >= 3")
def most_confused(spark, sf_dir):
    """Classes often taken for others."""
    return m.most_confused(_cm(spark, sf_dir), 3)


@query(
    f"""WITH r AS (SELECT vec_id, label, j - 1 AS c, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[j] DESC, j) AS place FROM embeddings, range(1, 11) g(j))
SELECT {r4("avg(CAST(place <= 3 AS INT))")} AS top3 FROM r WHERE c = label"""
)
def topk_acc(spark, sf_dir):
    """Share of labels among the three largest of ten scores."""
    e = table(spark, sf_dir, "embeddings")
    hit = m.top_k_hit(F.slice("embedding", 1, 10), F.col("label"), 3)
    return e.agg(half_up(F.avg(hit.cast("double"))).alias("top3"))


@query(f"WITH {_LAB} SELECT {r4('exp(sum(score / 50.0 * n_chars) / sum(n_chars))')} AS perplexity, {r4('sum(score / 50.0 * n_chars) / sum(n_chars)')} AS loss FROM lab")
def perplexity_like(spark, sf_dir):
    """Perplexity of losses weighted by length."""
    return m.perplexity(_lab(spark, sf_dir).withColumn("loss", F.col("score") / 50.0), "loss", "n_chars")


@query(
    f"""WITH s AS (SELECT vec_id, [CASE WHEN 1 / (1 + exp(-(embedding[i + 1]::DOUBLE * 8))) > 0.5 THEN 1 ELSE 0 END FOR i IN range(10)] AS p,
  [CASE WHEN label = i OR (label + 3) % 10 = i THEN 1 ELSE 0 END FOR i IN range(10)] AS t FROM embeddings),
k AS (SELECT list_sum([a[1] * a[2] FOR a IN list_zip(p, t)])::DOUBLE AS tp, list_sum(p)::DOUBLE AS np, list_sum(t)::DOUBLE AS nt FROM s),
q AS (SELECT tp / (np + 1e-9) AS pr, tp / (nt + 1e-9) AS re FROM k) SELECT {r4("avg(5 * pr * re / (4 * pr + re + 1e-9))")} AS fbeta FROM q"""
)
def multilabel_fbeta(spark, sf_dir):
    """F2 of several labels a row."""
    e = table(spark, sf_dir, "embeddings")
    scores = F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * 8)
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((F.col("label") == i) | ((F.col("label") + 3) % 10 == i)).cast("long"))
    return m.multilabel_fbeta(e, scores, hot, 0.5)
