"""Queries: projection, filters, joins, aggregation, sorting, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import aggregates as A
from ..functions.values import int_div, is_in, ratio
from .registry import Tables, query

# --- projection and filters ---------------------------------------------------------------------------------------


@query("SELECT c_custkey, upper(c_name) AS name_upper, round(c_acctbal * 2, 2) AS twice FROM customer")
def projection(t: Tables):
    return t.customer.select("c_custkey", F.upper("c_name").alias("name_upper"), F.round(F.col("c_acctbal") * 2, 2).alias("twice"))


@query("SELECT p_partkey, p_size, p_size + 1 AS p_next, p_retailprice FROM part")
def with_columns(t: Tables):
    return t.part.select("p_partkey", "p_size", "p_retailprice").withColumns({"p_next": F.col("p_size") + 1})


@query("SELECT l_orderkey, l_linenumber, (l_orderkey - 700) // 7 AS q, (l_orderkey - 700) % 7 AS r, -l_linenumber AS neg, round(l_extendedprice / nullif(l_quantity, 0), 7) AS unit FROM lineitem")
def arithmetic(t: Tables):
    k = F.col("l_orderkey") - 700
    return t.lineitem.select("l_orderkey", "l_linenumber", int_div(k, F.lit(7)).alias("q"), (k % 7).alias("r"), (-F.col("l_linenumber")).alias("neg"), F.round(ratio(F.col("l_extendedprice"), F.col("l_quantity")), 7).alias("unit"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'", name="filter")
def filter_(t: Tables):
    return t.lineitem.where((F.col("l_quantity") > 30) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice >= 200000 AND o_orderstatus <> 'F') OR NOT (o_totalprice > 5000)")
def predicates(t: Tables):
    c = F.col
    return t.orders.where(((c("o_totalprice") >= 200000) & (c("o_orderstatus") != "F")) | ~(c("o_totalprice") > 5000)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size IN (11, 13, 15, 20) AND p_name IS NOT NULL")
def in_between(t: Tables):
    return t.part.where(F.col("p_size").between(10, 20) & is_in(F.col("p_size"), [11, 13, 15, 20]) & F.col("p_name").isNotNull()).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%E%' AND p_name NOT LIKE '%zz%' AND p_brand ILIKE 'brand%'", name="like")
def like_(t: Tables):
    c = F.col
    return t.part.where(c("p_type").like("%E%") & ~c("p_name").like("%zz%") & c("p_brand").ilike("brand%")).select("p_partkey", "p_type")


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_totalprice AS DECIMAL(18, 2))::DOUBLE AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders", name="cast")
def cast_(t: Tables):
    c = F.col
    return t.orders.select("o_orderkey", c("o_orderkey").cast("string").alias("key_text"), c("o_totalprice").cast("decimal(18,2)").cast("double").alias("price"), c("o_orderdate").cast("date").cast("string").alias("day"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' END AS many FROM lineitem")
def case_when(t: Tables):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(q < 10, "few").when(q < 30, "some").alias("many"))


# --- joins --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_inner(t: Tables):
    # Nations and regions are fixed lists; Spark broadcasts them by their size.
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY 1")
def join_left(t: Tables):
    big = t.orders.where("o_totalprice > 300000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT s_suppkey, n_nationkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(t: Tables):
    return t.supplier.where("s_acctbal > 5000").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_nationkey")


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) c FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON c_custkey = s_suppkey")
def join_full(t: Tables):
    return t.customer.where("c_acctbal > 9000").join(t.supplier.where("s_acctbal > 0"), F.col("c_custkey") == F.col("s_suppkey"), "full").select("c_custkey", "s_suppkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi(t: Tables):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t: Tables):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def in_subquery(t: Tables):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey").distinct()
    return t.lineitem.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def scalar_subquery(t: Tables):
    limit = t.orders.agg((F.avg("o_totalprice") * 1.5).alias("limit")).scalar()
    return t.orders.where(F.col("o_totalprice") > limit).select("o_orderkey", "o_totalprice")


# --- aggregation --------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def groupby_agg(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, round(sum(value), 4) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY 1")
def basic_aggs(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("s"), F.round(F.avg("value"), 6).alias("a"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def count_distinct(t: Tables):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 4) AS v FROM events GROUP BY 1")
def stddev_var(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.var_samp("value"), 4).alias("v"))


@query("SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def median_quantile(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("med"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("SELECT event_type, abs(count(DISTINCT user_id) - count(DISTINCT user_id)) <= 0.05 * count(DISTINCT user_id) AS near_exact FROM events GROUP BY 1")
def approx_distinct(t: Tables):
    # Of distinct pairs, which leave both counts as they are: beside a DISTINCT each user's group would hold a sketch of its own.
    exact, approx = F.count("user_id"), F.approx_count_distinct("user_id", 0.01)
    return t.events.select("event_type", "user_id").distinct().groupBy("event_type").agg((F.abs(exact - approx) <= 0.05 * exact).alias("near_exact"))


@query("SELECT user_id, first(value ORDER BY ts, event_id) AS f, last(value ORDER BY ts, event_id) AS l FROM events GROUP BY 1")
def first_last(t: Tables):
    ts, seq = F.col("ts"), F.col("event_id")
    return t.events.groupBy("user_id").agg(A.first_by(F.col("value"), ts, seq).alias("f"), A.last_by(F.col("value"), ts, seq).alias("l"))


@query("SELECT event_type, round(sum(value * (user_id + 1)) / sum(user_id + 1), 6) AS vwap FROM events GROUP BY 1")
def vwap(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(A.vwap(F.col("value"), F.col("user_id") + 1), 6).alias("vwap"))


@query("SELECT user_id, round(sum(value * event_id) / nullif(sum(event_id), 0), 6) AS wavg FROM events GROUP BY 1")
def wavg(t: Tables):
    return t.events.groupBy("user_id").agg(F.round(A.wavg(F.col("event_id"), F.col("value")), 6).alias("wavg"))


@query("SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS r, round(covar_samp(l_extendedprice, l_quantity), 2) AS cov, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def corr_regr(t: Tables):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(A.corr(y, x), 6).alias("r"), F.round(F.covar_samp(y, x), 2).alias("cov"), F.round(A.slope(y, x), 4).alias("slope"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(t: Tables):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t: Tables):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t: Tables):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def grouping_sets(t: Tables):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.groupingSets([[s], [p]], s, p).agg(F.count(F.lit(1)).alias("n")).select("o_orderstatus", "o_orderpriority", "n")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


# --- sort, limit, sets, subqueries --------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders QUALIFY place <= 100")
def sort(t: Tables):
    top = t.orders.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(100)
    return top.select("o_orderkey", "o_totalprice", F.row_number().over(Window.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey")).cast("long").alias("place"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 10")
def limit_offset(t: Tables):
    return t.customer.select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").offset(10).limit(20)


@query("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 10")
def topk(t: Tables):
    sums = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("x"))
    return sums.orderBy(F.col("x").desc(), "l_suppkey").limit(10).select("l_suppkey", F.round("x", 2).alias("total"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables):
    return union_all(t).distinct()


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def intersect(t: Tables):
    return t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("k")).intersect(t.supplier.where("s_acctbal > 0").select("s_suppkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier", name="except")
def except_(t: Tables):
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).exceptAll(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))


@query("WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), best AS (SELECT max(total) AS m FROM spend) SELECT o_custkey, round(total, 2) AS total FROM spend, best WHERE total > 0.8 * m")
def cte(t: Tables):
    t.orders.createOrReplaceTempView("tm_orders")
    return t.spark.sql("WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM tm_orders GROUP BY 1) SELECT o_custkey, round(total, 2) AS total FROM spend WHERE total > 0.8 * (SELECT max(total) FROM spend)")


@query("SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
def select_except(t: Tables):
    return t.customer.drop("c_name", "c_acctbal")


# --- scalar functions ---------------------------------------------------------------------------------------------


@query("""SELECT event_id, abs(value - 50) AS a, round(ln(value + 1), 6) AS l, round(log10(value + 1), 6) AS l10, round(exp(value / 1000), 6) AS e, round(sqrt(abs(value)), 6) AS sq,
    sign(value - 50)::DOUBLE AS sg, round(value, 1) AS r, floor(value)::BIGINT AS fl, ceil(value)::BIGINT AS ce, greatest(value, 50.0) AS g, least(value, 50.0) AS ls, round(power(value, 2), 4) AS p FROM events""")
def math_scalar(t: Tables):
    v = F.col("value")
    return t.events.select("event_id", F.abs(v - 50).alias("a"), F.round(F.ln(v + 1), 6).alias("l"), F.round(F.log10(v + 1), 6).alias("l10"), F.round(F.exp(v / 1000), 6).alias("e"), F.round(F.sqrt(F.abs(v)), 6).alias("sq"), F.signum(v - 50).alias("sg"), F.round(v, 1).alias("r"), F.floor(v).alias("fl"), F.ceil(v).alias("ce"), F.greatest(v, F.lit(50.0)).alias("g"), F.least(v, F.lit(50.0)).alias("ls"), F.round(F.pow(v, F.lit(2)), 4).alias("p"))


@query("SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS h, extract(year FROM ts)::INTEGER AS y, extract(month FROM ts)::INTEGER AS mo, extract(day FROM ts)::INTEGER AS d, extract(hour FROM ts)::INTEGER AS hh, ts + INTERVAL 90 MINUTE AS later, strftime(ts, '%Y-%m-%d') AS day FROM events")
def date_scalar(t: Tables):
    ts = F.col("ts")
    return t.events.select("event_id", F.date_trunc("hour", ts).cast("timestamp_ntz").alias("h"), F.year(ts).alias("y"), F.month(ts).alias("mo"), F.day(ts).alias("d"), F.hour(ts).alias("hh"), (ts + F.expr("INTERVAL 90 MINUTE")).alias("later"), ts.cast("date").cast("string").alias("day"))


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, substr(p_name, 2, 3) AS s, replace(p_brand, '#', '-') AS r, trim('  ' || p_brand || ' ') AS t, concat(p_brand, '/', p_type) AS c, instr(p_name, 'a') AS i, lpad(p_brand, 12, '*') AS lp, reverse(p_brand) AS rv FROM part")
def string_scalar(t: Tables):
    n, b = F.col("p_name"), F.col("p_brand")
    return t.part.select("p_partkey", F.upper(n).alias("u"), F.lower("p_type").alias("l"), F.length(n).cast("long").alias("n"), F.substring(n, 2, 3).alias("s"), F.replace(b, F.lit("#"), F.lit("-")).alias("r"), F.trim(F.concat(F.lit("  "), b, F.lit(" "))).alias("t"), F.concat(b, F.lit("/"), "p_type").alias("c"), F.instr(n, "a").cast("long").alias("i"), F.lpad(b, 12, "*").alias("lp"), F.reverse(b).alias("rv"))


@query("SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '.', 'g') AS blanked, regexp_matches(p_type, '^[A-M]') AS early FROM part")
def regex_scalar(t: Tables):
    return t.part.select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.regexp_replace("p_name", "[aeiou]", ".").alias("blanked"), F.col("p_type").rlike("^[A-M]").alias("early"))


@query("SELECT user_id, len(list(value)) AS n, round(list_sum(list_filter(list(value), lambda x: x > 50)), 4) AS big, list_max(list(event_id)) AS last, list_contains(list(event_type), 'click') AS clicked FROM events GROUP BY 1")
def array_scalar(t: Tables):
    v = F.collect_list("value")
    big = F.aggregate(F.filter(v, lambda x: x > 50), F.lit(0.0), lambda a, x: a + x)
    return t.events.groupBy("user_id").agg(F.size(v).cast("long").alias("n"), F.round(F.when(F.size(F.filter(v, lambda x: x > 50)) > 0, big), 4).alias("big"), F.array_max(F.collect_list("event_id")).alias("last"), F.array_contains(F.collect_list("event_type"), "click").alias("clicked"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_scalar(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS kind, CASE WHEN nullif(event_type, 'view') IS NULL THEN 1 ELSE 0 END AS viewed FROM events")
def null_scalar(t: Tables):
    e = F.col("event_type")
    return t.events.select("event_id", F.coalesce(F.nullif(e, F.lit("click")), F.lit("none")).alias("kind"), F.when(F.nullif(e, F.lit("view")).isNull(), 1).otherwise(0).alias("viewed"))
