"""Reconciliation, lookup, aggregation and set queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compare import numbers_equal
from ..operators import reconcile, sequence, sink
from ..store import fresh_path
from .registry import load, query

PRICES = """
WITH s AS (SELECT c_custkey AS label, c_acctbal AS value, 'customer' AS source, 1 AS priority FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, 'supplier', 2 FROM supplier
UNION ALL SELECT p_partkey, p_retailprice, 'part', 3 FROM part),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY priority) AS n FROM s) t WHERE n = 1)"""

SAME = "(abs({a} - {b}) <= 1e-6 OR abs({a} - {b}) <= 1e-4 * greatest(abs({a}), abs({b})))"


def price_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("label"), F.col("c_acctbal").alias("value"))
    supplier = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("label"), F.col("s_acctbal").alias("value"))
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), F.col("p_retailprice").alias("value"))
    return reconcile.stacked([("customer", customer), ("supplier", supplier), ("part", part)])


@query(PRICES + " SELECT label, priority, source, value FROM f")
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.first_source(price_sources(spark, sf_dir), "label", ["value"])


RECONCILED = PRICES + f""", r AS (SELECT o_orderkey AS label, o_totalprice AS old_value, f.value AS new_value, f.source,
CASE WHEN f.source IS NULL THEN 'attention' WHEN {SAME.format(a='o_totalprice', b='f.value')} THEN 'copied' ELSE 'updated' END AS status
FROM orders LEFT JOIN f ON f.label = o_orderkey)"""


def reconciled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    destination = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("label"), F.col("o_totalprice").alias("value"))
    return reconcile.reconciled(destination, price_sources(spark, sf_dir), "label", "value")


@query(RECONCILED + " SELECT * FROM r")
def reconcile_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled_orders(spark, sf_dir)


@query(RECONCILED + """ SELECT source, count_if(status = 'updated') AS updated, count_if(status = 'copied') AS copied,
round(count_if(status = 'updated') * 100.0 / count(*), 2)::DOUBLE AS updated_percent FROM r WHERE source IS NOT NULL GROUP BY source""")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.source_summary(reconciled_orders(spark, sf_dir))


@query(RECONCILED + """ SELECT source, label, status AS action, 'reconcile' AS stage,
CASE status WHEN 'updated' THEN 'value replaced' WHEN 'copied' THEN 'no value change' ELSE 'in no source' END AS reason FROM r""")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.events(reconciled_orders(spark, sf_dir), "label")


@query(RECONCILED + """ SELECT count(DISTINCT label) AS all_labels, count(DISTINCT label) FILTER (status = 'updated') AS updated_labels,
count(DISTINCT label) FILTER (status = 'copied') AS copied_labels, count(DISTINCT label) FILTER (status = 'attention') AS attention_labels FROM r""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = lambda s: F.countDistinct(F.when(F.col("status") == s, F.col("label"))).alias(f"{s}_labels")
    return reconciled_orders(spark, sf_dir).agg(F.countDistinct("label").alias("all_labels"), *map(distinct, ("updated", "copied", "attention")))


@query("""SELECT indicator, count(*) AS n FROM (SELECT CASE WHEN c.k IS NULL THEN 'left_only' WHEN o.k IS NULL THEN 'right_only' ELSE 'both' END AS indicator
FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000) o FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) c ON o.k = c.k) t GROUP BY indicator""")
def merge_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"))
    customer = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return reconcile.indicated(orders, customer, "k").groupBy("indicator").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = load(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return load(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@query(f"""SELECT l_returnflag, count_if({SAME.format(a='l_extendedprice', b='r')}) AS unchanged, count_if(NOT {SAME.format(a='l_extendedprice', b='r')}) AS changed
FROM (SELECT l_returnflag, l_extendedprice, floor(l_extendedprice / 10) * 10 AS r FROM lineitem) t GROUP BY l_returnflag""")
def changed_within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", (F.floor(F.col("l_extendedprice") / 10) * 10.0).alias("r"))
    same = numbers_equal(F.col("l_extendedprice"), F.col("r"))
    return rows.groupBy("l_returnflag").agg(F.count_if(same).alias("unchanged"), F.count_if(~same).alias("changed"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p_name LIKE '%ring' OR p_name LIKE '%rod' THEN 'scalar' WHEN p_name LIKE '%bolt' THEN 'array'
WHEN p_name LIKE '%widget' THEN 'map' WHEN p_name LIKE '%gear' THEN 'curve' ELSE 'unhandled' END AS kind FROM part) t GROUP BY kind""")
def typed_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("scalar", ("ring", "rod")), ("array", ("bolt",)), ("map", ("widget",)), ("curve", ("gear",))]
    kind = F.lit("unhandled")
    for name, ends in reversed(rules):
        kind = F.when(F.expr(" or ".join(f"endswith(p_name, '{e}')" for e in ends)), name).otherwise(kind)
    return load(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT suffix, count(*) AS n FROM (SELECT split_part(p_name, ' ', -1) AS suffix FROM part) t GROUP BY suffix")
def suffix_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy(F.substring_index("p_name", " ", -1).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey, coalesce(n_name, 'NOT FOUND') AS function_name, coalesce(n_regionkey, -1) AS region FROM supplier
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey""")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").where("n_regionkey < 3")
    joined = load(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("s_suppkey", F.coalesce("n_name", F.lit("NOT FOUND")).alias("function_name"), F.coalesce("n_regionkey", F.lit(-1)).alias("region"))


@query("""SELECT p_partkey, coalesce(e.v, p3.v, p1.v, 'default') AS found FROM part LEFT JOIN (VALUES ('PROMO', 'exact promo')) e(k, v) ON p_type = e.k
LEFT JOIN (VALUES ('PRO', 'never'), ('STA', 'sta'), ('SMA', 'sma')) p3(k, v) ON substr(p_type, 1, 3) = p3.k
LEFT JOIN (VALUES ('S', 's'), ('L', 'l')) p1(k, v) ON substr(p_type, 1, 1) = p1.k""")
def tiered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = spark.createDataFrame([("PROMO", "exact promo")], "entry string, value string")
    prefix = spark.createDataFrame([("PRO", "never"), ("STA", "sta"), ("SMA", "sma"), ("S", "s"), ("L", "l")], "entry string, value string")
    return reconcile.tiered(load(spark, sf_dir, "part"), "p_type", exact, prefix, F.lit("default")).select("p_partkey", "found")


@query("""SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def dimension_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    orders = load(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name")
    joined = load(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), revenue.alias("revenue"))


@query("""SELECT band, count(*) AS n FROM lineitem JOIN (SELECT i * 10 AS lo, i * 10 + 10 AS hi, 'band' || i AS band FROM range(6) t(i)) b
ON l_quantity >= lo AND l_quantity < hi GROUP BY band""")
def range_segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(6).select((F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 10).alias("hi"), F.concat(F.lit("band"), F.col("id").cast("string")).alias("band"))
    joined = load(spark, sf_dir, "lineitem").join(F.broadcast(bands), (F.col("l_quantity") >= F.col("lo")) & (F.col("l_quantity") < F.col("hi")))
    return joined.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def _kept(order: str) -> str:
    return f"""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts {order}, event_id {order}) AS n FROM events) t WHERE n = 1"""


@query(_kept("ASC"))
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occurrence(spark, sf_dir, last=False)


@query(_kept("DESC"))
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occurrence(spark, sf_dir, last=True)


def _occurrence(spark: SparkSession, sf_dir: str, last: bool) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("id", F.col("event_id"))
    return reconcile.occurrence(rows, ["user_id"], ["ts", "id"], ["event_id", "event_type"], last).select("user_id", "event_id", "event_type")


@query("""SELECT source, doc_id, score FROM (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM
(SELECT source, doc_id, length(text) + CASE WHEN lang = 'en' THEN 100 ELSE 0 END AS score FROM documents WHERE text IS NOT NULL) s) t WHERE n = 1""")
def best_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.length("text") + F.when(F.col("lang") == "en", 100).otherwise(0)
    rows = load(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", score.cast("long").alias("score"))
    return reconcile.occurrence(rows.withColumns({"rank": -F.col("score"), "id": F.col("doc_id")}), ["source"], ["rank", "id"], ["doc_id", "score"])


@query("SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY c_mktsegment")
def mean_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("c_acctbal").alias("n"), F.round(F.avg("c_acctbal"), 2).alias("mean"))


@query("""SELECT 'pairs' AS measure, count(*)::DOUBLE AS value FROM customer UNION ALL SELECT 'mean', round(avg(c_acctbal), 2) FROM customer""")
def global_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = load(spark, sf_dir, "customer").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("c_acctbal"), 2).alias("mean"))
    return one.select(F.expr("stack(2, 'pairs', n, 'mean', mean) as (measure, value)"))


@query("""SELECT role, count(*) AS n, count(DISTINCT turn) AS n_turns, list_sort(list(DISTINCT turn)) AS turns FROM conversations GROUP BY role""")
def set_agg_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns at which a role speaks: how many there are, and all of them."""
    return reconcile.whole_sets(load(spark, sf_dir, "conversations"), "role", "turn").withColumnsRenamed({"n_distinct": "n_turns", "values": "turns"})


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS member FROM orders""")
def grouped_by_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", member.alias("member"))


@query("""SELECT 'event' AS source, event_type AS action, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'order', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus""")
def event_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(F.lit("event").alias("source"), F.col("event_type").alias("action"))
    orders = load(spark, sf_dir, "orders").select(F.lit("order").alias("source"), F.col("o_orderstatus").alias("action"))
    return events.unionByName(orders).groupBy("source", "action").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) t
UNION ALL SELECT 'missing', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) t
UNION ALL SELECT 'any', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) t""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey")
    customer = load(spark, sf_dir, "customer")
    keys = customer.select("c_custkey")
    parts = {"both": orders.intersect(customer.where("c_acctbal > 0").select("c_custkey")), "missing": keys.exceptAll(orders.distinct()), "any": keys.union(orders).distinct()}
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("""WITH m AS (SELECT s_suppkey, coalesce(n_name, 'NOT FOUND') AS f FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) n ON s_nationkey = n_nationkey),
g AS (SELECT f, min(s_suppkey) AS first FROM m GROUP BY f)
SELECT f AS function_name, CASE WHEN f = 'NOT FOUND' THEN 1 ELSE 0 END AS late, first, 0 AS line, '*** ' || f || ' ***' AS text FROM g
UNION ALL SELECT m.f, CASE WHEN m.f = 'NOT FOUND' THEN 1 ELSE 0 END, first, row_number() OVER (PARTITION BY m.f ORDER BY s_suppkey), 'S' || s_suppkey FROM m JOIN g USING (f)
UNION ALL SELECT f, CASE WHEN f = 'NOT FOUND' THEN 1 ELSE 0 END, first, 1000000 + k, '' FROM g, (VALUES (1), (2)) b(k)""")
def attention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in order of first appearance, a header before each, two blank rows after, NOT FOUND last."""
    nation = load(spark, sf_dir, "nation").where("n_regionkey < 4")
    rows = load(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("NOT FOUND")).alias("f"))
    members = sequence.numbered(rows, ["f"], "s_suppkey").withColumnRenamed("number", "line")
    item = lambda line, text: F.struct(line.cast("long").alias("line"), text.alias("text"))
    extra = F.when(
        F.col("line") == 1,
        F.array(item(F.lit(0), F.concat(F.lit("*** "), "f", F.lit(" ***"))), item(F.lit(1000001), F.lit("")), item(F.lit(1000002), F.lit(""))),
    ).otherwise(F.array().cast("array<struct<line: bigint, text: string>>"))
    own_line = F.array(item(F.col("line"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))))
    late = F.when(F.col("f") == "NOT FOUND", 1).otherwise(0)
    return members.select(F.col("f").alias("function_name"), late.alias("late"), "first", F.inline(F.concat(own_line, extra)))


@query("""SELECT label_count, count(*) AS n FROM (SELECT o_custkey, count(*) AS label_count FROM orders GROUP BY o_custkey) t GROUP BY label_count""")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("label_count")).groupBy("label_count").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment, list(c_custkey ORDER BY c_acctbal DESC, c_custkey)[1:8] AS sample, count(*) AS total FROM customer GROUP BY c_mktsegment""")
def sample_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    rows = load(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(own).alias("n"))
    first = rows.where("n <= 8").groupBy("c_mktsegment").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "c_custkey"))), lambda p: p["c_custkey"]).alias("sample"))
    total = rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("total"))
    return first.join(total, "c_mktsegment")


@query("""SELECT coalesce(a.l_orderkey, b.l_orderkey) AS label, coalesce(a.l_linenumber, b.l_linenumber) AS block, a.l_quantity AS left_value, b.l_quantity AS right_value
FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) a
FULL JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def block_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(flag: str, name: str) -> DataFrame:
        rows = load(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
        return rows.groupBy(F.col("l_orderkey").alias("label"), F.col("l_linenumber").alias("block")).agg(F.max("l_quantity").alias(name))

    return side("A", "left_value").join(side("R", "right_value"), ["label", "block"], "full")


@query("""SELECT row_number() OVER (ORDER BY o_orderpriority NULLS FIRST, o_custkey NULLS FIRST, o_orderkey) - 1 AS row, o_orderpriority AS module, o_custkey, o_orderkey FROM orders""")
def sorted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by (module, label), written as many files in order and read back with their place."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("module"), "o_custkey", "o_orderkey")
    path = fresh_path(spark, "sorted-records")
    sink.write_sorted(rows, ["module", "o_custkey", "o_orderkey"], path)
    return sink.read_sorted(spark, path).select("row", "module", "o_custkey", "o_orderkey")
