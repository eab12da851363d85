"""The 22 decision-support queries.

Each is a declarative plan: filters stand next to their scans, so that they are pushed into
Parquet; no side of a join carries a broadcast hint, the planner takes file sizes and run-time
statistics; money is summed as decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import amount, hits, money, when_at, year
from ..functions.predicates import between
from ..sources.tables import stock_of, table

SHIPPED = "l_shipdate"
AMOUNT = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)"
STOCK = "(SELECT l_partkey, l_suppkey, count(*) AS s_order_cnt, sum(l_quantity) AS s_quantity FROM lineitem GROUP BY l_partkey, l_suppkey)"


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def _line_measures() -> list:
    return [F.count("l_quantity").alias("quantity_count"), F.sum("l_quantity").alias("quantity_sum"), F.count("l_extendedprice").alias("amount_count"), amount().alias("amount_sum")]


def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and sum of quantity and amount by line number, for lines shipped after a day."""
    (lines,) = _t(spark, sf_dir, "lineitem")
    return lines.where(F.col(SHIPPED) > when_at("1998-01-01")).groupBy("l_linenumber").agg(*_line_measures())


def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the stock of lowest quantity among suppliers of a region (ties: lowest supplier)."""
    supplier, nation, part = _t(spark, sf_dir, "supplier", "nation", "part")
    suppliers = supplier.join(nation.where("n_regionkey = 1"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "s_name", "n_name")
    # The arg-min is an aggregate with partial results; a window would shuffle every stock row.
    lines = table(spark, sf_dir, "lineitem").join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")
    lowest = stock_of(lines).join(suppliers, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_partkey").agg(F.min(F.struct("s_quantity", "l_suppkey", "s_name", "n_name")).alias("m"))
    return lowest.join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_partkey").alias("i_id"), F.col("m.l_suppkey").alias("s_id"), F.col("m.s_quantity").alias("min_quantity"), "m.s_name", "m.n_name", "p_name")


def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount of recent orders of customers in a market segment."""
    customer, orders, lines = _t(spark, sf_dir, "customer", "orders", "lineitem")
    bought = customer.where(between("c_mktsegment", "B", "C")).join(orders.where(F.col("o_orderdate") >= when_at("1998-01-01")), F.col("o_custkey") == F.col("c_custkey"))
    return bought.join(lines.where(F.col(SHIPPED) >= when_at("1998-01-01")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderdate").agg(amount().alias("amount"))


def _delivered(lines: DataFrame, condition) -> DataFrame:
    """Per order the number of all lines and the last delivery of those that meet the condition.

    Both come from one aggregation, so the lines are scanned and shuffled once.
    """
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("o_ol_cnt"), F.max(F.when(condition, F.col(SHIPPED))).alias("last_delivery")).where("last_delivery IS NOT NULL")


def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a year with a delivery since, by number of lines."""
    orders, lines = _t(spark, sf_dir, "orders", "lineitem")
    chosen = orders.where(between("o_orderdate", when_at("1998-01-01"), when_at("1999-01-01")))
    return chosen.join(_delivered(lines, F.col(SHIPPED) >= when_at("1998-01-01")), F.col("l_orderkey") == F.col("o_orderkey")).where("last_delivery >= o_orderdate").groupBy("o_ol_cnt").agg(F.count("*").alias("order_count"))


def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of a region's suppliers by nation."""
    nation, supplier, lines = _t(spark, sf_dir, "nation", "supplier", "lineitem")
    suppliers = nation.where("n_regionkey = 1").join(supplier, F.col("s_nationkey") == F.col("n_nationkey"))
    return lines.where(F.col(SHIPPED) >= when_at("1998-01-01")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_nationkey", "n_name").agg(amount().alias("amount"))


def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount of lines of a year within a range of quantity."""
    (lines,) = _t(spark, sf_dir, "lineitem")
    return lines.where(between(SHIPPED, when_at("1998-01-01"), when_at("1999-01-01")) & between("l_quantity", 5, 25)).agg(amount().alias("amount"))


def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between two nations by year."""
    supplier, lines, orders, customer = _t(spark, sf_dir, "supplier", "lineitem", "orders", "customer")
    sold = lines.where(F.col(SHIPPED).between(when_at("1995-01-01"), when_at("2001-12-31"))).join(supplier.where("s_nationkey IN (3, 7)"), F.col("l_suppkey") == F.col("s_suppkey"))
    bought = orders.join(customer.where("c_nationkey IN (3, 7)"), F.col("o_custkey") == F.col("c_custkey"))
    return sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("s_nationkey").alias("supplier_nation"), F.col("c_nationkey").alias("customer_nation"), year(SHIPPED).alias("ship_year")).agg(amount().alias("amount"))


def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount by year of order and nation of supplier in a region."""
    nation, supplier, lines, orders = _t(spark, sf_dir, "nation", "supplier", "lineitem", "orders")
    sold = lines.join(nation.where("n_regionkey = 1").join(supplier, F.col("s_nationkey") == F.col("n_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    dated = orders.where(F.col("o_orderdate").between(when_at("1996-01-01"), when_at("1999-12-31")))
    return sold.join(dated, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(year("o_orderdate").alias("order_year"), F.col("s_nationkey").alias("nation_id")).agg(amount().alias("amount"))


def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount of some types of item by nation and year of order."""
    part, lines, supplier, nation, orders = _t(spark, sf_dir, "part", "lineitem", "supplier", "nation", "orders")
    sold = lines.join(part.where(between("p_type", "P", "T")), F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("n_nationkey").alias("nation_id"), year("o_orderdate").alias("order_year")).agg(amount().alias("amount"))


def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount by customer of one nation."""
    nation, customer, orders, lines = _t(spark, sf_dir, "nation", "customer", "orders", "lineitem")
    buyers = customer.join(nation.where("n_nationkey = 3"), F.col("c_nationkey") == F.col("n_nationkey"))
    bought = orders.where(F.col("o_orderdate") >= when_at("1998-01-01")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return lines.where(F.col(SHIPPED) >= when_at("1998-01-01")).join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_custkey", "c_name", "c_mktsegment", "n_name").agg(amount().alias("amount"))


def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with over a thousandth of a nation's stock orders."""
    (supplier,) = _t(spark, sf_dir, "supplier")
    # Orders of an item at the nation's suppliers are its lines there: no stock is needed in between.
    items = table(spark, sf_dir, "lineitem").join(supplier.where("s_nationkey = 3"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").groupBy(F.col("l_partkey").alias("i_id")).agg(F.count("*").alias("order_cnt"))
    # The total is one row; a window over all items would gather them in one task.
    total = items.agg(F.sum("order_cnt").alias("total"))
    return items.join(F.broadcast(total), F.col("order_cnt") > F.lit(0.001).cast("decimal(4,3)") * F.col("total")).select("i_id", "order_cnt")


def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of high and low priority by number of lines."""
    orders, lines = _t(spark, sf_dir, "orders", "lineitem")
    done = orders.where(F.col("o_orderdate") < when_at("2000-01-01")).join(_delivered(lines, F.col(SHIPPED) < when_at("2000-01-01")), F.col("l_orderkey") == F.col("o_orderkey"))
    urgent = F.col("o_orderpriority") <= "2-HIGH"
    return done.where("last_delivery >= o_orderdate").groupBy("o_ol_cnt").agg(hits(urgent).alias("low_cnt"), F.sum(F.when(urgent, 0).otherwise(1)).cast("long").alias("high_cnt"))


def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers have how many orders of low priority."""
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    per = orders.where(F.col("o_orderpriority") > "3-MEDIUM").groupBy("o_custkey").agg(F.count("*").alias("order_count"))
    # Counting before the join: one row per customer is shuffled, not one per order.
    return per.join(customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("order_count").agg(F.count("*").alias("customer_count"))


def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of promoted amount per item."""
    part, lines = _t(spark, sf_dir, "part", "lineitem")
    sold = lines.where(between(SHIPPED, when_at("1998-01-01"), when_at("1999-01-01"))).join(part, F.col("p_partkey") == F.col("l_partkey"))
    promo = F.sum(F.when(F.col("p_type").startswith("PR"), money("l_extendedprice")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double")
    return sold.groupBy("p_partkey").agg((promo / (1 + amount())).alias("promo_ratio"))


def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by supplier."""
    lines, supplier = _t(spark, sf_dir, "lineitem", "supplier")
    revenue = lines.where(F.col(SHIPPED) >= when_at("1998-01-01")).groupBy("l_suppkey").agg(amount().alias("revenue"))
    return revenue.join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_name", "revenue")


def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock places per item of some types at some suppliers."""
    part, supplier = _t(spark, sf_dir, "part", "supplier")
    lines = table(spark, sf_dir, "lineitem").join(supplier.where(F.col("s_name") < "Supplier#000000050"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")
    places = lines.join(part.where(between("p_type", "P", "T")), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("l_partkey", "l_suppkey").distinct()
    return places.groupBy("l_partkey").agg(F.count("*").alias("stock_count")).join(part.where(between("p_type", "P", "T")), F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "p_type", "p_retailprice", "stock_count")


def q17_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and sum of quantity and amount per item of some types."""
    lines, part = _t(spark, sf_dir, "lineitem", "part")
    return lines.join(part.where(between("p_type", "P", "T")), F.col("p_partkey") == F.col("l_partkey"), "left_semi").groupBy("l_partkey").agg(*_line_measures())


def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the amount of lines of less than their item's mean quantity."""
    lines, part = _t(spark, sf_dir, "lineitem", "part")
    chosen = lines.select("l_partkey", "l_quantity", "l_extendedprice").join(part.where(between("p_type", "P", "T")), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    mean = chosen.groupBy(F.col("l_partkey").alias("pk")).agg(F.avg("l_quantity").alias("avg_q"))
    return chosen.join(mean, F.col("pk") == F.col("l_partkey")).where("l_quantity < avg_q").agg((amount() / 2.0).alias("avg_yearly"))


def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large orders with their customers."""
    lines, orders, customer = _t(spark, sf_dir, "lineitem", "orders", "customer")
    large = lines.groupBy("l_orderkey").agg(amount().alias("amount")).where("amount > 200000")
    return large.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_orderdate", "c_custkey", "c_name", "amount")


def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount of lines by type, price and quantity; zero where there are none."""
    lines, part = _t(spark, sf_dir, "lineitem", "part")
    items = part.where(between("p_type", "P", "T") & between("p_retailprice", 910, 960))
    return lines.where(between("l_quantity", 5, 25)).join(items, F.col("p_partkey") == F.col("l_partkey"), "left_semi").agg(F.coalesce(amount(), F.lit(0.0)).alias("amount"))


def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation with more stock than half of what was shipped lately."""
    lines, part, supplier = _t(spark, sf_dir, "lineitem", "part", "supplier")
    local = supplier.where("s_nationkey = 3")
    # Stock and shipped quantity share their groups, so one aggregation gives both.
    both = lines.join(local, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("s_quantity"), F.sum(F.when(F.col(SHIPPED) > when_at("1998-01-01"), F.col("l_quantity"))).alias("used"))
    enough = both.where(2 * F.col("s_quantity") > F.col("used")).join(part.where(between("p_type", "P", "T")), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return local.join(enough, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name").distinct()


def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped after their order's day, per supplier of a nation."""
    supplier, lines, orders = _t(spark, sf_dir, "supplier", "lineitem", "orders")
    late = lines.join(supplier.where("s_nationkey = 3"), F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey")).where(F.col(SHIPPED) > F.col("o_orderdate"))
    return late.groupBy("s_suppkey", "s_name").agg(F.count("*").alias("late_count"))


def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without late orders whose balance is above the mean of such customers."""
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    idle = customer.where(between("c_mktsegment", "A", "I")).join(orders.where(F.col("o_orderdate") >= when_at("2001-01-01")), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    mean = idle.agg(F.avg("c_acctbal").alias("mean"))
    return idle.join(F.broadcast(mean), F.col("c_acctbal") > F.col("mean")).groupBy(F.substring("c_mktsegment", 1, 1).alias("code")).agg(F.count("*").alias("cust_count"), amount("c_acctbal").alias("balance_sum"))


def all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the 22 in order: one row each with its number of rows."""
    counts = [QUERIES[f"q{n:02d}"](spark, sf_dir).agg(F.lit(f"q{n:02d}").alias("query"), F.count("*").alias("n_rows")) for n in range(1, 23)]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


QUERIES = {f.__name__: f for f in (q01, q02, q03, q04, q05, q06, q07, q08, q09, q10, q11, q12, q13, q14, q15, q16, q17_agg, q17, q18, q19, q20, q21, q22)}

ORACLE_SQL = {
    "q01": f"SELECT l_linenumber, count(l_quantity) AS quantity_count, sum(l_quantity) AS quantity_sum, count(l_extendedprice) AS amount_count, {AMOUNT} AS amount_sum FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-01-01' GROUP BY l_linenumber",
    "q02": f"SELECT i_id, s_id, min_quantity, s_name, n_name, p_name FROM (SELECT st.l_partkey AS i_id, st.l_suppkey AS s_id, st.s_quantity AS min_quantity, s_name, n_name, p_name, row_number() OVER (PARTITION BY st.l_partkey ORDER BY st.s_quantity, st.l_suppkey) AS rn FROM {STOCK} st JOIN supplier ON s_suppkey = st.l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = st.l_partkey WHERE n_regionkey = 1) t WHERE rn = 1",
    "q03": f"SELECT o_orderkey, o_orderdate, {AMOUNT} AS amount FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment >= 'B' AND c_mktsegment < 'C' AND o_orderdate >= TIMESTAMP '1998-01-01' AND l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY o_orderkey, o_orderdate",
    "q04": "WITH cnt AS (SELECT l_orderkey, count(*) AS o_ol_cnt FROM lineitem GROUP BY l_orderkey), d AS (SELECT l_orderkey, max(l_shipdate) AS last_delivery FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY l_orderkey) SELECT o_ol_cnt, count(*) AS order_count FROM orders JOIN d ON d.l_orderkey = o_orderkey JOIN cnt ON cnt.l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' AND last_delivery >= o_orderdate GROUP BY o_ol_cnt",
    "q05": f"SELECT n_nationkey, n_name, {AMOUNT} AS amount FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey WHERE n_regionkey = 1 AND l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY n_nationkey, n_name",
    "q06": f"SELECT {AMOUNT} AS amount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_quantity >= 5 AND l_quantity < 25",
    "q07": f"SELECT s_nationkey AS supplier_nation, c_nationkey AS customer_nation, CAST(year(l_shipdate) AS BIGINT) AS ship_year, {AMOUNT} AS amount FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey IN (3, 7) AND c_nationkey IN (3, 7) AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate <= TIMESTAMP '2001-12-31' GROUP BY 1, 2, 3",
    "q08": f"SELECT CAST(year(o_orderdate) AS BIGINT) AS order_year, s_nationkey AS nation_id, {AMOUNT} AS amount FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE n_regionkey = 1 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31' GROUP BY 1, 2",
    "q09": f"SELECT n_nationkey AS nation_id, CAST(year(o_orderdate) AS BIGINT) AS order_year, {AMOUNT} AS amount FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey WHERE p_type >= 'P' AND p_type < 'T' GROUP BY 1, 2",
    "q10": f"SELECT c_custkey, c_name, c_mktsegment, n_name, {AMOUNT} AS amount FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE n_nationkey = 3 AND o_orderdate >= TIMESTAMP '1998-01-01' AND l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY c_custkey, c_name, c_mktsegment, n_name",
    "q11": f"SELECT i_id, order_cnt FROM (SELECT st.l_partkey AS i_id, CAST(sum(s_order_cnt) AS BIGINT) AS order_cnt, sum(sum(s_order_cnt)) OVER () AS total FROM {STOCK} st JOIN supplier ON s_suppkey = st.l_suppkey WHERE s_nationkey = 3 GROUP BY st.l_partkey) t WHERE order_cnt > 0.001 * total",
    "q12": "WITH cnt AS (SELECT l_orderkey, count(*) AS o_ol_cnt FROM lineitem GROUP BY l_orderkey), d AS (SELECT l_orderkey, max(l_shipdate) AS last_delivery FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01' GROUP BY l_orderkey) SELECT o_ol_cnt, CAST(sum(CASE WHEN o_orderpriority <= '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_cnt, CAST(sum(CASE WHEN o_orderpriority <= '2-HIGH' THEN 0 ELSE 1 END) AS BIGINT) AS high_cnt FROM orders JOIN d ON d.l_orderkey = o_orderkey JOIN cnt ON cnt.l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '2000-01-01' AND last_delivery >= o_orderdate GROUP BY o_ol_cnt",
    "q13": "SELECT order_count, count(*) AS customer_count FROM (SELECT c_custkey, count(*) AS order_count FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority > '3-MEDIUM' GROUP BY c_custkey) t GROUP BY order_count",
    "q14": f"SELECT p_partkey, CAST(sum(CASE WHEN p_type LIKE 'PR%' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / (1 + {AMOUNT}) AS promo_ratio FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY p_partkey",
    "q15": f"SELECT s_suppkey, s_name, {AMOUNT} AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY s_suppkey, s_name",
    "q16": f"SELECT p_partkey, p_name, p_type, p_retailprice, count(*) AS stock_count FROM {STOCK} st JOIN part ON p_partkey = st.l_partkey JOIN supplier ON s_suppkey = st.l_suppkey WHERE p_type >= 'P' AND p_type < 'T' AND s_name < 'Supplier#000000050' GROUP BY p_partkey, p_name, p_type, p_retailprice",
    "q17_agg": f"SELECT l_partkey, count(l_quantity) AS quantity_count, sum(l_quantity) AS quantity_sum, count(l_extendedprice) AS amount_count, {AMOUNT} AS amount_sum FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type >= 'P' AND p_type < 'T' GROUP BY l_partkey",
    "q17": f"SELECT {AMOUNT} / 2.0 AS avg_yearly FROM lineitem l JOIN (SELECT l_partkey AS pk, avg(l_quantity) AS avg_q FROM lineitem GROUP BY l_partkey) a ON a.pk = l.l_partkey JOIN part ON p_partkey = l.l_partkey WHERE p_type >= 'P' AND p_type < 'T' AND l_quantity < avg_q",
    "q18": f"SELECT o_orderkey, o_orderdate, c_custkey, c_name, amount FROM (SELECT l_orderkey, {AMOUNT} AS amount FROM lineitem GROUP BY l_orderkey) l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE amount > 200000",
    "q19": f"SELECT coalesce({AMOUNT}, 0) AS amount FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type >= 'P' AND p_type < 'T' AND p_retailprice >= 910 AND p_retailprice < 960 AND l_quantity >= 5 AND l_quantity < 25",
    "q20": f"WITH u AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS used FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-01-01' GROUP BY l_partkey, l_suppkey) SELECT DISTINCT s_suppkey, s_name FROM {STOCK} st JOIN u ON u.l_partkey = st.l_partkey AND u.l_suppkey = st.l_suppkey JOIN part ON p_partkey = st.l_partkey JOIN supplier ON s_suppkey = st.l_suppkey WHERE p_type >= 'P' AND p_type < 'T' AND 2 * s_quantity > used AND s_nationkey = 3",
    "q21": "SELECT s_suppkey, s_name, count(*) AS late_count FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE s_nationkey = 3 AND l_shipdate > o_orderdate GROUP BY s_suppkey, s_name",
    "q22": "WITH c AS (SELECT c_custkey, c_acctbal, substring(c_mktsegment, 1, 1) AS code FROM customer WHERE c_mktsegment >= 'A' AND c_mktsegment < 'I' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')) SELECT code, count(*) AS cust_count, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance_sum FROM c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM c) GROUP BY code",
}
ORACLE_SQL["all_queries"] = " UNION ALL ".join(f"SELECT 'q{n:02d}' AS query, count(*) AS n_rows FROM ({ORACLE_SQL[f'q{n:02d}']})" for n in range(1, 23))
QUERIES["all_queries"] = all_queries
