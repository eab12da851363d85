"""Batch forms of key-value, banking, order-entry and social-graph operations.

The graph's edges are derived from the test tables: a user follows another if an event of theirs
carries that user's number; posts are the conversations' turns of the user of that number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.measures import amount, money, when_at
from ..functions.predicates import between
from ..sources.tables import table

# --- banking --------------------------------------------------------------------------------------


def apply_deltas(accounts: DataFrame, deltas: DataFrame, key: str, balance: str, delta: str, floor: float | None = None) -> DataFrame:
    """Balances after all deltas of a batch; with a floor, an account that would fall below stays."""
    total = deltas.groupBy(key).agg(amount(delta).alias("__delta"))
    after = F.col(balance) + F.coalesce("__delta", F.lit(0.0))
    allowed = F.lit(True) if floor is None else (after >= F.lit(floor)) | F.col("__delta").isNull()
    return accounts.join(total, key, "left").select(key, F.when(allowed, after).otherwise(F.col(balance)).alias(balance), allowed.alias("applied"))


def transfer(accounts: DataFrame, moves: DataFrame, key: str, balance: str, source: str, target: str, value: str) -> DataFrame:
    """Payments between accounts: two deltas each, summed per account in one shuffle."""
    legs = moves.select(F.explode(F.array(F.struct(F.col(source).alias(key), (-F.col(value)).alias("d")), F.struct(F.col(target).alias(key), F.col(value).alias("d")))).alias("m")).select("m.*")
    return apply_deltas(accounts, legs, key, balance, "d").drop("applied")


def bank_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two balances of a customer together: the account and what orders hold."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(amount("o_totalprice").alias("held"))
    return customer.join(held, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", (F.col("c_acctbal") + F.coalesce("held", F.lit(0.0))).alias("balance"))


def bank_deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"), "value")
    return apply_deltas(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), deltas, "c_custkey", "c_acctbal", "value").drop("applied")


def bank_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Withdrawals, refused where the balance would fall below zero."""
    deltas = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), (-F.col("o_totalprice") / 100).alias("d"))
    return apply_deltas(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), deltas, "c_custkey", "c_acctbal", "d", 0.0)


def bank_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", (F.col("user_id") + 1).alias("to_user"), "value")
    return transfer(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), moves, "c_custkey", "c_acctbal", "user_id", "to_user", "value")


def guarded_transfer(accounts: DataFrame, moves: DataFrame, key: str, balance: str) -> DataFrame:
    """Payments of a batch ``source, target, value``; a payer whose balance does not cover all theirs pays none.

    Every move of a refused payer is left out on both sides: one aggregation per payer decides, and
    the legs of what is left are summed per account.
    """
    owed = moves.groupBy("source").agg(F.sum(money("value")).cast("double").alias("__owed"))
    able = owed.join(accounts, F.col("source") == F.col(key)).where(F.col(balance) >= F.col("__owed")).select("source")
    return transfer(accounts, moves.join(able, "source", "left_semi"), key, balance, "source", "target", "value")


def amalgamate(savings: DataFrame, checking: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Moves both balances of each ``source`` into the checking account of its ``target``.

    Balances are in ``balance``; a source appears once.  Returns both balances of every account.
    """
    both = savings.select(key, F.col("balance").alias("savings")).join(checking.select(key, F.col("balance").alias("checking")), key)
    moved = both.join(pairs, F.col(key) == F.col("source")).groupBy("target").agg(F.sum(money("savings") + money("checking")).cast("double").alias("__in"))
    emptied = both.join(pairs.select(F.col("source").alias(key), F.lit(True).alias("__out")), key, "left").join(moved.withColumnRenamed("target", key), key, "left")
    keep = F.col("__out").isNull()
    return emptied.select(key, F.when(keep, F.col("savings")).otherwise(0.0).alias("savings"), (F.when(keep, F.col("checking")).otherwise(0.0) + F.coalesce("__in", F.lit(0.0))).alias("checking"))


def charge_all(accounts: DataFrame, charges: DataFrame, key: str, balance: str) -> DataFrame:
    """A charge over several accounts at once ``charge, key, value``: all are charged or none.

    A charge is refused if one of its accounts does not cover its part.
    """
    parts = charges.join(accounts, key)
    good = parts.groupBy("charge").agg(F.bool_and(F.col(balance) >= F.col("value")).alias("__ok")).where("__ok").select("charge")
    total = charges.join(good, "charge", "left_semi").groupBy(key).agg(F.sum(money("value")).cast("double").alias("__sum"))
    return accounts.join(total, key, "left").select(key, (F.col(balance) - F.coalesce("__sum", F.lit(0.0))).alias(balance))


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")


def bank_send_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("source"), (F.col("user_id") + 1).alias("target"), (F.col("value") * 10).alias("value"))
    return guarded_transfer(_accounts(spark, sf_dir), moves, "c_custkey", "c_acctbal")


def bank_amalgamate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth customer's accounts go to the next customer; savings stand for a tenth of the balance."""
    checking = _accounts(spark, sf_dir).select("c_custkey", F.col("c_acctbal").alias("balance"))
    savings = checking.select("c_custkey", F.floor(F.col("balance") / 10).cast("double").alias("balance"))
    pairs = checking.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("source"), (F.col("c_custkey") + 1).alias("target"))
    return amalgamate(savings, checking, pairs, "c_custkey")


def bank_distributed_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One charge over the customers of each nation and segment, a hundred each."""
    charges = table(spark, sf_dir, "customer").where("c_custkey % 50 < 2").select(F.floor(F.col("c_custkey") / 50).alias("charge"), "c_custkey", F.lit(100.0).alias("value"))
    return charge_all(_accounts(spark, sf_dir), charges, "c_custkey", "c_acctbal")


# --- order entry ----------------------------------------------------------------------------------


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals with tax and discount on each line."""
    line = money((F.col("l_extendedprice").cast("decimal(18,2)") * (1 + F.col("l_tax").cast("decimal(4,2)")) * (1 - F.col("l_discount").cast("decimal(4,2)"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(line).cast("double").alias("total"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-to-date sums per nation and market segment, with totals, in one aggregation."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    per = orders.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("paid"), F.count("*").alias("n"))
    return per.join(customer, F.col("o_custkey") == F.col("c_custkey")).rollup("c_nationkey", "c_mktsegment").agg(F.sum("paid").cast("double").alias("ytd"), F.sum("n").cast("long").alias("payment_cnt"))


def dense_numbers(rows: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Adds ``number``: the place of a row by its key, from 0 on, for unique whole keys.

    Keys are counted per range of ``width``; the few ranges' sums give each range's start, and a row
    adds its place inside its range.  All of it depends on keys alone, so a task that is run again
    gives the same numbers.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(key) / width))
    starts = ranged.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", (F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))).alias("__start"))
    place = F.row_number().over(W.partitionBy("__range").orderBy(key)) - 1
    return ranged.withColumn("__place", place).join(starts, "__range").withColumn("number", F.coalesce("__start", F.lit(0)) + F.col("__place")).drop("__range", "__place", "__start")


def place_orders(orders: DataFrame, items: DataFrame, stock: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New orders of a batch: their heads, their lines, and the stock that is left.

    ``orders`` has ``request`` and a customer, ``items`` has ``request, line, item, quantity``,
    ``stock`` has ``item, price, quantity``, ``last`` the last order number of all.  An order that
    names an item that is not there is rolled back whole.  Stock that would fall below 10 is
    filled up by 91 as often as it takes.
    """
    known = items.join(stock.select("item", "price"), "item", "left")
    bad = known.where("price IS NULL").select("request").distinct()
    good = orders.join(bad, "request", "left_anti")
    heads = dense_numbers(good, "request").join(F.broadcast(last)).select((F.col("last") + 1 + F.col("number")).alias("order_id"), *orders.columns)
    lines = known.join(heads.select("request", "order_id"), "request").select("order_id", "line", "item", "quantity", (money("price") * F.col("quantity")).cast("double").alias("amount"))
    sold = lines.groupBy("item").agg(F.sum("quantity").alias("__sold"), F.count("*").alias("__orders"))
    less = F.col("quantity") - F.coalesce("__sold", F.lit(0))
    filled = F.when(less < 10, less + 91 * F.ceil((10 - less) / 91)).otherwise(less)
    left = stock.join(sold, "item", "left").select("item", F.when(F.col("__sold").isNull(), F.col("quantity")).otherwise(filled).cast("long").alias("quantity"), F.coalesce("__sold", F.lit(0)).cast("long").alias("ytd"), F.coalesce("__orders", F.lit(0)).cast("long").alias("order_cnt"))
    return heads, lines, left


def pay(customers: DataFrame, payments: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Balances after a batch of payments ``key, amount, paid_at``, and the history rows they leave."""
    paid = payments.groupBy(key).agg(F.sum(money("amount")).cast("double").alias("__paid"), F.count("*").alias("__n"))
    after = customers.join(paid, key, "left").select(key, (F.col("balance") - F.coalesce("__paid", F.lit(0.0))).alias("balance"), F.coalesce("__paid", F.lit(0.0)).alias("ytd_payment"), F.coalesce("__n", F.lit(0)).alias("payment_cnt"))
    history = payments.join(customers.select(key), key, "left_semi").select(key, "amount", "paid_at")
    return after, history


def new_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids for new orders of a batch: each customer's follow on from the last one of all."""
    orders = table(spark, sf_dir, "orders")
    buyers = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select("c_custkey")
    last = orders.agg(F.coalesce(F.max("o_orderkey"), F.lit(-1)).alias("last"))
    return dense_numbers(buyers, "c_custkey").join(F.broadcast(last)).select("c_custkey", (F.col("last") + 1 + F.col("number")).alias("o_orderkey"))


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every tenth customer orders three items; some name one that is not there."""
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    requests = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("request"), "c_custkey")
    items = requests.select("request", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("line")).select("request", "line", (F.col("request") * 7 % 1000 + F.col("line") + F.when((F.col("request") % 70 == 0) & (F.col("line") == 2), 1_000_000_000).otherwise(0)).alias("item"), (F.col("request") % 10 + 5 * F.col("line")).alias("quantity"))
    stock = part.select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") * 13 % 91 + 10).alias("quantity"))
    return place_orders(requests, items, stock, orders.agg(F.max("o_orderkey").alias("last")))


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)[0].select("order_id", "c_custkey")


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)[1]


def left_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)[2]


def _paid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    payments_ = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"), F.col("value").alias("amount"), F.col("ts").alias("paid_at"))
    return pay(_accounts(spark, sf_dir).withColumnRenamed("c_acctbal", "balance"), payments_, "c_custkey")


def paid_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paid(spark, sf_dir)[0]


def payment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paid(spark, sf_dir)[1]


def generated_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows of a stock table: quantities and names from each key alone, by any task."""
    return stock_rows(spark, 5000, 4)


def stock_rows(spark: SparkSession, items: int, warehouses: int, seed: int = 17) -> DataFrame:
    ids = spark.range(items * warehouses).select((F.col("id") % items).alias("s_i_id"), F.floor(F.col("id") / items).alias("s_w_id"), ((F.col("id") * 7919 + seed) % 1_000_003).alias("draw"))
    return ids.select("s_i_id", "s_w_id", (F.col("draw") % 91 + 10).alias("s_quantity"), (F.col("draw") % 10).alias("s_s_id"), F.concat(F.lit("item "), F.lpad(F.conv(F.col("draw").cast("string"), 10, 36), 4, "0")).alias("s_data"))


def post_rows(spark: SparkSession, users: int, posts_each: int, seed: int = 23) -> DataFrame:
    """Generated posts: a user's posts are numbered, and some users post far more than others."""
    people = spark.range(users).select(F.col("id").alias("user_id"), (1 + F.floor(F.lit(posts_each * users) / (F.col("id") + users))).cast("int").alias("n"))
    return people.select("user_id", F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("post_id", "k")).select("user_id", F.col("post_id").cast("long").alias("post_id"), ((F.col("user_id") * 131 + F.col("k") * 7 + seed) % 86_400).alias("second"))


def generated_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post_rows(spark, 500, 20)


# --- key-value ------------------------------------------------------------------------------------


def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_partkey").between(10, 500) & (F.col("p_type") <= "MEDIUM")).select("p_partkey", "p_type", "p_name")


def kv_multi_rmw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several keys read, changed and written back at once."""
    keys = [3, 14, 15, 92]
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey").isin(keys), F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))


# --- social graph ---------------------------------------------------------------------------------


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (user, followed)."""
    events = table(spark, sf_dir, "events")
    return events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("followed")).where("followed IS NOT NULL AND followed != user_id").distinct()


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("post_id"), "ts", F.col("event_type").alias("text"))


def post_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post of one user, by both keys: none if the post is another's."""
    return posts(spark, sf_dir).where("user_id = 37 AND post_id = 0").unionByName(posts(spark, sf_dir).where("user_id = 7 AND post_id BETWEEN 0 AND 99")).agg(F.count("*").alias("n_posts"))


def insert_posts(old: DataFrame, new: DataFrame) -> DataFrame:
    """All posts ``user_id, post_id, ts, text``: new ones, numbered after their user's last.

    Of a user's new posts the order is that of their time and text.
    """
    last = old.groupBy("user_id").agg(F.max("post_id").alias("__last"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "text"))
    numbered = new.withColumn("__place", place).join(last, "user_id", "left").select("user_id", (F.coalesce("__last", F.lit(0)) + F.col("__place")).alias("post_id"), "ts", "text")
    return old.unionByName(numbered)


def inserted_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user repeats their errors as new posts."""
    old = posts(spark, sf_dir)
    return insert_posts(old, old.where("text = 'error'").select("user_id", "ts", F.lit("again").alias("text")).distinct())


def most_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty users with most posts, ties by number; a task keeps twenty rows before they meet."""
    return posts(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_posts")).orderBy(F.desc("n_posts"), "user_id").limit(20)


def user_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).where("post_id BETWEEN 100 AND 5000").groupBy("user_id").agg(F.count("*").alias("n_posts"))


def recent_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).where(F.col("ts").between(when_at("2024-01-05"), when_at("2024-01-09"))).agg(F.count("*").alias("n_posts"))


def posts_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).where(between("text", "p", "q")).agg(F.count("*").alias("n_posts"))


def _posts_per(spark: SparkSession, sf_dir: str, via: str, to: str) -> DataFrame:
    # Posts are counted per author first, so that the join carries one row per edge.
    counts = posts(spark, sf_dir).groupBy(F.col("user_id").alias("author")).agg(F.count("*").alias("n"))
    return follows(spark, sf_dir).join(counts, F.col(to) == F.col("author")).groupBy(F.col(via).alias("user_id")).agg(F.sum("n").cast("long").alias("n_posts"))


def posts_of_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts_per(spark, sf_dir, "user_id", "followed")


def posts_of_followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts_per(spark, sf_dir, "followed", "user_id")


def follower_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of those who follow one of some users."""
    chosen = follows(spark, sf_dir).where("followed IN (1, 2, 3)").select("user_id")
    return table(spark, sf_dir, "customer").join(chosen, F.col("c_custkey") == F.col("user_id"), "left_semi").select("c_custkey", "c_name")


def follower_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both counters of every user, from one shuffle of the edges' ends."""
    ends = follows(spark, sf_dir).select(F.explode(F.array(F.struct(F.col("user_id").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("followed").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e"))
    return ends.groupBy(F.col("e.u").alias("user_id")).agg(F.sum("e.out").cast("long").alias("num_following"), F.sum("e.in").cast("long").alias("num_followers"))


QUERIES = {
    "bank_balance": bank_balance, "bank_deposits": bank_deposits, "bank_checks": bank_checks, "bank_payments": bank_payments, "bank_amalgamate": bank_amalgamate, "order_totals": order_totals, "payment_totals": payments, "new_order_ids": new_orders, "kv_scan": kv_scan, "kv_multi_rmw": kv_multi_rmw,
    "bank_send_payment": bank_send_payment, "bank_distributed_charge": bank_distributed_charge, "placed_orders": placed_orders, "placed_lines": placed_lines, "left_stock": left_stock, "paid_balances": paid_balances, "payment_history": payment_history, "generated_stock": generated_stock, "generated_posts": generated_posts,
    "social_insert_posts": inserted_posts, "social_most_active": most_active, "social_post_lookup": post_lookup, "social_user_posts": user_posts, "social_recent_posts": recent_posts, "social_posts_like": posts_like, "social_posts_of_followed": posts_of_followed, "social_posts_of_followers": posts_of_followers, "social_follower_profiles": follower_profiles, "social_follower_counters": follower_counters,
}

_SUM = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
_EDGES = "(SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS followed FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) != user_id)"
_PLACED = """WITH r AS (SELECT c_custkey AS request FROM customer WHERE c_custkey % 10 = 0),
i AS (SELECT request, line, request * 7 % 1000 + line + CASE WHEN request % 70 = 0 AND line = 2 THEN 1000000000 ELSE 0 END AS item, request % 10 + 5 * line AS quantity FROM r, (VALUES (1), (2), (3)) v(line)),
p AS (SELECT p_partkey AS item, p_retailprice AS price, p_partkey * 13 % 91 + 10 AS quantity FROM part),
h AS (SELECT request, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY request) AS order_id FROM r WHERE request NOT IN (SELECT request FROM i WHERE item NOT IN (SELECT item FROM p))),
l AS (SELECT order_id, line, i.item, i.quantity, CAST(CAST(price AS DECIMAL(18,2)) * i.quantity AS DOUBLE) AS amount FROM i JOIN h ON h.request = i.request JOIN p ON p.item = i.item)"""
ORACLE_SQL = {
    "bank_balance": f"SELECT c_custkey, c_acctbal + coalesce(h, 0) AS balance FROM customer LEFT JOIN (SELECT o_custkey, {_SUM.format('o_totalprice')} AS h FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) ON o_custkey = c_custkey",
    "bank_deposits": f"SELECT c_custkey, c_acctbal + coalesce(h, 0) AS c_acctbal FROM customer LEFT JOIN (SELECT user_id, {_SUM.format('value')} AS h FROM events WHERE event_type = 'purchase' GROUP BY user_id) ON user_id = c_custkey",
    "bank_checks": f"SELECT c_custkey, CASE WHEN h IS NULL THEN c_acctbal WHEN c_acctbal + h >= 0 THEN c_acctbal + h ELSE c_acctbal END AS c_acctbal, h IS NULL OR c_acctbal + h >= 0 AS applied FROM customer LEFT JOIN (SELECT o_custkey, {_SUM.format('-o_totalprice / 100')} AS h FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) ON o_custkey = c_custkey",
    "bank_payments": f"WITH m AS (SELECT user_id, value FROM events WHERE event_type = 'purchase'), d AS (SELECT user_id AS k, -value AS v FROM m UNION ALL SELECT user_id + 1, value FROM m) SELECT c_custkey, c_acctbal + coalesce(h, 0) AS c_acctbal FROM customer LEFT JOIN (SELECT k, {_SUM.format('v')} AS h FROM d GROUP BY k) ON k = c_custkey",
    "bank_amalgamate": "WITH b AS (SELECT c_custkey AS k, floor(c_acctbal / 10) AS s, c_acctbal AS c FROM customer) SELECT b.k AS c_custkey, CASE WHEN b.k % 10 = 0 THEN 0.0 ELSE b.s END AS savings, CASE WHEN b.k % 10 = 0 THEN 0.0 ELSE b.c END + coalesce(CAST(CAST(p.s AS DECIMAL(18,2)) + CAST(p.c AS DECIMAL(18,2)) AS DOUBLE), 0) AS checking FROM b LEFT JOIN b p ON p.k % 10 = 0 AND p.k + 1 = b.k",
    "bank_send_payment": f"WITH m AS (SELECT user_id AS s, user_id + 1 AS t, value * 10 AS v FROM events WHERE event_type = 'purchase'), o AS (SELECT s, {_SUM.format('v')} AS owed FROM m GROUP BY s), g AS (SELECT m.* FROM m JOIN o ON o.s = m.s JOIN customer ON c_custkey = m.s WHERE c_acctbal >= owed), d AS (SELECT s AS k, -v AS v FROM g UNION ALL SELECT t, v FROM g) SELECT c_custkey, c_acctbal + coalesce(h, 0) AS c_acctbal FROM customer LEFT JOIN (SELECT k, {_SUM.format('v')} AS h FROM d GROUP BY k) ON k = c_custkey",
    "bank_distributed_charge": "WITH p AS (SELECT c_custkey // 50 AS charge, c_custkey AS k, c_acctbal >= 100 AS ok FROM customer WHERE c_custkey % 50 < 2), g AS (SELECT charge FROM p GROUP BY charge HAVING bool_and(ok)) SELECT c_custkey, c_acctbal - CASE WHEN c_custkey % 50 < 2 AND c_custkey // 50 IN (SELECT charge FROM g) THEN 100.0 ELSE 0.0 END AS c_acctbal FROM customer",
    "placed_orders": f"{_PLACED} SELECT order_id, request AS c_custkey FROM h",
    "placed_lines": f"{_PLACED} SELECT order_id, line, item, quantity, amount FROM l",
    "left_stock": f"{_PLACED}, s AS (SELECT item, CAST(sum(quantity) AS BIGINT) AS sold, count(*) AS n FROM l GROUP BY item), x AS (SELECT p.item, p.quantity AS q, p.quantity - coalesce(sold, 0) AS less, sold, n FROM p LEFT JOIN s ON s.item = p.item) SELECT item, CAST(CASE WHEN sold IS NULL THEN q WHEN less < 10 THEN less + 91 * ceil((10 - less) / 91.0) ELSE less END AS BIGINT) AS quantity, coalesce(sold, 0) AS ytd, coalesce(n, 0) AS order_cnt FROM x",
    "paid_balances": f"SELECT c_custkey, c_acctbal - coalesce(h, 0) AS balance, coalesce(h, 0.0) AS ytd_payment, coalesce(n, 0) AS payment_cnt FROM customer LEFT JOIN (SELECT user_id, {_SUM.format('value')} AS h, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id) ON user_id = c_custkey",
    "payment_history": "SELECT user_id AS c_custkey, value AS amount, ts AS paid_at FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT c_custkey FROM customer)",
    "generated_stock": "WITH d AS (SELECT i % 5000 AS s_i_id, i // 5000 AS s_w_id, (i * 7919 + 17) % 1000003 AS d FROM (SELECT unnest(range(20000)) AS i)) SELECT s_i_id, s_w_id, d % 91 + 10 AS s_quantity, d % 10 AS s_s_id, 'item ' || lpad(to_base(d, 36), 4, '0') AS s_data FROM d",
    "generated_posts": "WITH u AS (SELECT i AS user_id, 1 + 10000 // (i + 500) AS n FROM (SELECT unnest(range(500)) AS i)), p AS (SELECT user_id, unnest(range(n)) AS post_id FROM u) SELECT user_id, post_id, (user_id * 131 + (post_id + 1) * 7 + 23) % 86400 AS second FROM p",
    "social_insert_posts": "WITH n AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error') SELECT user_id, event_id AS post_id, ts, event_type AS text FROM events UNION ALL SELECT n.user_id, (SELECT max(event_id) FROM events e WHERE e.user_id = n.user_id) + row_number() OVER (PARTITION BY n.user_id ORDER BY n.ts), n.ts, 'again' FROM n",
    "social_most_active": "SELECT user_id, count(*) AS n_posts FROM events GROUP BY user_id ORDER BY n_posts DESC, user_id LIMIT 20",
    "order_totals": "SELECT l_orderkey, CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 + CAST(l_tax AS DECIMAL(4,2))) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY l_orderkey",
    "payment_totals": f"SELECT c_nationkey, c_mktsegment, {_SUM.format('o_totalprice')} AS ytd, count(*) AS payment_cnt FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_nationkey, c_mktsegment)",
    "new_order_ids": "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS o_orderkey FROM customer WHERE c_custkey % 10 = 0",
    "kv_scan": "SELECT p_partkey, p_type, p_name FROM part WHERE p_partkey BETWEEN 10 AND 500 AND p_type <= 'MEDIUM'",
    "kv_multi_rmw": "SELECT p_partkey, CASE WHEN p_partkey IN (3, 14, 15, 92) THEN p_size + 1 ELSE p_size END AS p_size FROM part",
    "social_post_lookup": "SELECT count(*) AS n_posts FROM events WHERE (user_id = 37 AND event_id = 0) OR (user_id = 7 AND event_id BETWEEN 0 AND 99)",
    "social_user_posts": "SELECT user_id, count(*) AS n_posts FROM events WHERE event_id BETWEEN 100 AND 5000 GROUP BY user_id",
    "social_recent_posts": "SELECT count(*) AS n_posts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'",
    "social_posts_like": "SELECT count(*) AS n_posts FROM events WHERE event_type LIKE 'p%'",
    "social_posts_of_followed": f"SELECT f.user_id, count(*) AS n_posts FROM {_EDGES} f JOIN events e ON e.user_id = f.followed GROUP BY f.user_id",
    "social_posts_of_followers": f"SELECT f.followed AS user_id, count(*) AS n_posts FROM {_EDGES} f JOIN events e ON e.user_id = f.user_id GROUP BY f.followed",
    "social_follower_profiles": f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM {_EDGES} WHERE followed IN (1, 2, 3))",
    "social_follower_counters": f"WITH f AS {_EDGES} SELECT u AS user_id, CAST(sum(o) AS BIGINT) AS num_following, CAST(sum(i) AS BIGINT) AS num_followers FROM (SELECT user_id AS u, 1 AS o, 0 AS i FROM f UNION ALL SELECT followed, 0, 1 FROM f) GROUP BY u",
}
