"""Null cells, repeated and missing keys."""

from brindle.functions.predicates import Chain, Compare
from brindle.operators import changes, statistics, workloads


def test_chains_over_null_cells(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, 5), (3, 5, 5), (4, None, None), (5, 1, 1)], "id int, a int, b int")
    five = [Compare("a", "=", 5), Compare("b", "=", 5)]
    ids = lambda c: {r.id for r in df.where(c).collect()}
    for chain, expect in ((Chain(five), {3}), (Chain([], five), {1, 2, 3}), (Chain(five[:1], five[1:]), {3}), (Chain(five[:1], five[1:], False), {1, 2, 3}), (Chain([Compare("a", "!=", 5)]), {5})):
        assert ids(chain.build()) == expect
        assert ids(~chain.build()) == {1, 2, 3, 4, 5} - expect


def test_repeated_and_missing_keys(spark):
    old = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k long, v double")
    new = spark.createDataFrame([(1, 11.0, 1), (3, 30.0, 1), (3, 31.0, 2), (None, 5.0, 1)], "k long, v double, n int")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert rows(changes.insert(old, new.drop("n"), "k")) == [(1, 10.0), (2, 20.0), (3, 31.0)]
    assert rows(changes.upsert(old, new.drop("n"), "k")) == [(1, 11.0), (2, 20.0), (3, 31.0)]
    cells = spark.createDataFrame([(2, 9.0, 1), (2, 3.0, 2), (7, 1.0, 1), (None, 1.0, 9)], "k long, v double, n int")
    assert rows(changes.update(old, cells, "k", "v", "n")) == [(1, 10.0), (2, 3.0)]


def test_orders_with_a_missing_item_are_rolled_back(spark):
    orders = spark.createDataFrame([(5, "a"), (6, "b"), (9000, "c")], "request long, customer string")
    items = spark.createDataFrame([(5, 1, 1, 3), (6, 1, 1, 100), (6, 2, 77, 1), (9000, 1, 2, 95)], "request long, line int, item long, quantity long")
    stock = spark.createDataFrame([(1, 2.5, 20), (2, 1.0, 50), (3, 1.0, 1)], "item long, price double, quantity long")
    heads, lines, left = workloads.place_orders(orders, items, stock, spark.createDataFrame([(99,)], "last long"))
    assert {(r.order_id, r.request) for r in heads.collect()} == {(100, 5), (101, 9000)}
    assert {(r.order_id, r.item, r.amount) for r in lines.collect()} == {(100, 1, 7.5), (101, 2, 95.0)}
    assert {(r.item, r.quantity, r.order_cnt) for r in left.collect()} == {(1, 17, 1), (2, 46, 1), (3, 1, 0)}


def test_uncovered_payments_and_charges_are_refused(spark):
    accounts = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 0.0)], "k long, b double")
    moves = spark.createDataFrame([(1, 2, 4.0), (1, 3, 6.0), (2, 3, 5.5)], "source long, target long, value double")
    assert {(r.k, r.b) for r in workloads.guarded_transfer(accounts, moves, "k", "b").collect()} == {(1, 0.0), (2, 9.0), (3, 6.0)}
    charges = spark.createDataFrame([(1, 1, 3.0), (1, 2, 3.0), (2, 1, 1.0), (2, 3, 1.0)], "charge long, k long, value double")
    assert {(r.k, r.b) for r in workloads.charge_all(accounts, charges, "k", "b").collect()} == {(1, 7.0), (2, 2.0), (3, 0.0)}


def test_selectivity_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a int")
    assert statistics.selectivities(empty, {"x": Chain([Compare("a", "=", 1)])}).first().selectivity is None
