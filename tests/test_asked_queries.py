"""What a user's SELECT may and may not see."""

import pytest

from tidegauge.operators import query


@pytest.fixture(scope="module")
def orders(spark):
    spark.createDataFrame([(7,), (99,)], "id int").createOrReplaceTempView("secret")
    spark.createDataFrame([("mine",)], "s string").createOrReplaceTempView("orders")
    return spark.createDataFrame([(1, "open", 2.0), (2, "done", 3.0), (3, "status", 4.0)], "id int, status string, price double")


REFUSED = [
    """SELECT "'" AS a, (SELECT max(id) FROM secret) AS b, "'" AS c FROM orders""",
    "SELECT 1 AS a /* ' */, (SELECT max(id) FROM secret) AS b /* ' */ FROM orders",
    "SELECT s.id FROM secret s JOIN (WITH secret AS (SELECT 1 AS id) SELECT id FROM secret) t ON true",
    "SELECT * FROM secret",
    "SELECT '== Analyzed', (SELECT max(id) FROM secret) FROM orders",
    "SELECT * FROM orders WHERE id IN (SELECT id FROM secret)",
    "SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM secret WHERE secret.id > orders.id)",
    "WITH a AS (SELECT * FROM secret) SELECT * FROM a",
    "WITH a AS (WITH secret AS (SELECT 1 AS id) SELECT * FROM secret) SELECT * FROM a, secret",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
    "SELECT id FROM orders UNION ALL SELECT id FROM secret",
    "SELECT * FROM orders, LATERAL (SELECT id AS other FROM secret)",
    "SELECT * FROM default.orders",
    "SELECT * FROM parquet.`/tmp/x`",
    "SELECT * FROM range(10)",
    "SELECT * FROM IDENTIFIER('sec' || 'ret')",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM orders",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM orders",
    "SELECT id FROM orders ORDER BY (SELECT max(id) FROM secret)",
    "SELECT CASE WHEN true THEN (SELECT first(id) FROM secret) END FROM orders",
    "SELECT no_such_function(id) FROM orders",
    "DROP VIEW secret",
    "INSERT INTO secret SELECT 1",
    "SELECT 1; SELECT 2",
    "SELECT 1) UNION ALL SELECT * FROM (SELECT id FROM orders",
    "TABLE secret",
    "SELECT TRANSFORM(id) USING 'cat' FROM orders",
    "",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(orders, sql):
    with pytest.raises(query.QueryRefused):
        query.ask(orders, "orders", sql).collect()


ADMITTED = [
    ("SELECT * FROM orders WHERE status = 'status'", 1),
    ("SELECT id FROM orders WHERE status <> 'secret' -- FROM secret", 3),
    ("SELECT 'UnresolvedRelation [secret]' AS t FROM ORDERS", 3),
    ("WITH secret AS (SELECT id FROM orders) SELECT * FROM secret", 3),
    ("WITH a AS (SELECT id FROM orders), b AS (SELECT * FROM a WHERE id > 1) SELECT * FROM a JOIN b USING (id)", 2),
    ("SELECT status, sum(price) OVER (ORDER BY id) AS s, upper(status) AS u FROM orders o ORDER BY s DESC LIMIT 2;", 2),
    ("SELECT id FROM orders WHERE price > (SELECT avg(price) FROM orders)", 1),
    ("SELECT o.id, x FROM orders o LATERAL VIEW explode(array(1, 2)) t AS x", 6),
    ("SELECT * FROM (VALUES (1), (2)) v(i) JOIN orders ON i = id", 2),
    ("SELECT status, count(*) AS n FROM orders GROUP BY status HAVING count(*) > 0", 3),
    ("SELECT id FROM orders EXCEPT SELECT 1", 2),
    ("SELECT EXISTS (SELECT 1 FROM orders p WHERE p.id > o.id) AS later FROM orders o", 3),
]


@pytest.mark.parametrize("sql,n", ADMITTED)
def test_admitted(orders, sql, n):
    assert len(query.ask(orders, "orders", sql).collect()) == n


def test_the_callers_view_stays(spark, orders):
    query.ask(orders, "orders", "SELECT * FROM orders").collect()
    assert [r.s for r in spark.table("orders").collect()] == ["mine"]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("asked_")]


def test_cap_holds_over_the_texts_own_limit(orders):
    assert len(query.ask(orders, "orders", "SELECT * FROM orders LIMIT 3", cap=1).collect()) == 2
    answered = query.answer(orders, "orders", "SELECT * FROM orders", cap=2)
    assert answered.truncated and answered.rows.count() == 2
