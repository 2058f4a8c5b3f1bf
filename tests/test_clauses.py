"""QUALIFY, ASOF JOIN and * EXCLUDE, against a second engine and against the guard."""

import duckdb
import pytest

from medloom.plans.clauses import ClauseError, as_of_joins, exclude, qualify
from medloom.plans.service import QueryService


@pytest.fixture(scope="module")
def tables(spark):
    people = spark.range(60).selectExpr("concat('p', id) AS record_id", "IF(id < 55, 'F', 'M') AS sex", "id AS age", "CAST(id % 3 AS STRING) AS site")
    visits = spark.range(200).selectExpr("concat('p', id % 60) AS record_id", "id AS day", "CAST(id AS DOUBLE) AS cost")
    labs = spark.range(150).selectExpr("concat('p', id % 50) AS record_id", "IF(id % 9 = 0, NULL, id) AS taken", "IF(id % 2 = 0, 'low', 'high') AS level")
    return {"people": people, "visits": visits, "labs": labs}


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows.toPandas())
    return con


@pytest.fixture(scope="module")
def service(spark, tables):
    return QueryService(spark, tables, max_rows=200)


def text(rows):
    return sorted(tuple("null" if v is None or v != v else str(float(v) if isinstance(v, (int, float)) else v) for v in r) for r in rows)


@pytest.mark.parametrize("sql", [
    "SELECT site, sex, COUNT(*) AS n FROM people GROUP BY site, sex QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, sex) = 1",
    "SELECT site, COUNT(*) FROM people GROUP BY site QUALIFY rank() OVER (ORDER BY MAX(age)) <= 2 ORDER BY site LIMIT 1",
    "SELECT DISTINCT sex, MAX(age) top FROM people WHERE sex = 'F' GROUP BY sex, site QUALIFY rank() OVER (ORDER BY MAX(age)) <= 2 AND top > 50 AND 'QUALIFY' <> 'x'",
    "WITH q AS (SELECT site, MAX(age) AS a FROM people WHERE sex = 'F' GROUP BY site QUALIFY dense_rank() OVER (ORDER BY MAX(age) DESC) = 1) SELECT a, COUNT(*) AS n FROM (SELECT q.a FROM q JOIN people p ON p.site = q.site) GROUP BY a",
    "SELECT site, COUNT(*) AS n FROM people GROUP BY site QUALIFY site = '1' AND row_number() OVER (ORDER BY site) = 2 UNION ALL SELECT sex, COUNT(*) AS n FROM people WHERE sex = 'F' GROUP BY sex QUALIFY COUNT(*) > 1 AND row_number() OVER (ORDER BY sex) = 1",
    "SELECT l.level, COUNT(*) AS n, MAX(v.day - l.taken) AS far FROM visits v ASOF JOIN labs l ON v.record_id = l.record_id AND v.day >= l.taken GROUP BY l.level",
    "SELECT level, COUNT(*) AS n, MAX(taken) AS met FROM visits AS v ASOF LEFT JOIN labs AS l ON l.taken <= v.day AND l.record_id = v.record_id WHERE cost > 3 GROUP BY level ORDER BY n",
    "SELECT visits.cost > 100 AS dear, SUM(labs.taken) AS t FROM visits ASOF JOIN labs ON visits.record_id = labs.record_id AND visits.day >= labs.taken GROUP BY 1 QUALIFY COUNT(*) > 3 AND row_number() OVER (ORDER BY MAX(visits.cost)) <= 2",
    "SELECT site, COUNT(*) AS n FROM (SELECT p.* EXCLUDE (age) FROM people p) GROUP BY site",
    "SELECT sex, SUM(a) AS s FROM (SELECT * EXCLUDE site, age AS a FROM people WHERE sex = 'F') GROUP BY sex",
])
def test_same_as_the_second_engine(service, duck, sql):
    found = service.execute(sql)
    assert "error" not in found, found
    assert text(found["rows"]) == text(duck.sql(sql).fetchall())


@pytest.mark.parametrize("sql, rows", [
    ("SELECT sex, MAX(age) AS a FROM people GROUP BY sex QUALIFY COUNT(*) = 5", []),
    ("SELECT sex, COUNT(*) AS n FROM people GROUP BY sex QUALIFY sex = 'M'", [["M", "<10"]]),
    ("SELECT sex, COUNT(*) AS n FROM people GROUP BY sex QUALIFY SUM(COUNT(*)) OVER () = 60", []),
    ("SELECT p.sex, COUNT(*) AS n, MAX(v.cost) AS c FROM people p ASOF JOIN visits v ON p.record_id = v.record_id AND p.age >= v.day WHERE p.sex = 'M' GROUP BY p.sex", [["M", "<10", None]]),
    # more rows than persons
    ("SELECT sex, COUNT(*) AS n FROM (SELECT p.* EXCLUDE (record_id), v.cost FROM people p JOIN visits v ON p.record_id = v.record_id) WHERE sex = 'M' GROUP BY sex", [["M", "<10"]]),
])
def test_small_groups_stay_hidden(service, sql, rows):
    found = service.execute(sql)
    assert found.get("rows") == rows, found


@pytest.mark.parametrize("sql", [
    "SELECT l.record_id, COUNT(*) AS n FROM visits v ASOF JOIN labs l ON v.record_id = l.record_id AND v.day >= l.taken GROUP BY l.record_id",
    "SELECT l.level, COUNT(*) AS n FROM visits v ASOF JOIN labs l ON v.cost = l.taken AND v.day >= l.taken GROUP BY l.level",
    "SELECT COUNT(*) AS n FROM visits v ASOF JOIN labs l ON v.day >= l.taken",
    "SELECT COUNT(*) AS n FROM visits v ASOF JOIN labs l ON v.record_id = l.record_id",
    "SELECT COUNT(*) AS n FROM visits v ASOF JOIN labs l ON v.record_id = l.record_id AND v.day > l.taken",
    "SELECT COUNT(*) AS n FROM visits v ASOF JOIN labs l ON upper(v.record_id) = l.record_id AND v.day >= l.taken",
    "SELECT COUNT(*) AS n FROM visits v ASOF JOIN secret l ON v.record_id = l.record_id AND v.day >= l.taken",
    "SELECT COUNT(*) AS n FROM (SELECT 1 AS x) v ASOF JOIN labs l ON v.x = l.taken AND v.x >= l.taken",
    "SELECT COUNT(l.nothing) AS n FROM visits v ASOF JOIN labs l ON v.record_id = l.record_id AND v.day >= l.taken",
    "SELECT COUNT(*) AS n FROM visits v ASOF JOIN",
    "SELECT sex, age FROM people QUALIFY row_number() OVER (ORDER BY age) = 1",
    "SELECT * EXCLUDE (record_id) FROM people QUALIFY TRUE",
    "SELECT record_id, COUNT(*) AS n FROM people GROUP BY record_id QUALIFY TRUE",
])
def test_refused(service, spark, sql):
    found = service.execute(sql)
    assert "error" in found, found
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("asof_")]


def test_tokens_keep_the_rest():
    for sql in ("SELECT 'a QUALIFY b' AS x -- QUALIFY\n FROM t", "SELECT t.qualify FROM t", "SELECT exclude FROM t"):
        assert qualify(sql) == sql and exclude(sql) == sql
    assert as_of_joins("SELECT asof FROM t", {}, "x") == ("SELECT asof FROM t", [])
    with pytest.raises(ClauseError):
        qualify("QUALIFY x")


def test_ties_and_nulls(spark, tables):
    sql, (join,) = as_of_joins("SELECT 1 FROM a ASOF LEFT JOIN b USING (k, t)", {"a": ["k", "t"], "b": ["k", "t", "v"]}, "j")
    assert sql == "SELECT 1 FROM j0 AS `a`"
    left = spark.createDataFrame([(1, 5), (1, None), (None, 5), (2, 0), (1, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, None, "no"), (None, 1, "no"), (2, 1, "late")], "k int, t int, v string")
    assert text(tuple(r) for r in join.frame(left, right).collect()) == text([(1, 5, 1, 5, "x"), (1, 5, 1, 5, "x"), (1, None, None, None, None), (None, 5, None, None, None), (2, 0, None, None, None)])
    assert join.frame(left.limit(0), right).count() == 0
