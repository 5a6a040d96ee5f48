"""The dialect end to end, by rows, plans and errors."""

import random
from datetime import datetime

import pytest

from tidemill import Catalog, EngineError, execute, explain, sql
from tidemill.plans.nodes import HashJoin, NestedLoopJoin, Scan
from tidemill.plans.syntax import Ref, parse

STAR = "SELECT f.id, d.label FROM f JOIN d ON f.dim_id = d.id JOIN t ON f.tiny_id = t.id WHERE t.id = 1"


def rows(catalog, text, **options):
    return execute(catalog, text, **options)[0]


def test_filter_and_project(shop):
    assert sorted(rows(shop, "SELECT region FROM orders WHERE year = 2024")) == [("east",), ("north",), ("west",)]
    got, scope = execute(shop, "SELECT * FROM orders")
    assert scope.names() == ["orders.id", "orders.region", "orders.year"] and len(got) == 4
    assert execute(shop, "SELECT o.region, id AS n, 1, 'x' FROM orders o")[1].names() == ["o.region", "n", "1", "'x'"]


@pytest.mark.parametrize("op,n", [("=", 1), ("!=", 3), ("<", 1), (">", 2), ("<=", 2), (">=", 3)])
def test_comparisons(shop, op, n):
    assert len(rows(shop, f"SELECT id FROM orders WHERE id {op} 2")) == n


def test_join_one_to_many_and_null_keys(shop):
    text = "SELECT o.id, l.sku, l.revenue FROM orders o JOIN lineitem l ON o.id = l.order_id"
    assert sorted(rows(shop, text + " WHERE o.id = 1")) == [(1, "gadget", 5), (1, "widget", 10)]
    assert rows(shop, text + " WHERE l.sku = 'orphan'") == []
    assert rows(shop, text + " WHERE o.year = 1999") == []
    assert len(rows(shop, "SELECT o.id FROM orders o INNER JOIN lineitem l ON l.order_id = o.id")) == 6


def test_join_keys_by_side(shop):
    assert len(rows(shop, "SELECT sku FROM orders JOIN lineitem ON (id = order_id)")) == 6
    assert len(rows(shop, "SELECT a.id FROM orders a JOIN orders b ON id = id")) == 4
    assert len(rows(shop, "SELECT l.sku FROM orders o JOIN lineitem l ON o.id = 1")) == 7
    with pytest.raises(EngineError, match="JOIN keys must each belong to one side"):
        rows(shop, "SELECT o.id FROM orders o JOIN lineitem l ON o.id = o.year")


def test_self_join(shop):
    text = "SELECT a.id, b.id FROM orders a JOIN orders b ON a.region = b.region WHERE a.id < b.id"
    assert rows(shop, text) == [(1, 3)]


def test_aggregates(shop):
    text = "SELECT o.region, SUM(l.revenue) AS total FROM orders o JOIN lineitem l ON o.id = l.order_id WHERE o.year = 2024 GROUP BY o.region"
    assert dict(rows(shop, text)) == {"west": 15, "east": 20, "north": 10}
    assert rows(shop, text + " ORDER BY total DESC LIMIT 1") == [("east", 20)]
    got, scope = execute(shop, "SELECT COUNT(*), COUNT(order_id), SUM(revenue), MIN(revenue), MAX(revenue), AVG(revenue) FROM lineitem")
    assert got == [(7, 6, 146, 1, 100, 146 / 7)]
    assert scope.names()[:3] == ["COUNT(*)", "COUNT(order_id)", "SUM(revenue)"]
    assert rows(shop, "SELECT COUNT(*), SUM(id), AVG(id) FROM orders WHERE id < 0") == [(0, None, None)]
    assert rows(shop, "SELECT region, COUNT(*) FROM orders WHERE id < 0 GROUP BY region") == []
    assert sorted(rows(shop, "SELECT year FROM orders GROUP BY year, region")) == [(2023,), (2024,), (2024,), (2024,)]
    assert rows(shop, "SELECT COUNT(*) AS n FROM orders GROUP BY 1") == [(4,)]
    assert rows(shop, "SELECT SUM((year = 2024)) AS n, COUNT((year = 1)) AS m, MAX((id = 1)) AS b FROM orders") == [(3, 4, True)]
    assert sql(shop, "SELECT SUM(revenue) AS s FROM lineitem", exact_sums=True).collect()[0].s == 146


def test_aggregate_errors(shop):
    for text in ("SELECT region, COUNT(*) FROM orders", "SELECT region FROM orders o GROUP BY o.region", "SELECT id, region FROM orders GROUP BY region"):
        with pytest.raises(EngineError, match="must appear in GROUP BY or an aggregate"):
            rows(shop, text)
    with pytest.raises(EngineError, match="SELECT \\* cannot be mixed"):
        rows(shop, "SELECT * FROM orders GROUP BY id")
    with pytest.raises(EngineError, match="SELECT DISTINCT cannot be mixed"):
        rows(shop, "SELECT DISTINCT region, COUNT(*) FROM orders GROUP BY region")
    for text in ("SELECT SUM(id), SUM(id) FROM orders", "SELECT region, COUNT(*) AS region FROM orders GROUP BY region"):
        with pytest.raises(EngineError, match="ambiguous column"):
            rows(shop, text)
    with pytest.raises(EngineError, match="SUM needs numbers"):
        rows(shop, "SELECT SUM(region) FROM orders")


def test_distinct_order_limit(shop):
    assert rows(shop, "SELECT DISTINCT year FROM orders ORDER BY year") == [(2023,), (2024,)]
    assert rows(shop, "SELECT id FROM orders ORDER BY year DESC, id DESC") == [(4,), (2,), (1,), (3,)]
    assert rows(shop, "SELECT id FROM orders LIMIT 2") == [(1,), (2,)]
    assert rows(shop, "SELECT region FROM orders ORDER BY year, id LIMIT 2") == [("west",), ("west",)]
    assert rows(shop, "SELECT id FROM orders LIMIT 0") == []
    assert rows(shop, "SELECT id FROM orders ORDER BY 1, id DESC LIMIT 1") == [(4,)]  # 1 is a constant, not a position
    assert len(rows(shop, "SELECT DISTINCT * FROM orders")) == 4
    assert rows(shop, "SELECT id, id FROM orders ORDER BY id LIMIT 1") == [(1, 1)]


def test_order_scope(shop):
    with pytest.raises(EngineError, match="unknown column r"):
        rows(shop, "SELECT region AS r FROM orders ORDER BY r")
    assert rows(shop, "SELECT DISTINCT region AS r FROM orders ORDER BY r LIMIT 1") == [("east",)]
    with pytest.raises(EngineError, match="unknown column year"):
        rows(shop, "SELECT DISTINCT region FROM orders ORDER BY year")
    text = "SELECT o.region, COUNT(*) AS n FROM orders o GROUP BY o.region ORDER BY "
    assert rows(shop, text + "o.region LIMIT 1") == [("east", 1)]
    with pytest.raises(EngineError, match="unknown column region"):
        rows(shop, text + "region")


@pytest.fixture()
def nulls(spark):
    catalog = Catalog(spark)
    catalog.register("n", "k BIGINT, g STRING, v DOUBLE", [(1, "a", 1.5), (None, "a", None), (2, None, 2.5), (None, None, None), (3, "b", 0.0)])
    return catalog


def test_two_valued_logic(nulls):
    count = lambda where: len(rows(nulls, f"SELECT k FROM n WHERE {where}"))
    assert count("k = 1") == 1 and count("NOT k = 1") == 4
    assert count("NOT NOT k = 1") == 1
    assert count("NOT (k = 1 OR g = 'a')") == 3
    assert count("NOT (k = 1 AND g = 'a')") == 4
    assert count("k != 1") == 2 and count("NOT k != 1") == 3
    assert count("v") == 2 and count("NOT v") == 3 and count("g") == 3
    assert rows(nulls, "SELECT (k = 1) AS b FROM n ORDER BY k LIMIT 5") == [(True,), (False,), (False,), (False,), (False,)]
    assert count("(k = 1) = (g = 'a')") == 4


def test_not_reaches_the_reader(spark, tmp_path):
    catalog = Catalog(spark)
    spark.range(10).selectExpr("id", "id % 3 AS k").write.parquet(str(tmp_path / "t"))
    catalog.load_parquet("t", tmp_path / "t")
    plan = sql(catalog, "SELECT id FROM t WHERE NOT k = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(Not(EqualTo" in plan
    plan = sql(catalog, "SELECT id FROM t WHERE k = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,1)" in plan


def test_random_logic_agrees_with_python(nulls):
    """Conditions of every shape over NULLs, against the rule itself."""
    data = rows(nulls, "SELECT k, g, v FROM n")
    rng = random.Random(5)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            name, const = rng.choice([("k", "1"), ("k", "2"), ("g", "'a'"), ("v", "1.5"), ("v", "0")])
            op = rng.choice(["=", "!=", "<", ">", "<=", ">="])
            pos, lit = {"k": 0, "g": 1, "v": 2}[name], eval(const)
            py = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__"}[op]
            as_kind = float if name == "v" else type(lit)
            return f"{name} {op} {const}", lambda r: r[pos] is not None and getattr(r[pos], py)(as_kind(lit))
        a, fa = make(depth - 1)
        kind = rng.choice(["AND", "OR", "NOT"])
        if kind == "NOT":
            return f"NOT ({a})", lambda r: not fa(r)
        b, fb = make(depth - 1)
        return f"({a}) {kind} ({b})", (lambda r: fa(r) and fb(r)) if kind == "AND" else (lambda r: fa(r) or fb(r))

    for _ in range(25):
        text, f = make(3)
        assert sorted(map(str, rows(nulls, f"SELECT k, g, v FROM n WHERE {text}"))) == sorted(str(r) for r in data if f(r)), text


def test_nulls_in_order_groups_and_joins(nulls):
    assert [r[0] for r in rows(nulls, "SELECT k FROM n ORDER BY k")] == [1, 2, 3, None, None]
    assert [r[0] for r in rows(nulls, "SELECT k FROM n ORDER BY k DESC")] == [3, 2, 1, None, None]
    assert rows(nulls, "SELECT k FROM n ORDER BY k DESC LIMIT 4")[-1] == (None,)
    assert rows(nulls, "SELECT g, COUNT(*) AS n, SUM(v) AS s FROM n GROUP BY g ORDER BY g") == [("a", 2, 1.5), ("b", 1, 0.0), (None, 2, 2.5)]
    assert len(rows(nulls, "SELECT DISTINCT g FROM n")) == 3
    assert len(rows(nulls, "SELECT a.k FROM n a JOIN n b ON a.k = b.k")) == 3
    assert rows(nulls, "SELECT SUM(v) AS s, MIN(v) AS lo, AVG(v) AS a, COUNT(v) AS n FROM n WHERE NOT v") == [(0.0, 0.0, 0.0, 1)]


def test_types_that_differ(nulls):
    assert rows(nulls, "SELECT k FROM n WHERE g = 1") == []
    assert len(rows(nulls, "SELECT k FROM n WHERE g != 1")) == 3
    assert len(rows(nulls, "SELECT k FROM n WHERE NOT g = 1")) == 5
    assert len(rows(nulls, "SELECT k FROM n WHERE (k = 1) = 1")) == 1
    for where in ("g < 1", "NOT g < 1", "v >= 'x'"):
        with pytest.raises(EngineError, match="can't order"):
            rows(nulls, f"SELECT k FROM n WHERE {where}")
    assert rows(nulls, "SELECT k FROM n WHERE k = 1.0") == [(1,)]
    assert rows(nulls, "SELECT a.k FROM n a JOIN n b ON a.k = b.g") == []


@pytest.mark.parametrize(
    "text,message",
    [
        ("SELECT id FROM orders extra words", "unexpected input at position 28"),
        ("SELECT o.id FROM orders o JOIN lineitem l ON o.id < l.order_id", "only supports equality"),
        ("SELECT id FROM orders LIMIT 1.5", "LIMIT must be an integer"),
        ("SELECT id FROM orders LIMIT -1", "LIMIT must be >= 0"),
        ("SELECT FROM orders", "expected expression at position 7"),
        ("SELECT id orders", "expected FROM at position 16, got EOF"),
        ("SELECT 'abc FROM orders", "unterminated string at position 7"),
        ("SELECT id; FROM orders", "unexpected character ';' at position 9"),
        ("SELECT id FROM orders WHERE id <> 1", "expected expression"),
        ("SELECT id, * FROM orders", "invalid SELECT item"),
        ("SELECT nope FROM orders", "unknown column nope"),
        ("SELECT id FROM orders WHERE id = 1 OR nope = 2", "unknown column nope"),
        ("SELECT id FROM orders a JOIN orders b ON a.id = b.id", "ambiguous column id"),
        ("SELECT id FROM nope", "unknown table nope"),
        ("SELECT id FROM orders LEFT JOIN lineitem ON id = order_id", "LEFT JOIN is not supported"),
        ("SELECT COUNT(id FROM orders", "expected \\) at position 16, got FROM"),
        ("SELECT id FROM orders ORDER BY nope", "unknown column nope"),
        ("SELECT ID FROM orders", "unknown column ID"),
    ],
)
def test_errors(shop, text, message):
    with pytest.raises(EngineError, match=message):
        rows(shop, text)


def test_parse_shapes():
    q = parse("select Distinct a.b AS x, 'it''s', -1.5, 2. from t as u where not a = 1 and (b or c) order by a desc, b limit 3")
    assert q.distinct and [i.name for i in q.items] == ["x", "'it''s'", "-1.5", "2.0"]
    assert str(q.where) == "NOT a = 1 AND b OR c" and [o.descending for o in q.order_by] == [True, False] and q.limit == 3


# --- plans


def lines(catalog, text, **options):
    return explain(catalog, text, **options).splitlines()


def test_filters_move_below_joins(shop):
    text = "SELECT o.region, l.revenue FROM orders o JOIN lineitem l ON o.id = l.order_id WHERE "
    assert lines(shop, text + "o.year = 2024 AND l.sku = 'widget'") == [
        "Project o.region, l.revenue", "  HashJoin o.id = l.order_id", "    Filter o.year = 2024", "      Scan o", "    Filter l.sku = 'widget'", "      Scan l",
    ]
    assert lines(shop, text + "o.year = 2024 AND l.sku = 'widget'", pushdown=False)[1] == "  Filter o.year = 2024 AND l.sku = 'widget'"
    assert lines(shop, text + "o.year = 2024 OR l.sku = 'widget'")[1] == "  Filter o.year = 2024 OR l.sku = 'widget'"
    assert lines(shop, text + "1 = 1")[2] == "    Filter 1 = 1"


def test_pushdown_off_holds_in_what_spark_runs(spark, tmp_path):
    """The filter stays above the join and away from the reader, in a lazy frame too; with pushdown it is below, in the reader."""
    catalog = Catalog(spark)
    for name in "ab":
        spark.range(100).selectExpr("id", "id % 3 AS k").write.parquet(str(tmp_path / name))
        catalog.load_parquet(name, tmp_path / name)
    text = "SELECT a.id FROM a JOIN b ON a.id = b.id WHERE a.k = 1"
    on, off = (sql(catalog, text, pushdown=p) for p in (True, False))
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (on, off)]
    assert plans[0].index("Join Inner") < plans[0].index("= 1)") and plans[1].index("= 1)") < plans[1].index("Join Inner")
    assert "EqualTo(k,1)" in on._jdf.queryExecution().executedPlan().toString() and "EqualTo(k,1)" not in off._jdf.queryExecution().executedPlan().toString()
    assert sorted(on.collect()) == sorted(off.collect()) and len(on.collect()) == 33


def test_orders_of_small_and_large_tables(spark, tmp_path, monkeypatch):
    """One large table is not read for statistics; two are. Those of small files are kept until the files change."""
    from tidemill.plans import stats

    catalog = Catalog(spark)
    for name, n in (("f", 1000), ("d", 40), ("t", 3)):
        spark.range(n).selectExpr("id", "id % 40 AS dim_id", "id % 3 AS tiny_id", "CAST(id AS STRING) AS label").write.parquet(str(tmp_path / name))
        catalog.load_parquet(name, tmp_path / name)
    large = {"f"}
    monkeypatch.setattr(stats, "small", lambda table: table.name not in large)
    plan = lines(catalog, STAR)
    assert "f" not in catalog.stats and catalog.stats["t"][1].ndv == {"id": 3}
    again = Catalog(spark)
    again.load_parquet("t", tmp_path / "t")
    assert stats.table_stats(again, again.get("t"), {"id"}) is catalog.stats["t"][1]
    spark.range(7).selectExpr("id", "id AS dim_id", "id AS tiny_id", "'x' AS label").write.mode("overwrite").parquet(str(tmp_path / "t"))
    again.load_parquet("t", tmp_path / "t")
    assert stats.table_stats(again, again.get("t"), {"id"}) == stats.TableStats(7, {"id": 7})
    again.register_frame("one", spark.read.parquet(str(tmp_path / "t")).selectExpr("id * 0 AS id", "dim_id", "tiny_id", "label"))
    again.register_frame("none", spark.read.parquet(str(tmp_path / "t")).where("id < 0"))
    assert [stats.table_stats(again, again.get(t), {"id"}) for t in ("one", "none")] == [stats.TableStats(7, {"id": 1}), stats.TableStats(0, {"id": 0})]
    spark.range(3).selectExpr("id", "id AS dim_id", "id AS tiny_id", "'x' AS label").write.mode("overwrite").parquet(str(tmp_path / "t"))
    catalog.load_parquet("t", tmp_path / "t")
    catalog.stats.clear()
    large.add("d")
    assert lines(catalog, STAR) == plan and catalog.stats["f"][1].ndv == {"dim_id": 40, "tiny_id": 3} and "Reorder" in plan[1]


def test_text_and_time(spark):
    catalog = Catalog(spark)
    catalog.register("a", "t TIMESTAMP", [(datetime(2024, 5, 6, 7, 8),), (None,)])
    catalog.register("b", "t STRING", [("2024-05-06 07:08:00",), ("no time",), (None,)])
    assert len(rows(catalog, "SELECT a.t FROM a JOIN b ON a.t = b.t")) == 1 == len(rows(catalog, "SELECT t FROM a WHERE t = '2024-05-06 07:08:00'"))


def test_cross_table_and_inside_or(shop):
    text = "SELECT o.id, l.sku FROM orders o JOIN lineitem l ON o.id = l.order_id WHERE (o.year = 2024 AND l.sku = 'gadget') OR o.id = 3"
    assert sorted(rows(shop, text)) == [(1, "gadget"), (3, "widget"), (4, "gadget")] == sorted(rows(shop, text, pushdown=False))


def test_tail_shapes(shop):
    assert lines(shop, "SELECT id FROM orders ORDER BY id DESC LIMIT 1") == ["Project id", "  TopK 1 by id DESC", "    Scan orders"]
    assert lines(shop, "SELECT id FROM orders LIMIT 1") == ["Limit 1", "  Project id", "    Scan orders"]
    assert lines(shop, "SELECT id FROM orders ORDER BY id")[1] == "  Sort id ASC"
    assert lines(shop, "SELECT DISTINCT id FROM orders ORDER BY id LIMIT 2")[:2] == ["TopK 2 by id ASC", "  Distinct"]
    assert lines(shop, "SELECT region, COUNT(*) AS n FROM orders GROUP BY region")[1] == "  HashAggregate group_by=[region] aggs=[n]"
    assert lines(shop, "SELECT SUM(id) FROM orders")[1] == "  HashAggregate group_by=[(all rows)] aggs=[SUM(id)]"


def test_spark_plan_is_pruned_and_pushed(spark, tmp_path):
    catalog = Catalog(spark)
    spark.range(100).selectExpr("id", "id % 3 AS a", "id AS b", "id AS c").write.parquet(str(tmp_path / "x"))
    catalog.load_parquet("x", tmp_path / "x")
    plan = sql(catalog, "SELECT p.b FROM x p JOIN x q ON p.id = q.id WHERE q.a = 1")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,b:bigint>" in plan and "ReadSchema: struct<id:bigint,a:bigint>" in plan and "EqualTo(a,1)" in plan
    plan = sql(catalog, "SELECT b FROM x ORDER BY a, id LIMIT 3")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_join_order(star):
    catalog = star()
    plan = lines(catalog, STAR)
    assert plan == [
        "Project f.id, d.label", "  Reorder to declared column order", "    HashJoin f.dim_id = d.id", "      HashJoin t.id = f.tiny_id",
        "        Filter t.id = 1", "          Scan t", "        Scan f", "      Scan d",
    ]
    assert plan != lines(catalog, STAR, reorder=False)
    assert sorted(rows(catalog, STAR)) == sorted(rows(catalog, STAR, reorder=False)) != []
    text = "SELECT * FROM f JOIN d ON f.dim_id = d.id JOIN t ON f.tiny_id = t.id"
    a, b = execute(catalog, text), execute(catalog, text, reorder=False)
    assert a[1].names() == b[1].names() and a[1].names()[:2] == ["f.id", "f.dim_id"] and sorted(a[0]) == sorted(b[0])
    two = "SELECT f.id FROM f JOIN d ON f.dim_id = d.id"
    assert lines(catalog, two) == lines(catalog, two, reorder=False) and not catalog.stats.get("d", (0, 0))[1] == 0


@pytest.mark.parametrize("seed", range(6))
def test_random_joins_agree(spark, seed):
    rng = random.Random(seed)
    catalog = Catalog(spark)
    n_d, n_t, n_f = rng.randint(2, 12), rng.randint(1, 5), rng.randint(1, 120)
    catalog.register("f", "id BIGINT, dim_id BIGINT, tiny_id BIGINT", [(i, rng.randrange(n_d + 2), rng.choice([None, *range(n_t + 2)])) for i in range(n_f)])
    catalog.register("d", "id BIGINT, label STRING", [(i, f"d{i}") for i in range(n_d)])
    catalog.register("t", "id BIGINT, label STRING", [(i, f"t{i}") for i in range(n_t)])
    text = f"SELECT f.id, d.label, t.label FROM f JOIN d ON f.dim_id = d.id JOIN t ON f.tiny_id = t.id WHERE t.id = {rng.randrange(n_t)} AND NOT d.id = 1"
    results = [sorted(rows(catalog, text, reorder=r, pushdown=p)) for r in (True, False) for p in (True, False)]
    assert all(r == results[0] for r in results)


@pytest.mark.parametrize("seed", range(4))
def test_nested_loop_agrees_with_hash_join(spark, seed):
    rng = random.Random(seed)
    catalog = Catalog(spark)
    catalog.register("l", "id BIGINT, region STRING", [(rng.choice([None, 1, 2, 3, 4]), f"r{i}") for i in range(rng.randint(0, 30))])
    catalog.register("r", "fk BIGINT, amount BIGINT", [(rng.choice([None, 1, 2, 3, 5]), i) for i in range(rng.randint(0, 30))])
    sides = []
    for k, name in enumerate("lr"):
        table = catalog.get(name)
        scope = table.scope()
        fields = tuple(type(f)(f.name, f.table, f"t{k}_{i}", f.kind, f.nullable) for i, f in enumerate(scope.fields))
        sides.append(Scan(type(scope)(fields), (), table, name))
    args = (sides[0].scope + sides[1].scope, tuple(sides), Ref("id", "l"), Ref("fk", "r"))
    a, b = (sorted(map(str, cls(*args).frame().collect())) for cls in (HashJoin, NestedLoopJoin))
    assert a == b
    assert "BroadcastNestedLoopJoin" in NestedLoopJoin(*args).frame()._jdf.queryExecution().executedPlan().toString()
