"""CSV typing, snapshot tables, registered rows and the command line."""

import json
from pathlib import Path

import pytest

from tidemill import Catalog, EngineError, SnapshotTable, execute, explain_analyze
from tidemill.cli import main
from tidemill.engine import format_analyze
from tidemill.plans.costs import Edge, cheapest_order, filtered_rows, join_rows, selectivity
from tidemill.plans.stats import TableStats, table_stats
from tidemill.plans.syntax import Ref, parse

ROOT = Path(__file__).resolve().parent.parent


def load(spark, tmp_path, text, **options):
    path = tmp_path / "t.csv"
    path.write_text(text, encoding="utf-8")
    catalog = Catalog(spark)
    catalog.load_csv("t", path, **options)
    return catalog


def test_csv_types(spark, tmp_path):
    text = 'a,b,c,d,e,f,g\n1,1,x,007,1_000,"",1e5\n-2,2.5,7," 12 ",+5,,nan\n,,,3,0,,.5\n'
    catalog = load(spark, tmp_path, text)
    assert [f.dataType.simpleString() for f in catalog.get("t").frame.schema] == ["bigint", "double", "string", "bigint", "bigint", "string", "double"]
    got, scope = execute(catalog, "SELECT a, b, c, d, e, f FROM t ORDER BY e DESC")
    assert got == [(1, 1.0, "x", 7, 1000, None), (-2, 2.5, "7", 12, 5, None), (None, None, None, 3, 0, None)]
    assert scope.names() == ["a", "b", "c", "d", "e", "f"]


def test_csv_cells_that_are_not_numbers(spark, tmp_path):
    catalog = load(spark, tmp_path, "a,b,c,d\n5d,1__0,0x1,1_\n1,2,3,4\n")
    assert {f.dataType.simpleString() for f in catalog.get("t").frame.schema} == {"string"}
    catalog = load(spark, tmp_path, "a,b\n99999999999999999999,1" + "0" * 50 + "\n1,2\n")
    assert [f.dataType.simpleString() for f in catalog.get("t").frame.schema] == ["decimal(38,0)", "double"]


def test_csv_cells_of_any_length(spark, tmp_path):
    long = 200_000
    catalog = load(spark, tmp_path, f"a,b,c,d,e\n{'1' * 350},0.{'1' * long},1{'_1' * long},{'0' * long}7,x{'y' * long}\n2,3,4,5,6\n")
    assert [f.dataType.simpleString() for f in catalog.get("t").frame.schema] == ["string", "double", "string", "bigint", "string"]
    assert execute(catalog, "SELECT d FROM t ORDER BY d")[0] == [(5,), (7,)]


def test_csv_quotes_and_lines(spark, tmp_path):
    catalog = load(spark, tmp_path, 'a,b\n"say ""hi""",1\n"two\nlines",2\nshort\n\nlong,4,5\n')
    assert execute(catalog, "SELECT a, b FROM t ORDER BY b")[0] == [('say "hi"', 1), ("two\nlines", 2), ("long", 4), ("short", None)]
    assert execute(load(spark, tmp_path, "a,b\n1,2\n3,4\n", multiline=False), "SELECT a FROM t ORDER BY a")[0] == [(1,), (3,)]


def test_csv_headers(spark, tmp_path):
    assert execute(load(spark, tmp_path, "a,b\n"), "SELECT COUNT(*) AS n FROM t")[0] == [(0,)]
    catalog = load(spark, tmp_path, "a,a,b\n1,2,3\n")
    assert execute(catalog, "SELECT b FROM t")[0] == [(3,)]
    with pytest.raises(EngineError, match="ambiguous column a"):
        execute(catalog, "SELECT a FROM t")
    with pytest.raises(EngineError, match="is empty"):
        load(spark, tmp_path, "")


def test_csv_directory(spark, monkeypatch):
    monkeypatch.chdir(ROOT)
    catalog = Catalog(spark)
    assert catalog.load_dir("examples") == ["lineitem", "orders"]
    text = "SELECT o.region, SUM(l.revenue) AS total FROM orders o JOIN lineitem l ON o.id = l.order_id WHERE o.year = 2024 GROUP BY o.region"
    assert dict(execute(catalog, text)[0]) == {"west": 15, "east": 20, "north": 10}


def test_register(spark):
    catalog = Catalog(spark)
    catalog.register("t", ["a", "b"], [(1, None), (2, None)])
    catalog.register("t", ["a"], [(1.5,), (2,)])
    assert execute(catalog, "SELECT a FROM t ORDER BY a")[0] == [(1.5,), (2.0,)]
    catalog.register("e", "a INT, b STRING", [])
    assert execute(catalog, "SELECT COUNT(*) AS n, SUM(a) AS s FROM e")[0] == [(0, None)]
    with pytest.raises(EngineError, match="mixes"):
        catalog.register("m", ["a"], [(1,), ("x",)])
    catalog.register_frame("f", spark.range(3))
    assert execute(catalog, "SELECT f.id FROM f WHERE id > 1")[0] == [(2,)]


def test_snapshots(spark, tmp_path):
    table = SnapshotTable.create(spark, tmp_path / "orders", ["id:int", "region:str", "year:int"])
    assert table.append([{"id": 1, "region": "west", "year": 2024}, {"id": 2, "region": "east", "year": 2024}]) == 1
    assert table.append([(3, "west", 2023)]) == 2
    catalog = Catalog(spark)
    ids = lambda: sorted(r[0] for r in execute(catalog, "SELECT id FROM orders")[0])
    assert catalog.load_snapshot("orders", table.path) == 2 and ids() == [1, 2, 3]
    assert catalog.load_snapshot("orders", table.path, version=1) == 1 and ids() == [1, 2]
    assert catalog.load_snapshot("orders", table.path, version=0) == 0 and ids() == []
    table.overwrite([(9, "south", 2025)])
    assert catalog.load_snapshot("orders", table.path) == 3 and ids() == [9]
    assert catalog.load_snapshot("orders", table.path, version=2) == 2 and ids() == [1, 2, 3]
    assert table.restore(2) == 4 and sorted(r.id for r in table.read().collect()) == [1, 2, 3]
    assert [(c.operation, c.num_records) for c in table.history()] == [("CREATE", 0), ("APPEND", 2), ("APPEND", 3), ("OVERWRITE", 1), ("RESTORE", 3)]
    assert table.describe(1)["num_records"] == 2
    assert catalog.get("orders").scope().names() == ["orders.id", "orders.region", "orders.year"]
    for version in (99, -1):
        with pytest.raises(EngineError, match="snapshot: .* has no version"):
            catalog.load_snapshot("orders", table.path, version=version)
    with pytest.raises(EngineError, match="snapshot: no table"):
        catalog.load_snapshot("x", tmp_path / "nothing")
    with pytest.raises(EngineError, match="is a table already"):
        SnapshotTable.create(spark, table.path, ["id:int"])
    with pytest.raises(EngineError, match="snapshot"):
        SnapshotTable.create(spark, tmp_path / "y", ["id:date"])


def test_snapshot_writers_do_not_overwrite_each_other(spark, tmp_path):
    table = SnapshotTable.create(spark, tmp_path / "t", ["id:int"])
    table.append([(1,)])
    with pytest.raises(EngineError, match="was written by someone else"):
        table._publish({"version": 1, "operation": "APPEND", "added": [], "num_records": 0})
    assert [r.id for r in table.read().collect()] == [1]


def test_snapshot_with_a_long_history(spark, tmp_path):
    table = SnapshotTable.create(spark, tmp_path / "t", ["id:int"])
    for i in range(18):
        table.append([(i,)])
    assert sorted(r.id for r in table.read(17).collect()) == list(range(17)) and table.read().count() == 18
    assert "files" in table._commit(16) and "files" not in table._commit(17)


# --- statistics, costs and profiles


def where(text):
    return parse(f"SELECT a FROM t WHERE {text}").where


def test_costs():
    stats = TableStats(100, {"a": 10, "b": 4})
    for text, share in [("a = 3", 0.1), ("3 = a", 0.1), ("a != 3", 0.9), ("a = 1 AND b = 1", 0.025), ("a = 1 OR b = 1", 0.325), ("NOT b = 1", 0.75), ("a < 1", 1 / 3), ("a = b", 0.1), ("a", 0.1)]:
        assert selectivity(where(text), stats) == pytest.approx(share), text
    assert filtered_rows([where("a = 1")], TableStats(0, {})) == 1.0
    assert (join_rows(100, 10, 10, 10), join_rows(100, 100, 100, 10), join_rows(0, 0, 1, 1)) == (100, 100, 1)


def test_join_order_needs_a_connected_choice():
    edge = Edge(0, Ref("x", "a"), 1, Ref("y", "b"))
    assert cheapest_order([1, 1], {}, [edge]) is None
    assert cheapest_order([1, 1, 1], {}, [edge]) is None
    assert cheapest_order([1.0] * 11, {}, [Edge(i, Ref("x"), i + 1, Ref("y")) for i in range(10)]) is None
    order = cheapest_order([1000.0, 10.0, 1.0], {(0, "x"): 10, (1, "y"): 10, (0, "z"): 3, (2, "w"): 3}, [edge, Edge(0, Ref("z", "a"), 2, Ref("w", "c"))])
    assert [added for added, _ in order] == [2, 0, 1]


def test_statistics_skip_nulls_and_unneeded_tables(spark, star):
    catalog = Catalog(spark)
    table = catalog.register("t", "a BIGINT, b STRING", [(1, "x"), (1, "y"), (2, "x"), (None, "x")])
    assert table_stats(catalog, table, {"a", "b"}) == TableStats(4, {"a": 2, "b": 2})
    two = star()
    execute(two, "SELECT f.id FROM f JOIN d ON f.dim_id = d.id LIMIT 1")
    assert two.stats == {}


def test_statistics_of_a_large_table_are_exact(spark):
    catalog = Catalog(spark)
    table = catalog.register_frame("t", spark.range(150_000).selectExpr("id AS a", "IF(id % 2 = 0, id % 7001, NULL) AS b"))
    assert table_stats(catalog, table, {"a", "b"}) == TableStats(150_000, {"a": 150_000, "b": 7001})


def find(plan, start):
    return next((n for n in flat(plan) if n.label.startswith(start)), None)


def flat(plan):
    return [plan, *[n for c in plan.children for n in flat(c)]]


def test_profile_counts_rows(spark):
    catalog = Catalog(spark)
    catalog.register("t", ["id", "k"], [(i, i % 4) for i in range(100)])
    found = explain_analyze(catalog, "SELECT t.id FROM t WHERE t.k = 1")
    assert (find(found.plan, "Scan").actual_rows, find(found.plan, "Filter").actual_rows, find(found.plan, "Filter").estimated_rows) == (100, 25, 25)
    assert found.plan.actual_rows == len(found.rows) == 25 and found.plan.total_ms > 0
    catalog.register("t", ["id", "k"], [(i, 0) for i in range(97)] + [(97, 1), (98, 2), (99, 3)])
    found = explain_analyze(catalog, "SELECT t.id FROM t WHERE t.k = 1")
    assert find(found.plan, "Filter").actual_rows == 1 and find(found.plan, "Filter").misestimate == 25
    assert "estimate off by 25x" in format_analyze(found.plan)
    bare = explain_analyze(catalog, "SELECT t.id FROM t WHERE t.k = 1", fetch=False)
    counts = lambda plan: [plan.actual_rows, *[n for c in plan.children for n in counts(c)]]
    assert bare.rows == [] and counts(bare.plan) == counts(found.plan)
    timed = explain_analyze(catalog, "SELECT t.id FROM t WHERE t.k = 1", times=True).plan
    scan = timed.children[0].children[0]
    assert timed.total_ms >= timed.children[0].total_ms >= scan.total_ms == scan.self_ms > 0 and timed.self_ms >= 0 and found.plan.children[0].total_ms is None
    catalog.register("t", ["id"], [(i,) for i in range(1000)])
    found = explain_analyze(catalog, "SELECT t.id FROM t LIMIT 3")
    assert found.plan.actual_rows == 3 and found.plan.estimated_rows == 3


def test_profile_of_reordered_joins(star):
    text = "SELECT f.id, d.label FROM f JOIN d ON f.dim_id = d.id JOIN t ON f.tiny_id = t.id WHERE t.id = 1"
    widest = []
    for reorder in (True, False):
        catalog = star(600, 30, 10)
        found = explain_analyze(catalog, text, reorder=reorder)
        assert sorted(found.rows) == sorted(execute(catalog, text)[0])
        widest.append(max(n.actual_rows for n in flat(found.plan) if n.operator == "HashJoin"))
    assert widest == [60, 600]
    data = json.loads(json.dumps(found.plan.to_dict()))
    assert {"label", "operator", "estimated_rows", "actual_rows", "total_ms", "self_ms", "children"} <= set(data)


@pytest.mark.parametrize("text,scan", [("SELECT id FROM t LIMIT 0", 0), ("SELECT id FROM t WHERE 1 = 2", 50), ("SELECT a.id FROM t a JOIN e ON a.id = e.id", 50), ("SELECT COUNT(*) AS n FROM t LIMIT 0", 50)])
def test_profile_of_nodes_the_optimizer_drops(spark, text, scan):
    catalog = Catalog(spark)
    catalog.register("t", ["id"], [(i,) for i in range(50)])
    catalog.register("e", "id BIGINT", [])
    found = explain_analyze(catalog, text)
    assert found.rows == [] and find(found.plan, "Scan").actual_rows == scan


def test_profile_without_pushdown(shop):
    text = "SELECT o.region, l.revenue FROM orders o JOIN lineitem l ON o.id = l.order_id WHERE o.year = 2024"
    fed = [sum(c.actual_rows for c in find(explain_analyze(shop, text, pushdown=p).plan, "HashJoin").children) for p in (True, False)]
    assert fed == [10, 11]


# --- command line


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(ROOT)
    text = "SELECT region, COUNT(*) AS n FROM orders GROUP BY region ORDER BY n DESC, region"
    assert main([text]) == 0
    assert capsys.readouterr().out == "region | n\n-------+--\nwest   | 2\neast   | 1\nnorth  | 1\n(3 rows)\n"
    assert main(["SELECT o.region FROM orders o WHERE id = 1 AND year = 9"]) == 0
    assert capsys.readouterr().out == "o.region\n--------\n(0 rows)\n"
    assert main(["--explain", "--no-pushdown", "SELECT o.id FROM orders o JOIN lineitem l ON o.id = l.order_id WHERE o.year = 2024"]) == 0
    assert capsys.readouterr().out.splitlines()[1] == "  Filter o.year = 2024"
    assert main(["--analyze", "SELECT region FROM orders WHERE year = 2024"]) == 0
    out = capsys.readouterr().out
    assert "est=" in out and "actual=3" in out and out.endswith("(3 rows)\n")
    assert main(["--analyze", "--json", "SELECT region FROM orders WHERE year = 2024"]) == 0
    data = json.loads(capsys.readouterr().out)
    assert data["columns"] == ["region"] and len(data["rows"]) == data["plan"]["actual_rows"] == 3
    assert main(["SELECT nope FROM orders"]) == 1
    assert "error: unknown column nope" in capsys.readouterr().err
    assert main(["--data", str(tmp_path / "none"), text]) == 2
    assert main(["--table", "orders", text]) == 2
    table = SnapshotTable.create(spark, tmp_path / "o", ["id:int", "region:str"])
    table.append([(1, "west")])
    table.append([(2, None)])
    capsys.readouterr()
    assert main(["--table", f"orders={table.path}", "--version", "1", "SELECT id, region FROM orders"]) == 0
    got = capsys.readouterr()
    assert got.err == "-- orders at version 1\n" and got.out.endswith("1  | west  \n(1 row)\n")
    assert main(["--table", f"orders={table.path}", "SELECT id, region FROM orders WHERE id = 2"]) == 0
    assert "2  | NULL" in capsys.readouterr().out
    assert main(["--table", f"orders={tmp_path}/none", text]) == 1
