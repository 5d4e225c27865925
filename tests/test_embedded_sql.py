"""Queries in Go literals on small files: brackets in literals, calls of other functions, broken and empty files."""

import pytest

from loomgraph.functions import embedded_sql

FILES = "repo_id string, path string, language string, content string, line int, table string"


@pytest.fixture
def found(spark):
    def run(*texts, language="go"):
        rows = [("r", f"{i}.go", language, t, 1, "x") for i, t in enumerate(texts)]
        return sorted(tuple(r)[2:] for r in embedded_sql.embedded_queries(spark.createDataFrame(rows, FILES)).collect())

    return run


def test_interfaces_and_lines(found):
    text = 'package r\n\nfunc a(db *sql.DB) error {\n\t_, err := db.Exec("UPDATE public.users SET e = e", 42)\n\treturn err\n}\n\nfunc b(db *sqlx.DB) {\n\tdb.Queryx("SELECT id FROM public.orgs", 42)\n}\n'
    assert found(text) == [("a", 3, 4, "database/sql", "update", "public.users"), ("b", 8, 9, "sqlx", "select", "public.orgs")]


def test_brackets_and_words_in_literals_and_comments(found):
    text = "func a() {\n x := \"}\" // }\n /* } db.Get( */\n y := `}`\n z := '}'\n db.Query(\"SELECT 1 FROM t\")\n}\nfunc b() { \"SELECT 1 FROM u\" }\n"
    assert found(text) == [("a", 1, 6, "database/sql", "select", "t")]
    assert found('func a() {\n // db.Exec(\n x("DELETE FROM t")\n}\n') == []
    assert found('func a() { db.Exec("a \\" DELETE FROM t \\\\") }') == [("a", 1, 1, "database/sql", "delete", "t")]


def test_functions_end(found):
    text = 'func a() { db.Exec("x") }\nvar v = "SELECT 1 FROM t"\ntype S struct { f string }\nfunc b(f func(int) interface{}) { g(func() { db.Get("SELECT 1 FROM s.t JOIN u ON 1") }) }'
    assert found(text) == [("b", 4, 4, "sqlx", "select", "s.t"), ("b", 4, 4, "sqlx", "select", "u")]


def test_mentions_over_lines(found):
    assert found("func a() {\n db.Exec(`\nDELETE\n FROM t\nWHERE a IN (SELECT b FROM u FOR UPDATE NOWAIT)\n`)\n}") == [("a", 1, 3, "database/sql", "delete", "t"), ("a", 1, 5, "database/sql", "select", "u")]
    assert found("func a() { db.Exec(`select 1 from t`) }") == []


def test_no_rows(found):
    assert found(None, "", "func a() {", 'func a() { db.Exec("SELECT 1 FROM', "}}}{", "`") == [] and found('func a() { db.Exec("DELETE FROM t") }', language="java") == []
    assert len(found("func a() { db.Exec(`" + "SELECT a FROM t; \n" * 3000 + "`) }", 'func a() { db.Exec("' + "\\n" * 2000 + 'DELETE FROM t") }')) == 3001


def test_table_uses(spark):
    rows = [("r", "p", "f", 1, 1, "sqlx", "select", "App.T"), ("r", "p", "f", 1, 2, "sqlx", "select", "t"), ("r", "p", "g", 1, 2, "sqlx", "insert", "u")]
    found = spark.createDataFrame(rows, "repo_id string, path string, function string, function_line int, line int, api string, operation string, table string")
    tables = spark.createDataFrame([("r", "app.t"), ("r", "T"), ("r", "idle")], "repo_id string, name string")
    assert sorted(map(tuple, embedded_sql.table_uses(found, tables).collect())) == [("idle", True, 0, 0), ("t", True, 1, 0), ("u", False, 0, 1)]
