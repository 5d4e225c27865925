"""Go files with queries in their literals, of a shape by their key: which functions touch which tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embedded_sql, extract
from ..sources.files import language_of
from ..sources.tables import Tables, node_id
from .registry import Registry

R = Registry()

#: Layouts of a Go file; $ is the part's key, # its size.
LAYOUTS = (
    'package p\n\nfunc list$(db *sql.DB) error {\n\t_, err := db.Exec("UPDATE public.t# SET a = a WHERE b = \\"x\\" FOR UPDATE SKIP LOCKED", 1)\n\treturn err\n}\n\nfunc load$(db *sqlx.DB) error {\n\treturn db.Get(&x, "SELECT a FROM t#")\n}\n',
    'package p\n\nvar q = "SELECT 1 FROM global"\n\n// func no$() { db.Exec("DELETE FROM no")\nfunc (s *S) move$(m map[string]interface{}) (interface{}, error) {\n\tlog("SELECT a FROM early")\n\trows := s.db.QueryContext(ctx, `\n\t\tSELECT a -- }\n\t\tFROM t#\n\t\tJOIN u# USING (a)`)\n\tif x {\n\t\ts.db.ExecContext(ctx, "DELETE FROM t#")\n\t}\n\treturn nil, nil\n}\n\nvar r = "UPDATE late SET a = 1"\n',
    "package p\n\nfunc put$[T any](db *sql.DB) {\n\tc := '{'\n\tdb.Query(`INSERT INTO t# (a)\nSELECT a\nFROM u#\nON CONFLICT DO UPDATE SET a = 1`)\n}\n\nfunc idle$() {\n\tx := \"SELECT a FROM idle\"\n}\n",
)
# Known answers: layout, function, its line, line, api, operation, table.
_ANSWERS = """(VALUES (0, 'list$', 3, 4, 'database/sql', 'update', 'public.t#'), (0, 'load$', 8, 9, 'sqlx', 'select', 't#'),
  (1, 'move$', 6, 10, 'database/sql', 'select', 't#'), (1, 'move$', 6, 11, 'database/sql', 'select', 'u#'), (1, 'move$', 6, 13, 'database/sql', 'delete', 't#'),
  (2, 'put$', 3, 5, 'database/sql', 'insert', 't#'), (2, 'put$', 3, 7, 'database/sql', 'select', 'u#')) a(layout, f, function_line, line, api, operation, t)"""
_FOUND = f"""SELECT 'repo:' || p_partkey % 25 AS repo_id, 'store/q' || p_partkey || '.go' AS path, replace(f, '$', p_partkey::VARCHAR) AS function, function_line, line, api, operation, replace(t, '#', p_size::VARCHAR) AS "table" FROM part JOIN {_ANSWERS} ON layout = p_partkey % 3"""


def _stores(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    text = F.coalesce(*[F.when(key % len(LAYOUTS) == i, F.lit(x)) for i, x in enumerate(LAYOUTS)])
    content = F.replace(F.replace(text, F.lit("$"), key.cast("string")), F.lit("#"), F.col("p_size").cast("string"))
    return t.part.select(F.concat(F.lit("repo:"), key % 25).alias("repo_id"), F.concat(F.lit("store/q"), key, F.lit(".go")).alias("path"), content.alias("content")).withColumn("language", language_of("path"))


def _migrations(t: Tables) -> DataFrame:
    """A migration for each supplier, that makes a table by its key's size."""
    content = F.concat(F.lit("CREATE TABLE IF NOT EXISTS app.T"), F.col("s_suppkey") % 60, F.lit(" (a int);\n"))
    return t.supplier.select(node_id("repo", "s_nationkey").alias("repo_id"), F.concat(F.lit("db/m"), "s_suppkey", F.lit(".sql")).alias("path"), content.alias("content")).withColumn("language", language_of("path"))


@R.add(_FOUND)
def go_embedded_queries(t: Tables) -> DataFrame:
    """The tables that each Go function touches in its queries, with the line, the interface and the operation."""
    return embedded_sql.embedded_queries(_stores(t))


@R.add(f"""WITH f AS ({_FOUND}), u AS (SELECT regexp_extract("table", '[^.]*$') AS "table", count(DISTINCT function) FILTER (WHERE operation = 'select') AS readers, count(DISTINCT function) FILTER (WHERE operation <> 'select') AS writers FROM f GROUP BY 1),
d AS (SELECT DISTINCT 't' || s_suppkey % 60 AS "table" FROM supplier)
SELECT coalesce(u."table", d."table") AS "table", d."table" IS NOT NULL AS defined, coalesce(readers, 0) AS readers, coalesce(writers, 0) AS writers FROM u FULL JOIN d ON u."table" = d."table" """)
def sql_table_uses(t: Tables) -> DataFrame:
    """Readers and writers of each table in Go functions, and whether a migration makes it."""
    tables = extract.symbols(_migrations(t)).where("kind = 'SqlTable'")
    return embedded_sql.table_uses(embedded_sql.embedded_queries(_stores(t)), tables)


QUERIES, SQL = R.queries, R.sql
