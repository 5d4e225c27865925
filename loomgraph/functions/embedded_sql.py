"""SQL in the string literals of Go functions: which function touches which table, and how.

A file becomes its tokens (literals, comments, heads of functions, calls, brackets, line ends), so brackets and words in literals and
comments count for nothing. Running sums over the tokens give lines and depth; what a literal belongs to is the last
head, and the last call of a database interface, before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Calls that take a query, and the ones among them that tell of sqlx.
CALLS = ("ExecContext", "Exec", "QueryContext", "QueryRowContext", "QueryRow", "Query", "QueryxContext", "Queryx", "GetContext", "Get", "SelectContext", "Select")
SQLX = ("QueryxContext", "Queryx", "GetContext", "Get", "SelectContext", "Select")

_HEAD = r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?\("
_CALL = r"\.\s*(" + "|".join(CALLS) + r")\s*\("
_TOKEN = "|".join(
    (r"//[^\n]*", r"/\*[\s\S]*?\*/", "`[^`]*`", r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'", _HEAD.replace(r"(\w+)", r"\w+"), r"\b(?:interface|struct)\s*\{\s*\}", _CALL.replace("(Exec", "(?:Exec"), r"[{}]", r"\n")
)
_NAME = r"([A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)*)"
#: A mention of a table; the words of FOR UPDATE and DO UPDATE mention none.
_MENTION = r"\b(?:(?<!\b(?:FOR|DO)\s{1,20})UPDATE|INSERT\s+INTO|DELETE\s+FROM|(?<!\bDELETE\s{1,20})FROM|JOIN)\s+" + _NAME


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def embedded_queries(files: DataFrame) -> DataFrame:
    """(repo_id, path, function, function_line, line, api, operation, table) of the tables that queries in Go files name.

    files: repo_id, path, language, content. A literal counts inside a named function of the file, after a call of a database interface in that
    function; each table it names in upper-case SQL is a row, with the line its mention begins on. api: sqlx or database/sql; operation: select,
    update, insert or delete. Null and empty contents and files of other languages give no rows; other columns are ignored.
    """
    go = files.where((F.col("language") == "go") & F.col("content").isNotNull())
    token = F.col("token")
    each = go.select("repo_id", "path", F.posexplode(F.regexp_extract_all("content", F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    # Newlines between tokens are tokens themselves; those within one count after it.
    so_far = Window.partitionBy("repo_id", "path").orderBy("pos")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
    placed = each.withColumns({"line": F.coalesce(F.sum(_newlines(token)).over(before), F.lit(0)).cast("int") + 1, "depth": F.sum(step).over(so_far), "literal": F.rlike(token, F.lit('^["`]'))})
    head = ~F.col("literal") & (F.col("depth") == 0) & F.rlike(token, F.lit("^func"))
    ends = (token == "}") & (F.col("depth") <= 0)
    # A head begins a function and forgets the calls before it; the bracket that closes it leaves none.
    none = F.lit(None).cast("string")
    held = F.when(head, F.struct(F.regexp_extract(token, _HEAD, 1).alias("name"), F.col("line").alias("at"))).when(ends, F.struct(none.alias("name"), F.col("line").alias("at")))
    called = F.when(head | ends, F.struct(none.alias("call"))).when(F.startswith(token, F.lit(".")), F.struct(F.regexp_extract(token, _CALL, 1).alias("call")))
    known = placed.withColumns({"f": F.last(held, ignorenulls=True).over(before), "c": F.last(called, ignorenulls=True).over(before)})
    found = known.where("literal AND f.name IS NOT NULL AND c.call IS NOT NULL")
    # Each piece after the first begins with a mention.
    pieces = F.split(F.substring(token, F.lit(2), F.length(token) - 2), f"(?={_MENTION})")
    rows = found.withColumn("pieces", pieces).select("repo_id", "path", "line", "f", "c", "pieces", F.posexplode("pieces").alias("nth", "piece"))
    rows = rows.withColumn("table", F.regexp_extract("piece", f"^{_MENTION}", 1)).where("table <> ''")
    verb = F.upper(F.regexp_extract("piece", r"^(\w+)", 1))
    operation = F.when(verb == "UPDATE", "update").when(verb == "INSERT", "insert").when(verb == "DELETE", "delete").otherwise("select")
    line = F.col("line") + _newlines(F.array_join(F.slice("pieces", F.lit(1), F.col("nth")), ""))
    api = F.when(F.col("c.call").isin(*SQLX), "sqlx").otherwise("database/sql")
    return rows.select("repo_id", "path", F.col("f.name").alias("function"), F.col("f.at").alias("function_line"), line.alias("line"), api.alias("api"), operation.alias("operation"), "table")


def table_uses(found: DataFrame, tables: DataFrame) -> DataFrame:
    """(table, defined, readers, writers): the functions that read and write each table of found (embedded_queries) and tables (repo_id, name).

    A table is known by its name without schema, in lower case; defined says whether `tables` has it. Tables nobody touches have zeros.
    """
    bare = lambda c: F.lower(F.regexp_extract(c, r"([^.]*)$", 1))
    function = F.struct("repo_id", "path", "function")
    used = found.groupBy(bare("table").alias("table")).agg(F.count_distinct(F.when(F.col("operation") == "select", function)).alias("readers"), F.count_distinct(F.when(F.col("operation") != "select", function)).alias("writers"))
    known = tables.select(bare("name").alias("table")).distinct().withColumn("defined", F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return known.join(used, "table", "full").select("table", F.coalesce("defined", F.lit(False)).alias("defined"), zero("readers"), zero("writers"))
