"""Source files with nested definitions, of a shape and size by their key: where definitions end and what holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nesting
from ..session import spread
from ..sources.files import language_of
from ..sources.tables import Tables
from .registry import Registry

R = Registry()

#: Layouts; $ is the part's key, ~ as many lines of body as its size mod 4.
LAYOUTS = (
    ("py", "import os\n\nclass C$(B):\n    '''def no(): {'''\n\n    def run$(self):\n        if x:\n            return {}\n~\n        def deep$():\n            # def fake():\n            pass\n        return deep$\n\n    async def last$(self): return 1\n\ndef top$():\n    return '{'\n"),
    ("go", "package main\n\ntype C$ struct {\n\ta int\n}\n\n// func no() {\nfunc (c C$) run$(m map[string]int) {\n\tif x { y(\"}\") }\n~\n\tfunc() {\n\t}()\n}\n\nfunc top$()\n{\n}\n"),
    ("ts", "export class C$ {\n  x = '{'\n}\nfunction run$() {\n~\n  function deep$() { return 1 }\n  const last$ = (a) => {\n    return a\n  }\n}\n"),
    ("rb", "class C$\n  def run$\n    if x\n~\n    end\n    [1].each do |i|\n      z\n    end\n  end\n\n  def last$\n  end\nend\n"),
)

# Known answers: layout, kind, name, first line, last line, whether the body's extra lines come before either, parent.
_ANSWERS = """(VALUES (0, 'Class', 'C', 3, 15, 0, 1, NULL), (0, 'Function', 'run', 6, 13, 0, 1, 'C'), (0, 'Function', 'deep', 10, 12, 1, 1, 'run'), (0, 'Function', 'last', 15, 15, 1, 1, 'C'), (0, 'Function', 'top', 17, 18, 1, 1, NULL),
  (1, 'Struct', 'C', 3, 5, 0, 0, NULL), (1, 'Function', 'run', 8, 13, 0, 1, NULL), (1, 'Function', 'top', 15, 17, 1, 1, NULL),
  (2, 'Class', 'C', 1, 3, 0, 0, NULL), (2, 'Function', 'run', 4, 10, 0, 1, NULL), (2, 'Function', 'deep', 6, 6, 1, 1, 'run'), (2, 'Function', 'last', 7, 9, 1, 1, 'run'),
  (3, 'Class', 'C', 1, 13, 0, 1, NULL), (3, 'Function', 'run', 2, 9, 0, 1, 'C'), (3, 'Function', 'last', 11, 12, 1, 1, 'C')) a(layout, kind, name, line, end_line, before, inside, parent)"""
_FOUND = f"""SELECT 'f' || p_partkey AS file, kind, name || p_partkey AS name, (line + before * (p_size % 4))::INT AS line, (end_line + inside * (p_size % 4))::INT AS end_line, parent || p_partkey AS parent
FROM part JOIN {_ANSWERS} ON layout = p_partkey % 4"""


def _code(t: Tables) -> DataFrame:
    """A source file for each part; its body's lines are one of its layout and as many as its size mod 4."""
    key = F.col("p_partkey").cast("string")
    layout = F.col("p_partkey") % len(LAYOUTS)

    def choose(values) -> Column:
        return F.coalesce(*[F.when(layout == i, F.lit(v)) for i, v in enumerate(values)])

    indent = choose(("        ", "\t", "  ", "      "))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda i: F.concat(indent, F.lit("v"), i.cast("string"), F.lit(" = w("), i.cast("string"), F.lit(")"))), "\n")
    content = F.replace(F.replace(choose([x[1] for x in LAYOUTS]), F.lit("$"), key), F.lit("~"), body)
    path = F.concat(F.lit("src/f"), key, F.lit("."), choose([x[0] for x in LAYOUTS]))
    # Parts are dealt by their file before it is written, as their table is read by few tasks.
    parts = spread(t.part.select("p_partkey", "p_size", F.concat(F.lit("repo:"), F.col("p_size") % 25).alias("repo_id"), path.alias("path")), "repo_id", "path", times=nesting.TASKS)
    return parts.select("repo_id", "path", content.alias("content")).withColumn("language", language_of("path"))


def _file() -> Column:
    return F.regexp_extract("path", r"(f[0-9]+)[.]", 1)


@R.add(f"SELECT file, kind, name, line, end_line FROM ({_FOUND})")
def definition_spans(t: Tables) -> DataFrame:
    """First and last line of definitions in indented, bracketed and worded languages, nested ones too."""
    return nesting.spans(_code(t)).select(_file().alias("file"), "kind", "name", "line", "end_line")


@R.add(f"""SELECT file, coalesce(CASE WHEN parent LIKE 'C%' THEN 'CLASS_CONTAINS' WHEN parent IS NOT NULL THEN 'NESTS' END, 'FILE_CONTAINS') AS type, coalesce(parent, file) AS src, name AS dst FROM ({_FOUND})""")
def definition_containment(t: Tables) -> DataFrame:
    """Members of classes, functions inside functions, and what stands in the file itself."""
    found = nesting.containment(nesting.spans(_code(t)))
    return found.select(_file().alias("file"), "type", F.when(F.col("type") == "FILE_CONTAINS", _file()).otherwise(F.col("src")).alias("src"), "dst")


@R.add(f"""WITH f AS ({_FOUND}), depths AS (SELECT a.file, a.name, a.end_line - a.line + 1 AS length, count(b.name) AS depth FROM f a LEFT JOIN f b ON a.file = b.file AND b.name <> a.name AND b.line <= a.line AND b.end_line >= a.end_line GROUP BY ALL)
SELECT depth, count(*) AS definitions, sum(length)::BIGINT AS lines, max(length)::INT AS longest FROM depths GROUP BY depth""")
def nesting_profile(t: Tables) -> DataFrame:
    """How deep definitions are nested, and how long they are there."""
    found = nesting.nested(nesting.spans(_code(t))).withColumn("length", F.col("end_line") - F.col("line") + 1)
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("definitions"), F.sum("length").alias("lines"), F.max("length").alias("longest")).withColumn("depth", F.col("depth").cast("long"))


QUERIES, SQL = R.queries, R.sql
