"""Where definitions end and what stands inside them.

A line's level is its depth in brackets (by a running sum) or its indentation. A definition on a level ends at the first later
line that comes back to that level, so levels that lines come back to are rows of their own, and one window over the lines of a
file and level gives each definition its end. Spans of a file nest, so a definition's parent is the innermost span around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .extract import SYMBOLS

#: Languages whose blocks are told by indentation, and those whose blocks end with a word (and which words begin one).
INDENTED = ("python",)
WORDED = ("ruby",)
_DEFINITIONS = ("Function", "Class", "Struct", "Interface", "Trait")
_FILE = ("repo_id", "path")
#: Tasks for each shuffle partition: a file becomes a row for each line and more, which are sorted four times in the same task.
TASKS = 4


def _code(text: Column) -> Column:
    """A line without what strings and comments of a line hold."""
    return F.regexp_replace(F.regexp_replace(text, r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)""", '""'), r"//.*$|(?<!\S)#.*$|/\*.*?\*/", "")


def _levels(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, line, code, level, back, previous, last_line): the level before each line, the levels that it comes back to, the line of code before it and the last of its file.

    Files are dealt by path before they become lines; all windows keep to a file, so its lines stay in that task.
    """
    each = spread(files.where("repo_id IS NOT NULL AND path IS NOT NULL").select(*_FILE, "language", "content"), *_FILE, times=TASKS)
    # Cut and stripped in one go, else the filter would strip each line a second time.
    all_ = each.select(*_FILE, "language", F.posexplode(F.transform(F.split("content", "\r?\n"), _code)).alias("i", "code")).where(F.trim("code") != "")
    indented, word = F.col("language").isin(*INDENTED), F.col("language").isin(*WORDED)
    indent = F.length(F.regexp_replace(F.regexp_extract("code", r"^(\s*)", 1), "\t", "    "))
    opens = F.when(word, F.regexp_replace(F.col("code"), r"^\s*(?:def|class|module|if|unless|case|while|until|begin|for)\b.*|.*\bdo\b(?:\s*\|[^|]*\|)?\s*$", "{")).otherwise(F.col("code"))
    marks = F.regexp_replace(F.when(word, F.regexp_replace(opens, r"^\s*end\b.*", "}")).otherwise(opens), r"[^{}]", "")
    lines_ = all_.select(*_FILE, "language", (F.col("i") + 1).alias("line"), "code", F.when(indented, indent).alias("indent"), F.when(~indented, marks).alias("marks"))
    order = Window.partitionBy(*_FILE).orderBy("line")
    net = F.length("marks") - 2 * _closing(F.col("marks"))
    before = F.coalesce(F.sum(net).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    lines_ = lines_.withColumns({"level": F.when(indented, F.col("indent")).otherwise(before), "last": F.lag("indent").over(order), "previous": F.lag("line").over(order), "last_line": F.max("line").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    # Indentation: a line that doesn't stand further right than the one before ends the blocks of all levels in between. Brackets: depth after each closing one.
    after = F.transform(F.sequence(F.lit(1), F.length("marks")), lambda i: F.when(F.substr("marks", i, F.lit(1)) == "}", F.col("level") + i - 2 * _closing(F.substr("marks", F.lit(1), i))))
    back = F.when(F.col("last") >= F.col("level"), F.sequence("level", "last")).when(F.contains("marks", F.lit("}")), F.array_distinct(F.filter(after, F.isnotnull)))
    return lines_.select(*_FILE, "language", "line", "code", "level", back.alias("back"), "previous", "last_line")


def _closing(marks: Column) -> Column:
    """How many of a line's brackets are closing ones."""
    return F.length(F.replace(marks, F.lit("{"), F.lit("")))


def spans(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, kind, name, line, end_line) of functions, classes and the like.

    end_line is the line of the bracket (or word) that closes a definition, or the last line of an indented block; a definition without a body ends
    where it stands, one that is never closed at the last line of its file. Files without a repository, a path, a language or content give no row.
    """
    leveled = _levels(files)
    # Definitions are looked for in lines whose strings and comments are gone already.
    named = [F.when(F.col("language").isin(*ls), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("code", pattern, 1).alias("name"))) for ls, kind, pattern in SYMBOLS if kind in _DEFINITIONS]
    found = F.filter(F.array_distinct(F.array(*named)), lambda s: s.isNotNull() & (s["name"] != ""))
    python = F.col("language").isin(*INDENTED)
    bodiless = ~python & F.rlike("code", F.lit(r";\s*$")) & ~F.contains("code", F.lit("{"))
    # Rows of a line: its definitions, and the levels it ends. The line that ends an indented block is the one before; a bracket ends it where it stands.
    # Seen from the end of the file; on one line the end of a bracket comes after the definition, that of an indented block before.
    row = "array<struct<level:int,order:int,kind:string,name:string,bodiless:boolean,end:int>>"
    starts = F.transform(found, lambda s: F.struct(F.col("level"), F.lit(1), s["kind"], s["name"], bodiless, F.lit(None).cast("int")))
    ends = F.transform("back", lambda b: F.struct(b, F.when(python, 0).otherwise(2), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.when(python, F.col("previous")).otherwise(F.col("line"))))
    rows = leveled.select(*_FILE, "language", "line", "last_line", F.inline(F.concat(starts.cast(row), F.coalesce(ends.cast(row), F.array().cast(row)))))
    nearest = F.last("end", ignorenulls=True).over(Window.partitionBy(*_FILE, "level").orderBy(F.desc("line"), F.desc("order")).rowsBetween(Window.unboundedPreceding, -1))
    closed = rows.withColumn("closed", nearest).where("kind IS NOT NULL")
    end = F.when(F.col("bodiless"), F.col("line")).otherwise(F.coalesce("closed", "last_line"))
    return closed.select(*_FILE, "language", "kind", "name", "line", F.greatest(end, F.col("line")).alias("end_line"))


def nested(found: DataFrame) -> DataFrame:
    """found (spans) with depth, parent and parent_line: the innermost definition around each, null at the top.

    Spans either nest or lie apart, so of the starts and ends before a line those that are still open are the ones around it: each is told by the
    number of spans that are open where it begins, and its parent is the last one before it that begins one less deep.
    """
    # Both from one row, as found would be made twice for a union.
    edges = F.array(F.struct(F.col("line").alias("at"), F.lit(1).alias("step")), F.struct((F.col("end_line") + 1).alias("at"), F.lit(-1).alias("step")))
    edge = found.select(*_FILE, "line", "end_line", "kind", "name", F.inline(edges))
    order = Window.partitionBy(*_FILE).orderBy("at", "step", F.desc("end_line"), "line", "name")
    deep = edge.withColumn("open", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("step = 1").withColumn("depth", F.coalesce("open", F.lit(0)).cast("int")).drop("open", "at", "step")
    # Around a definition of depth d stands the last before it of depth d - 1: one row for the depth, one for the depth it holds.
    own = F.array(F.struct(F.col("depth").alias("slot"), F.lit(False).alias("holds")), F.struct((F.col("depth") + 1).alias("slot"), F.lit(True).alias("holds")))
    each = deep.select("*", F.inline(own))
    before = Window.partitionBy(*_FILE, "slot").orderBy("line", F.desc("end_line"), "name", "holds").rowsBetween(Window.unboundedPreceding, -1)
    holder = F.last(F.when(F.col("holds"), F.struct("name", "line", "kind")), ignorenulls=True).over(before)
    parents = each.withColumn("parent", holder).where("NOT holds")
    return parents.select(*_FILE, "kind", "name", "line", "end_line", "depth", F.when(F.col("depth") > 0, F.col("parent.name")).alias("parent"), F.when(F.col("depth") > 0, F.col("parent.line")).alias("parent_line"), F.when(F.col("depth") > 0, F.col("parent.kind")).alias("parent_kind"))


def containment(found: DataFrame) -> DataFrame:
    """(repo_id, path, type, src, src_line, dst, dst_line): CLASS_CONTAINS from types to what is right inside, NESTS from functions to it, FILE_CONTAINS to the rest."""
    n = nested(found)
    kind = F.when(F.col("parent").isNull(), "FILE_CONTAINS").when(F.col("parent_kind") == "Function", "NESTS").otherwise("CLASS_CONTAINS")
    return n.select(*_FILE, kind.alias("type"), F.coalesce("parent", "path").alias("src"), F.coalesce("parent_line", F.lit(0)).alias("src_line"), F.col("name").alias("dst"), F.col("line").alias("dst_line"))
