"""YAML files as a table of key paths and values, and what workflow files say.

Lines become nodes with a level by their column; a node's ancestors are, for each smaller level, the last node before it that
is not deeper. One pass over a file's nodes finds them all, where the file lies.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Columns of indentation that are followed; deeper nodes are given with kind too_deep and the keys above that.
COLUMNS = 32
#: A node's level is twice its column, and one more for a list's item, which may stand in its key's own column.
_LEVELS = 2 * COLUMNS
_KEY = r"""^("[^"]*"|'[^']*'|[^\s#\[\]{},"'&*!|>%@][^#]*?)\s*:(?:\s+(.*))?$"""
_LIST = "[]"
#: A flow on one line, and a comma that isn't inside a bracket of one; flows are taken apart to this depth.
_FLOW_LIST, _FLOW_PAIRS, _FLOWS = r"^\[.*\]\s*(?:#.*)?$", r"^\{.*\}\s*(?:#.*)?$", 3
_PLAIN = r"[^\[\]{}]*+"
_CLOSED = reduce(lambda inner, _: rf"{_PLAIN}(?:[\[{{]{inner}[\]}}]{_PLAIN})*+", range(_FLOWS), _PLAIN)
_COMMA = rf"\s*,(?!{_CLOSED}[\]}}])\s*"


def _unquoted(c: Column) -> Column:
    quoted = F.regexp_extract(c, r"""^(?:"([^"]*)"|'([^']*)')""", 0)
    return F.when(quoted != "", F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(F.regexp_replace(c, r"\s+#.*$|^#.*$", ""))


def _let(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c) with c computed once, however often it is named."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


_NODE = "struct<document:int,line:int,part:int,raw:string,comment:boolean,level:int,key:string,value:string,header:boolean,cut:boolean>"
_FOUND = f"struct<n:{_NODE},up:array<{_NODE}>,block:array<string>>"
#: Nodes that are folded at a time, so a long file's results aren't copied for each of its nodes.
_BLOCK = 256


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _nodes(content: Column) -> Column:
    """The nodes of a file's lines as an array of _NODE, items of lists before what they hold; a line that begins a document is a node with cut."""
    found = F.filter(F.transform(F.split(content, "\r?\n"), lambda raw, i: F.struct((i + 1).alias("line"), raw.alias("raw"))), lambda x: F.trim(x["raw"]) != "")
    found = F.transform(found, lambda x: F.struct(
        x["line"].alias("line"), x["raw"].alias("raw"), F.rlike(x["raw"], F.lit(r"^---(?:\s|$)")).alias("cut"),
        F.length(F.regexp_extract(x["raw"], r"^( *)", 1)).alias("indent"), F.regexp_extract(x["raw"], r"^ *(.*?)\s*$", 1).alias("body"),
    ))
    found = F.filter(found, lambda x: x["cut"] | ~F.rlike(x["raw"], F.lit(r"^\.\.\.\s*$|^%")))
    found = F.transform(found, lambda x: F.struct(x.alias("l"), F.regexp_extract(x["body"], r"^((?:-(?: +|$))*)", 1).alias("dashes")))
    found = F.transform(found, lambda x: F.struct(x["l"].alias("l"), x["dashes"].alias("dashes"), F.substring(x["l"]["body"], F.length(x["dashes"]) + 1, F.length(x["l"]["body"])).alias("rest")))
    found = F.transform(found, lambda x: F.struct(x["l"].alias("l"), x["dashes"].alias("dashes"), x["rest"].alias("rest"), F.regexp_extract(x["rest"], _KEY, 1).alias("key")))

    def node(x: Column, part: Column, level: Column, key: Column, value: Column, cut: bool = False) -> Column:
        header = F.rlike(F.coalesce(value, F.lit("")), F.lit(r"^[|>][-+0-9]*\s*(?:#.*)?$"))
        return F.struct(F.lit(0), x["l"]["line"], part, x["l"]["raw"], F.startswith(x["l"]["body"], F.lit("#")), level, key, value, header, F.lit(cut)).cast(_NODE)

    def each(x: Column) -> Column:
        none = F.lit(None).cast("string")
        columns = F.filter(F.sequence(F.lit(0), F.greatest(F.length(x["dashes"]) - 1, F.lit(0))), lambda i: F.substring(x["dashes"], i + 1, F.lit(1)) == "-")
        items = F.transform(columns, lambda i, part: node(x, part, 2 * (x["l"]["indent"] + i) + 1, F.lit(_LIST), none))
        said = F.when(x["key"] != "", F.coalesce(F.regexp_extract(x["rest"], _KEY, 2), F.lit(""))).otherwise(x["rest"])
        held = _let(said, lambda v: node(x, F.size(columns), 2 * (x["l"]["indent"] + F.length(x["dashes"])), F.when(x["key"] != "", _unquoted(x["key"])), v))
        return F.when(x["l"]["cut"], F.array(node(x, F.lit(0), F.lit(-1), none, none, True))).when(x["rest"] == "", items).otherwise(F.concat(items, F.array(held)))

    return F.flatten(F.transform(found, each))


def _folded(nodes: Column, state: Column, kind: str, out: str, step: Callable[[Column, Column], Column]) -> Column:
    """The array of out that step makes of (state, found) and each node, in blocks."""
    whole = f"struct<state:{kind},found:array<{out}>>"
    parts = f"struct<state:{kind},found:array<array<{out}>>>"

    def block(all_: Column, acc: Column, i: Column) -> Column:
        own = F.aggregate(F.slice(all_, i * _BLOCK + 1, F.lit(_BLOCK)), F.struct(acc["state"], _empty(out)).cast(whole), lambda a, n: step(a, n).cast(whole))
        return _let(own, lambda r: F.struct(r["state"], F.concat(acc["found"], F.array(r["found"]))).cast(parts))

    def over(all_: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / _BLOCK).cast("int"))
        return F.aggregate(blocks, F.struct(state, F.array().cast(f"array<array<{out}>>")).cast(parts), lambda acc, i: block(all_, acc, i))["found"]

    return F.flatten(_let(nodes, over))


def _placed(nodes: Column) -> Column:
    """Each node with its document and the nodes that hold it, outermost first; what stands below a block's head is given with the head, as its lines."""
    kind = f"struct<document:int,stack:array<{_NODE}>>"

    def step(acc: Column, n: Column) -> Column:
        document = acc["state"]["document"] + n["cut"].cast("int")
        placed = n.withField("document", document)
        held = F.filter(acc["state"]["stack"], lambda a: a["level"] < n["level"])
        stack = F.when(n["cut"], _empty(_NODE)).when(n["comment"], acc["state"]["stack"]).otherwise(F.concat(held, F.array(placed)))
        one = F.struct(placed, F.filter(acc["state"]["stack"], lambda a: a["level"] < F.least(n["level"], F.lit(_LEVELS))), _empty("string")).cast(_FOUND)
        return F.struct(F.struct(document, stack).cast(kind), F.when(n["cut"], acc["found"]).otherwise(F.concat(acc["found"], F.array(one))))

    # Backwards, the lines of a block come before its head.
    def text(acc: Column, x: Column) -> Column:
        inside = F.exists(x["up"], lambda a: a["header"])
        lines = F.when(inside & (x["n"]["part"] == 0), F.concat(acc["state"]["found"], F.array(F.array(x["n"]["raw"])))).otherwise(acc["state"]["found"])
        real, head = ~inside & ~x["n"]["comment"], x["n"]["header"]
        one = F.when(head, x.withField("block", F.reverse(F.flatten(acc["state"]["found"])))).otherwise(x)
        return F.struct(F.struct(F.when(real & head, F.array().cast("array<array<string>>")).otherwise(lines)), F.when(real, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]))

    placed = _folded(nodes, F.struct(F.lit(0), _empty(_NODE)).cast(kind), kind, _FOUND, step)
    return _folded(F.reverse(placed), F.struct(F.array().cast("array<array<string>>")), "struct<found:array<array<string>>>", _FOUND, text)


def paths(files: DataFrame) -> DataFrame:
    """(repo_id, path, document, line, keys, items, value, kind) of the nodes of YAML files (repo_id, path, content).

    keys are the names from the document's root, [] for an item of a list; items are the lines of those items. kind: scalar, block
    (value: its lines without the first one's indentation and without blank lines), map (no value of its own), alias, anchor (value: what follows), open (a flow that
    goes on in the next line) or too_deep. Flows of one line are taken apart
    into scalars, with their place in `items`; what lies deeper in them than three flows is too_deep, with its text. Comments, blank
    lines and null contents give no rows; what is no YAML gives scalars without keys. Each file is read where it lies, by one pass over
    its nodes with the nodes that hold the next one; nothing of it is sorted or joined.
    """
    own = spread(files.where(F.col("content").isNotNull()).select("repo_id", "path", "content"), "repo_id", "path")
    found = own.select("repo_id", "path", F.inline(_placed(_nodes(F.col("content"))))).select("repo_id", "path", "n.*", "up", "block")
    first = F.length(F.regexp_extract(F.get("block", F.lit(0)), r"^( *)", 1))
    block = F.array_join(F.transform("block", lambda x: F.substring(x, first + 1, F.length(x))), "\n")
    named = F.when(F.col("key").isNotNull(), F.array("key")).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.transform("up", lambda a: a["key"]), named)
    items = F.concat(F.transform(F.filter("up", lambda a: a["key"] == _LIST), lambda a: a["line"]), F.when(F.col("key") == _LIST, F.array("line")).otherwise(F.array().cast("array<int>")))
    v = F.trim(F.coalesce("value", F.lit("")))
    kind = (
        F.when(F.col("level") >= _LEVELS, "too_deep").when(F.col("header"), "block").when(F.rlike(v, F.lit(r"^[*]\S+")), "alias").when(F.rlike(v, F.lit(r"^&\S+")), "anchor")
        .when(F.rlike(v, F.lit(_FLOW_LIST)), "list").when(F.rlike(v, F.lit(_FLOW_PAIRS)), "pairs").when(F.rlike(v, F.lit(r"^[\[{]")) & ~F.rlike(v, F.lit(r"[\]}]\s*(?:#.*)?$")), "open")
        .when((v == "") | F.rlike(v, F.lit("^#")), "map").otherwise("scalar")
    )
    value = F.when(kind == "block", F.coalesce(block, F.lit(""))).when(kind == "anchor", F.regexp_replace(v, r"^&\S+\s*", "")).when(kind == "map", F.lit(None).cast("string")).otherwise(_unquoted(v))
    flow = "struct<keys:array<string>,items:array<int>,value:string,kind:string,flow:string>"
    rows = F.array(F.struct(keys, items, value, kind, v).cast(flow))
    for _ in range(_FLOWS):
        rows = F.flatten(F.transform(rows, lambda x: F.when(x["kind"].isin("list", "pairs"), _unfolded(x, flow)).otherwise(F.array(x))))
    over = F.transform(rows, lambda x: F.when(x["kind"].isin("list", "pairs"), x.withField("value", x["flow"]).withField("kind", F.lit("too_deep"))).otherwise(x))
    return found.select("repo_id", "path", "document", "line", F.inline(over)).select("repo_id", "path", "document", "line", "keys", "items", "value", "kind")


def _unfolded(flow: Column, type_: str) -> Column:
    """What stands in a flow, as an array; those that are flows again have kind list or pairs."""
    pair = flow["kind"] == "pairs"
    inside = F.filter(F.split(F.regexp_extract(flow["flow"], r"^[\[{](.*)[\]}]", 1), _COMMA), lambda x: F.trim(x) != "")

    def each(x: Column, nth: Column) -> Column:
        own = F.when(pair, _unquoted(F.trim(F.regexp_extract(x, r"^(.*?)\s*:(?:\s|$)", 1)))).otherwise(F.lit(_LIST))
        text = F.trim(F.when(pair, F.coalesce(F.regexp_extract(x, r":(?:\s+(.*))?$", 1), F.lit(""))).otherwise(x))
        items = F.when(pair, flow["items"]).otherwise(F.concat(flow["items"], F.array(nth)))
        kind = lambda said: F.when(F.rlike(said, F.lit(_FLOW_LIST)), "list").when(F.rlike(said, F.lit(_FLOW_PAIRS)), "pairs").otherwise("scalar")
        return _let(text, lambda said: F.struct(F.concat(flow["keys"], F.array(own)), items, _unquoted(said), kind(said), said).cast(type_))

    return F.transform(inside, each)


def _at(*keys: str | None) -> Column:
    """The node's keys are these, null standing for any one."""
    return (F.size("keys") == len(keys)) & F.forall(F.zip_with("keys", F.array(*[F.lit(k) for k in keys]), lambda a, b: b.isNull() | (a == b)), lambda x: x)


def workflow_artifacts(found: DataFrame) -> DataFrame:
    """(repo_id, path, kind, job, value) of workflow files, from their paths: triggers, inputs, jobs' needs, conditions, environments, actions, reusable workflows, checkouts, commands, permissions, timeouts and matrix keys."""
    flow = found.where(F.rlike("path", F.lit(r"(?:^|/)\.github/workflows/[^/]+\.ya?ml$")))
    k = lambda i: F.get("keys", F.lit(i))
    job = F.when(k(0) == "jobs", k(1))
    uses = F.regexp_replace("value", "@.*$", "")
    action = F.regexp_extract("value", r"^([\w.-]+/[\w.-]+)[^@]*@", 1)
    local = F.startswith("value", F.lit("./"))
    kinds = (
        ("trigger", _at("on") & F.col("value").isNotNull(), F.col("value")), ("trigger", _at("on", "[]") & F.col("value").isNotNull(), F.col("value")), ("trigger", _at("on", None) & (k(1) != "[]"), k(1)),
        ("input", (k(0) == "on") & k(1).isin("workflow_dispatch", "workflow_call") & (k(2) == "inputs") & (F.size("keys") > 3), k(3)),
        ("needs", (_at("jobs", None, "needs") | _at("jobs", None, "needs", "[]")) & F.col("value").isNotNull(), F.col("value")),
        ("condition", _at("jobs", None, "if") | _at("jobs", None, "steps", "[]", "if"), F.col("value")),
        ("environment", (_at("jobs", None, "environment") | _at("jobs", None, "environment", "name")) & F.col("value").isNotNull(), F.col("value")),
        ("action", _at("jobs", None, "steps", "[]", "uses") & (action != ""), action),
        ("reusable_workflow", _at("jobs", None, "uses") & ~local & (action != ""), action), ("local_workflow", _at("jobs", None, "uses") & local, uses),
        ("checkout", _at("jobs", None, "steps", "[]", "with", "repository"), F.col("value")),
        ("run", _at("jobs", None, "steps", "[]", "run") & F.col("value").isNotNull(), F.trim("value")),
        ("permission", _at("permissions", None), F.concat_ws(":", k(1), "value")), ("permission", _at("jobs", None, "permissions", None), F.concat_ws(":", k(3), "value")), ("permission", _at("permissions") & F.col("value").isNotNull(), F.col("value")),
        ("concurrency", (_at("concurrency") | _at("concurrency", "group")) & F.col("value").isNotNull(), F.col("value")),
        ("timeout", _at("jobs", None, "timeout-minutes"), F.col("value")),
        ("matrix", _at("jobs", None, "strategy", "matrix", None) & ~k(4).isin("include", "exclude"), k(4)), ("matrix", _at("jobs", None, "strategy", "matrix", None, "[]") & ~k(4).isin("include", "exclude"), k(4)),
    )
    rows = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("kind"), v.alias("value"))) for n, c, v in kinds]), F.isnotnull)
    return flow.select("repo_id", "path", job.alias("job"), F.inline(rows)).distinct().select("repo_id", "path", "kind", "job", "value")


def matrix_sizes(found: DataFrame) -> DataFrame:
    """(repo_id, path, job, combinations): the product of the lengths of a job's matrix lists."""
    each = found.where(_at("jobs", None, "strategy", "matrix", None, "[]") & ~F.get("keys", F.lit(4)).isin("include", "exclude"))
    lists = each.groupBy("repo_id", "path", F.get("keys", F.lit(1)).alias("job"), F.get("keys", F.lit(4)).alias("key")).agg(F.count_distinct("items").alias("n"))
    return lists.groupBy("repo_id", "path", "job").agg(F.round(F.product("n")).cast("long").alias("combinations"))
