"""Column lineage of SELECT texts over common table expressions, subqueries and unions.

Each text is taken apart where it lies: brackets are cut out from the innermost outwards, each leaving a mark, until the
text is flat and commas and keywords split it. What is left are tables of queries, relations and projections of all texts.
These are resolved level by level, a query after those that it reads, by joins of references with the columns known so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread

#: Brackets inside brackets, and queries over queries, that are followed; what lies deeper is reported.
DEPTH = 48
#: Marks of brackets: queries (q) and others (a), with round and number.
_OPEN, _CLOSE = "\ue000", "\ue001"
_Q, _A = f"{_OPEN}q[0-9.]+{_CLOSE}", f"{_OPEN}a[0-9.]+{_CLOSE}"
_PIECES = "array<struct<mark:string,body:string>>"

# Words of an expression that name no column.
WORDS = (
    "all and any as asc between both by case cast collate count cross current current_date current_timestamp date day desc distinct else end escape except exists "
    "false fetch filter first following from full group having hour ilike in inner intersect interval into is isnull join last lateral leading left like limit minute month "
    "natural not notnull null nulls offset on or order outer over partition preceding qualify quarter range recursive right rlike row rows second select set similar some "
    "symmetric then ties time timestamp to trailing true unbounded union unknown using values week when where window with within year"
).split()
AGGREGATES = ("any_value", "array_agg", "avg", "count", "listagg", "max", "median", "min", "stddev", "string_agg", "sum", "variance")


def _flat(sql: Column) -> Column:
    """Without comments, what literals hold, quotes of names, and line breaks."""
    bare = F.regexp_replace(sql, r"(?s)('(?:[^'\\]|\\.|'')*')|--[^\n]*|/\*.*?\*/", "$1")
    bare = F.regexp_replace(bare, r"(?s)'(?:[^'\\]|\\.|'')*'", "''")
    bare = F.regexp_replace(bare, r"[;\"`\x{e000}\x{e001}]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def _cut_out(sql: Column) -> Column:
    """(text, pieces): the text with marks in place of its outermost brackets, and what stood in each bracket, inner ones first."""
    kind = f"struct<text:string,pieces:{_PIECES}>"

    def mark(body: Column, turn: Column, i: Column) -> Column:
        query = F.rlike(body, F.lit(rf"(?i)^\s*(?:select\b|with\b|{_Q}\s*(?:$|union\b|intersect\b|except\b))"))
        return F.concat(F.lit(_OPEN), F.when(query, "q").otherwise("a"), turn.cast("string"), F.lit("."), i.cast("string"), F.lit(_CLOSE))

    def step(acc: Column, turn: Column) -> Column:
        found = F.regexp_extract_all(acc["text"], F.lit(r"\(([^()]*)\)"), F.lit(1))
        between = F.split(acc["text"], r"\([^()]*\)", -1)
        text = F.array_join(F.transform(between, lambda p, i: F.when(i < F.size(found), F.concat(p, mark(F.get(found, i), turn, i))).otherwise(p)), "")
        pieces = F.concat(acc["pieces"], F.transform(found, lambda b, i: F.struct(mark(b, turn, i).alias("mark"), F.trim(b).alias("body"))))
        return F.when(~F.contains(acc["text"], F.lit("(")), acc).otherwise(F.struct(text.alias("text"), pieces.alias("pieces"))).cast(kind)

    start = F.struct(sql.alias("text"), F.array().cast(_PIECES).alias("pieces")).cast(kind)
    return F.aggregate(F.sequence(F.lit(0), F.lit(DEPTH - 1)), start, step)


def _filled(text: Column, pieces: Column) -> Column:
    """text with what its marks of no query stand for, in brackets."""
    return F.aggregate(F.reverse(F.filter(pieces, lambda p: F.startswith(F.substring(p["mark"], 2, 1), F.lit("a")))), text, lambda t, p: F.replace(t, p["mark"], F.concat(F.lit("("), p["body"], F.lit(")"))))


def _queries(models: DataFrame, model: str, sql: str) -> DataFrame:
    """(model, pieces, query, body, scope, level) of the queries of each text: scope lists a query and those around it, level is 0 for those that read tables only."""
    # Each step is written: the optimizer would move a step's expression into the lambdas of the next and have it computed for each element.
    texts = spread(models.where(F.col(sql).isNotNull()).select(F.col(model).alias("model"), F.col(sql).alias("sql")), "model")
    cutout = cut(texts.select("model", _cut_out(_flat(F.col("sql"))).alias("c")))
    root = F.array(F.struct(F.lit("").alias("mark"), F.col("c.text").alias("body")))
    is_query = lambda p: F.startswith(p["mark"], F.lit(f"{_OPEN}q"))
    rows = cutout.select("model", F.col("c.pieces").alias("pieces"), F.concat(root, F.filter("c.pieces", is_query)).alias("queries"))
    own = F.transform("queries", lambda q: F.struct(q["mark"].alias("mark"), q["body"].alias("body"), F.regexp_extract_all(_filled(q["body"], F.col("pieces")), F.lit(f"({_Q})"), F.lit(1)).alias("inner")))
    rows = cut(rows.withColumn("queries", own))
    # A mark occurs once, so each query but the root has one parent.
    parents = F.map_from_entries(F.flatten(F.transform("queries", lambda q: F.transform(q["inner"], lambda i: F.struct(i.alias("key"), q["mark"].alias("value"))))))
    names = F.flatten(F.transform("queries", lambda q: F.transform(
        F.regexp_extract_all(q["body"], F.lit(rf"(?i)(?:^with|,) *(?:recursive +)?(\w+ *(?:{_A})? *as +(?:(?:not +)?materialized +)?{_Q})"), F.lit(1)),
        lambda c: F.struct(F.lower(F.regexp_extract(c, r"^(\w+)", 1)).alias("name"), F.regexp_extract(c, f"({_A})", 1).alias("columns"), F.regexp_extract(c, f"({_Q})", 1).alias("mark"), q["mark"].alias("at")),
    )))
    rows = cut(rows.withColumns({"parents": parents, "ctes": names}))

    # No query is around itself or reads itself, so no text has more steps than queries.
    rounds = F.least(F.size("queries"), F.lit(DEPTH))

    def scope(mark: Column) -> Column:
        up = lambda s, _: F.when(F.element_at(s, -1) == "", s).otherwise(F.concat(s, F.array(F.coalesce(F.try_element_at("parents", F.element_at(s, -1)), F.lit("")))))
        return F.aggregate(F.sequence(F.lit(1), rounds), F.array(mark), up)

    rows = cut(rows.withColumn("queries", F.transform("queries", lambda q: F.struct(q["mark"].alias("mark"), q["body"].alias("body"), scope(q["mark"]).alias("scope"), q["inner"].alias("inner")))))

    def reads(q: Column) -> Column:
        """Marks inside the query, and those of the names in its FROM clauses that mean a query here."""
        said = F.transform(F.regexp_extract_all(q["body"], F.lit(r"(?i)(?:\bfrom|\bjoin|,) +(\w+)\b(?! *\.)"), F.lit(1)), F.lower)
        return F.array_distinct(F.concat(q["inner"], F.filter(F.transform(said, lambda n: _meant(F.col("ctes"), n, q["scope"])["mark"]), F.isnotnull)))

    rows = cut(rows.withColumn("queries", F.transform("queries", lambda q: F.struct(q["mark"].alias("mark"), q["body"].alias("body"), q["scope"].alias("scope"), reads(q).alias("reads")))))
    kind = "array<struct<mark:string,level:int>>"

    def next_level(done: Column, k: Column) -> Column:
        marks = F.transform(done, lambda d: d["mark"])
        ready = F.filter("queries", lambda q: ~F.array_contains(marks, q["mark"]) & (F.size(F.array_except(q["reads"], marks)) == 0))
        return F.concat(done, F.transform(ready, lambda q: F.struct(q["mark"].alias("mark"), k.alias("level")))).cast(kind)

    levels = F.aggregate(F.sequence(F.lit(0), rounds - 1), F.array().cast(kind), next_level)
    rows = cut(rows.withColumn("levels", F.map_from_entries(levels)))
    each = rows.select("model", "pieces", "ctes", "levels", F.explode("queries").alias("q"))
    return each.select("model", "pieces", "ctes", F.col("q.mark").alias("query"), "q.body", "q.scope", F.try_element_at("levels", F.col("q.mark")).alias("level"))


def _meant(ctes: Column, name: Column, scope: Column) -> Column:
    """The common table expression that a name means in a scope: of the nearest query around that defines it."""
    fits = F.filter(ctes, lambda c: (c["name"] == name) & F.array_contains(scope, c["at"]))
    return F.get(F.array_sort(F.transform(fits, lambda c: F.struct(F.array_position(scope, c["at"]).alias("near"), c["mark"].alias("mark"), c["columns"].alias("columns")))), F.lit(0))


_SET = r"(?i)\b(?:union|intersect|except|minus)\b(?: +(?:all|distinct)\b)?"
_STOP = r"(?i) +(?:where|group +by|having|order +by|limit|qualify|window|offset|fetch)\b.*$"
_NO_ALIAS = "on|using|where|group|order|limit|left|right|inner|full|cross|natural|join|tablesample|having|qualify|window|union|as"


def _branches(queries: DataFrame) -> DataFrame:
    """A row for each SELECT of a query: (model, query, level, scope, branch, projection, source) and what looks names up."""
    main = F.regexp_replace("body", rf"(?i)^with +(?:recursive +)?(?:\w+ *(?:{_A})? *as +(?:(?:not +)?materialized +)?{_Q} *,? *)+", "")
    each = queries.select("model", "query", "level", "scope", "pieces", "ctes", F.posexplode(F.split(main, _SET)).alias("branch", "text")).withColumn("text", F.trim("text"))
    # A branch that is a query in brackets stands for all its columns.
    alone = F.rlike("text", F.lit(f"^{_Q}$"))
    each = each.withColumn("text", F.when(alone, F.concat(F.lit("select * from "), "text")).otherwise(F.col("text")))
    select = rf"(?i)^select +(?:distinct +(?:on *{_A} *)?|all +)?(.*?)(?: +from +(.*))?$"
    source = F.regexp_replace(F.concat(F.lit(" "), F.regexp_extract("text", select, 2)), _STOP, "")
    list_ = F.regexp_replace(F.regexp_extract("text", select, 1), _STOP, "")
    return each.select("model", "query", "level", "scope", "branch", "pieces", "ctes", list_.alias("projection"), source.alias("source"))


def _relations(branches: DataFrame) -> DataFrame:
    """(model, query, branch, alias, target, owner): what each SELECT reads; owner is the model for a query of its text, empty for a table."""
    items = F.split("source", r"(?i),|\b(?:(?:natural|left|right|full|inner|outer|cross|semi|anti|lateral) +)*join\b")
    each = branches.select("model", "query", "branch", "scope", "ctes", F.posexplode(items).alias("nth", "item")).withColumn("item", F.trim("item"))
    head = rf"^(?:lateral +|only +)?({_Q}|[\w.$]+)"
    named = F.regexp_extract("item", head, 1)
    alias = F.lower(F.regexp_extract("item", rf"(?i)^(?:lateral +|only +)?(?:{_Q}|[\w.$]+) *(?:as +)?(?!(?:{_NO_ALIAS})\b)(\w+)", 1))
    each = each.select("model", "query", "branch", "nth", named.alias("named"), alias.alias("said"), _meant(F.col("ctes"), F.lower(named), F.col("scope")).alias("cte")).where("named <> ''")
    own = F.startswith("named", F.lit(_OPEN))
    target = F.when(own, F.col("named")).otherwise(F.coalesce("cte.mark", F.col("named")))
    short = F.lower(F.substring_index("named", ".", -1))
    return each.select(
        "model", "query", "branch", "nth", target.alias("target"), F.when(own | F.col("cte.mark").isNotNull(), F.col("model")).otherwise(F.lit("")).alias("owner"),
        # A table may be meant by its whole name too.
        F.explode(F.array_distinct(F.array(F.when(F.col("said") != "", F.col("said")).otherwise(short), F.when(own, F.col("said")).otherwise(F.lower("named"))))).alias("alias"),
    )


def _projections(branches: DataFrame) -> DataFrame:
    """(model, query, level, scope, branch, position, output, expression, kind, transform, refs) of each item that a SELECT lists."""
    each = branches.where("projection <> ''").select("model", "query", "level", "scope", "branch", "pieces", F.posexplode(F.split("projection", ",")).alias("position", "item")).withColumn("item", F.trim("item"))
    said = r"(?i)^(.*\S) +as +(\w+)$"
    # A last word that follows an operand is a name too.
    short = rf"(?i)^(.*[\w'{_CLOSE}])(?<!\b(?:and|or|not|is|in|like|between|then|else|when|case|by|from|distinct|over|filter))(?: +|(?<={_CLOSE}))(?!(?:end|null|true|false)$)([a-z_]\w*)$"
    output = F.coalesce(F.nullif(F.regexp_extract("item", said, 2), F.lit("")), F.nullif(F.regexp_extract("item", short, 2), F.lit("")))
    expr = F.coalesce(F.nullif(F.regexp_extract("item", said, 1), F.lit("")), F.nullif(F.regexp_extract("item", short, 1), F.lit("")), F.col("item"))
    each = each.select("model", "query", "level", "scope", "branch", "position", output.alias("output"), F.trim(expr).alias("expr"), "pieces")
    # An expression in brackets of its own is what is in them.
    for _ in range(2):
        each = each.withColumn("expr", F.when(F.rlike("expr", F.lit(f"^{_A}$")), F.try_element_at(F.filter("pieces", lambda p: p["mark"] == F.col("expr")), F.lit(1))["body"]).otherwise(F.col("expr")))
    e = F.col("expr")
    call = F.lower(F.regexp_extract(e, rf"^([\w.]+) ?{_A}$", 1))
    window = F.lower(F.regexp_extract(e, rf"(?i)^(\w+) ?{_A}(?: +filter ?{_A})? +over +(?:{_A}|\w+)$", 1))
    over = F.lower(F.regexp_extract(e, rf"(?i)^(\w+) ?{_A} ?over ?(?:{_A}|\w+)$", 1))
    window = F.coalesce(F.nullif(window, F.lit("")), F.nullif(over, F.lit("")))
    kind = (
        F.when(F.rlike(e, F.lit(r"^(?:[\w.]+\.)?\*$")), "star").when(window.isNotNull(), "window").when(F.rlike(e, F.lit(r"(?i)^cast ?\W|::")), "cast")
        .when(F.rlike(e, F.lit(r"(?i)^case\b.*\bend$")), "case").when(F.rlike(e, F.lit(f"^{_Q}$")), "subquery").when(call.isin(*AGGREGATES), "aggregate").when(call != "", "function")
        .when(F.rlike(e, F.lit(r"^(?:''|[-+]?[\d.]+|(?i:true|false|null))$")), "literal").when(F.rlike(e, F.lit(r"^[A-Za-z_][\w.]*$")), "direct").otherwise("arithmetic")
    )
    transform = F.when(kind == "window", F.concat(F.lit("window_"), window)).when(kind.isin("cast", "case"), kind).when(call != "", call)
    whole = _filled(e, F.col("pieces"))
    # Types, units and names of windows are no columns.
    bare = F.regexp_replace(whole, r"(?i)\bas +[\w ]+(?:\([\d, ]*\))?(?=\s*\))|::\s*\w+|\bextract\s*\(\s*\w+\s+from\b|\bover\s+\w+|''", " ")
    qualified = F.transform(F.regexp_extract_all(bare, F.lit(r"(?<![\w.\x{e000}])((?:[A-Za-z_]\w*\.)+(?:\w+|\*))(?!\s*\()"), F.lit(1)), lambda r: F.struct(F.lower(F.regexp_extract(r, r"^(.*)\.", 1)).alias("alias"), F.substring_index(r, ".", -1).alias("name")))
    single = F.filter(F.regexp_extract_all(bare, F.lit(r"(?<![\w.\x{e000}])([A-Za-z_]\w*+)(?!\s*[(.\x{e001}])"), F.lit(1)), lambda w: ~F.lower(w).isin(*WORDS))
    inner = F.transform(F.regexp_extract_all(whole, F.lit(f"({_Q})"), F.lit(1)), lambda m: F.struct(m.alias("alias"), F.lit("*").alias("name")))
    refs = F.concat(qualified, F.transform(single, lambda w: F.struct(F.lit("").alias("alias"), w.alias("name"))), inner)
    refs = F.when(e == "*", F.array(F.struct(F.lit("").alias("alias"), F.lit("*").alias("name")))).otherwise(F.array_distinct(refs)).cast("array<struct<alias:string,name:string>>")
    return each.select("model", "query", "level", "scope", "branch", "position", "output", whole.alias("expression"), kind.alias("kind"), transform.alias("transform"), refs.alias("refs"))


def _renamed(queries: DataFrame) -> DataFrame:
    """(model, query, place, column): names that a common table expression gives the columns of its query."""
    body = lambda c: F.try_element_at(F.filter("pieces", lambda p: p["mark"] == c["columns"]), F.lit(1))["body"]
    named = queries.where("query = ''").select("model", F.explode(F.filter(F.transform("ctes", lambda c: F.struct(c["mark"].alias("mark"), body(c).alias("names"))), lambda c: c["names"].isNotNull())).alias("c"))
    return named.select("model", F.col("c.mark").alias("query"), F.posexplode(F.split("c.names", r"\s*,\s*")).alias("place", "column")).withColumn("place", F.col("place") + 1)


def _resolve(items: DataFrame, relations: DataFrame, known: DataFrame) -> DataFrame:
    """References of one level's items with the columns that they mean: one row for each item, reference and column found, or with a reason."""
    refs = items.select("model", "query", "branch", "position", "output", "expression", "kind", "transform", "scope", F.posexplode_outer("refs").alias("ref", "r"))
    refs = refs.select("*", F.coalesce("r.alias", F.lit("")).alias("ref_alias"), F.col("r.name").alias("ref_name")).drop("r")
    inner = F.startswith("ref_alias", F.lit(_OPEN))
    own = refs.where(inner).select("*", F.col("ref_alias").alias("target"), F.col("model").alias("owner"), F.lit(0).alias("nth"))
    # By alias: in the SELECT itself, else in the nearest query around it.
    rel = relations.select(F.col("model").alias("r_model"), F.col("query").alias("r_query"), F.col("branch").alias("r_branch"), "alias", "target", "owner", "nth")
    around = refs.where(~inner & (F.col("ref_alias") != "")).select("*", F.posexplode("scope").alias("far", "at"))
    met = around.join(rel, (F.col("model") == F.col("r_model")) & (F.col("at") == F.col("r_query")) & (F.col("ref_alias") == F.col("alias")) & ((F.col("far") > 0) | (F.col("branch") == F.col("r_branch"))), "left")
    place = ["model", "query", "branch", "position", "ref"]
    nearest = met.withColumn("k", F.row_number().over(Window.partitionBy(*place).orderBy(F.col("target").isNull(), "far", "nth"))).where("k = 1")
    aliased = nearest.select(*refs.columns, "target", "owner", "nth")
    # Without an alias: every relation of the SELECT may have the column.
    once = rel.groupBy("r_model", "r_query", "r_branch", "nth").agg(F.min("target").alias("target"), F.min("owner").alias("owner"))
    loose = refs.where(~inner & (F.col("ref_alias") == "")).join(once, (F.col("model") == F.col("r_model")) & (F.col("query") == F.col("r_query")) & (F.col("branch") == F.col("r_branch")), "left").select(*refs.columns, "target", "owner", "nth")
    bound = own.unionByName(aliased).unionByName(loose)
    k = known.select(F.col("owner").alias("k_owner"), F.col("target").alias("k_target"), F.col("column").alias("k_column"), "place", "sources", F.col("kind").alias("k_kind"), F.col("transform").alias("k_transform"))
    there = (F.col("owner") == F.col("k_owner")) & (F.col("target") == F.col("k_target"))
    named = bound.where("ref_name <> '*'").join(k, there & (F.lower("ref_name") == F.lower("k_column")), "left")
    stars = bound.where("ref_name = '*'").join(k, there, "left")
    none = bound.where("ref_name IS NULL").select("*", *(F.lit(None).cast(t).alias(c) for c, t in k.dtypes))
    found = named.unionByName(stars).unionByName(none)
    # A column of a table that is named by its alias needs no catalogue.
    plain = (F.col("owner") == "") & (F.col("ref_alias") != "") & (F.col("ref_name") != "*") & F.col("sources").isNull()
    return found.withColumn("sources", F.when(plain, F.array(F.concat("target", F.lit("."), "ref_name"))).otherwise(F.col("sources")))


def _gap(found: DataFrame) -> DataFrame:
    """(model, query, expression, reference, reason) of the references of a level that mean no column, or several."""
    name = F.when(F.col("ref_alias") == "", F.col("ref_name")).otherwise(F.concat("ref_alias", F.lit("."), "ref_name"))
    by = found.where("ref_name IS NOT NULL").groupBy("model", "query", "branch", "position", "ref").agg(
        F.first("expression").alias("expression"), F.first(name).alias("reference"), F.first("ref_alias").alias("ref_alias"), F.first("ref_name").alias("ref_name"), F.max("owner").alias("owner"),
        F.count("target").alias("targets"), F.count_distinct("sources").alias("meanings"), F.count_distinct(F.when(F.col("sources").isNotNull(), F.col("nth"))).alias("from_"),
        F.count_distinct("nth").alias("relations"),
    )
    reason = (
        F.when((F.col("ref_alias") != "") & (F.col("targets") == 0), "source_alias_not_resolved")
        .when((F.col("ref_name") == "*") & (F.col("from_") < F.greatest("relations", F.lit(1))), "wildcard_projection_not_supported")
        .when((F.col("ref_name") != "*") & (F.col("ref_alias") == "") & (F.col("meanings") == 0), "unqualified_column_reference_not_resolved")
        .when((F.col("ref_name") != "*") & (F.col("ref_alias") == "") & (F.col("meanings") > 1), "unqualified_column_reference_ambiguous")
        .when((F.col("ref_name") != "*") & (F.col("meanings") == 0), "cte_column_not_resolved")
    )
    return by.select("model", "query", "branch", "position", "ref", "expression", "reference", reason.alias("reason")).where("reason IS NOT NULL")


def _outputs(found: DataFrame, gaps: DataFrame, renamed: DataFrame) -> DataFrame:
    """(owner, target, column, place, sources, kind, transform) of the queries of a level; branches of a union are put together by place."""
    place = ["model", "query", "branch", "position"]
    ambiguous = gaps.where("reason = 'unqualified_column_reference_ambiguous'").select(*place, "ref")
    found = found.join(ambiguous, [*place, "ref"], "left_anti")
    star = F.col("kind") == "star"
    wide = found.where(star & F.col("sources").isNotNull()).select(*place, "nth", "place", F.col("k_column").alias("column"), "sources", F.coalesce("k_kind", F.lit("direct")).alias("kind"), F.col("k_transform").alias("transform"))
    items = found.where(~star).groupBy(*place).agg(
        F.first("output").alias("output"), F.first("kind").alias("kind"), F.first("transform").alias("transform"),
        F.array_sort(F.collect_list(F.when(F.col("sources").isNotNull(), F.struct("ref", "sources", "k_kind", "k_transform")))).alias("got"), F.min("ref_name").alias("only"),
    )
    sources = F.array_distinct(F.flatten(F.transform("got", lambda g: g["sources"])))
    # What is passed on as it is keeps what was done to it below.
    passed = (F.col("kind") == "direct") & (F.size("got") == 1)
    one = items.select(
        *place, F.lit(0).alias("nth"), F.lit(0).alias("place"), F.coalesce("output", F.when(F.col("kind") == "direct", F.col("only")), F.substring_index(F.get(sources, F.lit(0)), ".", -1)).alias("column"), sources.alias("sources"),
        F.when(passed, F.coalesce(F.get("got", F.lit(0))["k_kind"], F.col("kind"))).otherwise(F.col("kind")).alias("kind"), F.when(passed, F.get("got", F.lit(0))["k_transform"]).otherwise(F.col("transform")).alias("transform"),
    )
    rows = wide.unionByName(one).withColumn("place", F.row_number().over(Window.partitionBy("model", "query", "branch").orderBy("position", "nth", "place")))
    head = F.struct("branch", "column", "kind", "transform")
    both = rows.groupBy("model", "query", "place").agg(F.min(head).alias("h"), F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct("branch", "sources")))["sources"])).alias("sources"))
    given = renamed.select(F.col("model").alias("g_model"), F.col("query").alias("g_query"), F.col("place").alias("g_place"), F.col("column").alias("given"))
    both = both.join(given, (F.col("model") == F.col("g_model")) & (F.col("query") == F.col("g_query")) & (F.col("place") == F.col("g_place")), "left")
    return both.select(F.col("model").alias("owner"), F.col("query").alias("target"), F.coalesce("given", "h.column").alias("column"), "place", "sources", "h.kind", "h.transform")


def column_lineage(models: DataFrame, model: str = "model", sql: str = "compiled", catalogue: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lineage, gaps) of the SELECT texts of models.

    lineage: model, output, place, sources (table.column, sorted by where they are named), kind (direct, cast, case, window, aggregate, function,
    arithmetic, subquery) and transform (the function, cast, case or window_FUNCTION of the outermost form), for each output column
    that has sources; a column that is only passed on keeps the kind it had below. gaps: model, expression, reference and reason of what isn't resolved. `catalogue` (relation, column, place)
    tells the columns of tables, which stars and names without an alias need. A column named by its table's alias is taken as
    said. A null text has no rows; texts that are no SELECT, queries of a cycle or beyond the depth give a gap of reason
    text_not_read or query_not_resolved.
    """
    queries = cut(_queries(models, model, sql))
    branches = cut(_branches(queries))
    relations, items, renamed = cut(_relations(branches)), cut(_projections(branches)), cut(_renamed(queries))
    empty = models.sparkSession.createDataFrame([], "relation string, column string, place int")
    tables = (empty if catalogue is None else catalogue).select(
        F.lit("").alias("owner"), F.col("relation").alias("target"), "column", F.col("place").cast("int").alias("place"), F.array(F.concat("relation", F.lit("."), "column")).alias("sources"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("transform"))
    known = cut(tables)
    gaps = items.where("level IS NULL").select("model", "expression", F.lit(None).cast("string").alias("reference"), F.lit("query_not_resolved").alias("reason"))
    unread = queries.where("query = ''").join(items.select("model").distinct(), "model", "left_anti")
    gaps = gaps.unionByName(unread.select("model", F.col("body").alias("expression"), F.lit(None).cast("string").alias("reference"), F.lit("text_not_read").alias("reason")))
    top = items.agg(F.max("level")).first()[0]
    for level in range(0 if top is None else top + 1):
        found = cut(_resolve(items.where(F.col("level") == level), relations, known))
        gap = cut(_gap(found))
        known = known.unionByName(cut(_outputs(found, gap, renamed)))
        gaps = gaps.unionByName(gap.select("model", "expression", "reference", "reason"))
    lineage = known.where((F.col("target") == "") & (F.col("owner") != "") & (F.size("sources") > 0))
    return lineage.select(F.col("owner").alias("model"), F.col("column").alias("output"), "place", "sources", "kind", "transform"), gaps
