"""Column lineage over compiled models whose texts differ in shape, depth and names; the SQL knows the answers from the keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import column_lineage
from ..sources.tables import Tables
from .registry import Registry

R = Registry()

#: Texts by shape; $ is the customer's key, # its nation. A text of shape 0 is a chain of one to six expressions over a first one, by its nation.
SHAPES = (
    "",
    "with o as (select t.id as k, upper(trim(t.name)) as nm /* from (nowhere */ from raw.t$ t), p as (select * from o) select p.nm as label, p.k, 'a, (b' as note from p",
    "select s.total, s.k + 1 next_k, (select max(u.v) from base.u# u where u.k = s.k) as top from (select t.k, sum(t.a * (t.b - 1)) as total from base.t$ as t group by t.k) s where s.total > (3)",
    "select a.x as p, a.y as q from base.a$ a union all (select b.m, b.n from base.b# b)",
    "select amount, cast(o.created as date) d, case when o.status = 'from x' then o.amount else 0 end v, count(*) n from raw.orders o -- join lost l",
    "with c(k, m) as (select b.id, sum(b.q) over (partition by b.g order by b.h rows between unbounded preceding and current row) from base.b$ b) select c.m as rolling, n from c join raw.n# using (k)",
    "select id, z.q, c.nope, x.* from (select o.amount from raw.orders o) c join base.w$ x on x.id = c.amount",
    "with recursive r(n) as (select b.k from base.b b union all select r.n + 1 from r) select r.n from r",
    "select coalesce(l.a, r.a, 0) as a, l.b || r.b as b from (with i as (select m.a, m.b from base.m$ m) select i.a, i.b from i) l left join base.m# r on l.a = r.a order by 1",
    "insert into base.t$ values (1, 2)",
)

# Known answers: shape, output, place, sources, kind, transform.
_ANSWERS = """(VALUES
  (1, 'label', 1, 'raw.t$.name', 'function', 'upper'), (1, 'k', 2, 'raw.t$.id', 'direct', NULL),
  (2, 'total', 1, 'base.t$.a,base.t$.b', 'aggregate', 'sum'), (2, 'next_k', 2, 'base.t$.k', 'arithmetic', NULL), (2, 'top', 3, 'base.u#.v', 'subquery', NULL),
  (3, 'p', 1, 'base.a$.x,base.b#.m', 'direct', NULL), (3, 'q', 2, 'base.a$.y,base.b#.n', 'direct', NULL),
  (4, 'amount', 1, 'raw.orders.amount', 'direct', NULL), (4, 'd', 2, 'raw.orders.created', 'cast', 'cast'), (4, 'v', 3, 'raw.orders.status,raw.orders.amount', 'case', 'case'),
  (5, 'rolling', 1, 'base.b$.q,base.b$.g,base.b$.h', 'window', 'window_sum'), (5, 'n', 2, 'raw.n#.n', 'direct', NULL),
  (8, 'a', 1, 'base.m$.a,base.m#.a', 'function', 'coalesce'), (8, 'b', 2, 'base.m$.b,base.m#.b', 'arithmetic', NULL)) a(shape, output, place, sources, kind, transform)"""
_GAPS = """(VALUES (6, 'unqualified_column_reference_not_resolved', 1), (6, 'source_alias_not_resolved', 1), (6, 'cte_column_not_resolved', 1), (6, 'wildcard_projection_not_supported', 1),
  (7, 'query_not_resolved', 3), (9, 'text_not_read', 1)) g(shape, reason, each)"""


def _models(t: Tables) -> DataFrame:
    """(model, compiled): a text for each customer, of a shape by its key."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    chain = F.array_join(F.transform(F.sequence(F.lit(1), F.col("c_nationkey") % 6 + 1), lambda i: F.concat(F.lit("s"), i.cast("string"), F.lit(" as (select x.v + "), i.cast("string"), F.lit(" as v from s"), (i - 1).cast("string"), F.lit(" x)"))), ", ")
    chain = F.concat(F.lit("with s0 as (select t.id as v from base.t"), key, F.lit(" t), "), chain, F.lit(" select y.v as last from s"), (F.col("c_nationkey") % 6 + 1).cast("string"), F.lit(" y"))
    shape = F.col("c_custkey") % len(SHAPES)
    text = reduce(lambda rest, i: F.when(shape == i, F.lit(SHAPES[i])).otherwise(rest), range(1, len(SHAPES)), F.lit(None).cast("string"))
    filled = F.replace(F.replace(text, F.lit("$"), key), F.lit("#"), nation)
    return t.customer.select(F.concat(F.lit("m"), key).alias("model"), F.when(shape == 0, chain).otherwise(filled).alias("compiled"))


def _catalogue(t: Tables) -> DataFrame:
    """What is known of the tables: one that all texts share, and one for each nation."""
    orders = t.region.select(F.lit("raw.orders").alias("relation"), F.explode(F.array(F.lit("amount"), F.lit("created"), F.lit("status"))).alias("column")).distinct()
    nations = t.nation.select(F.concat(F.lit("raw.n"), F.col("n_nationkey")).alias("relation"), F.lit("n").alias("column"))
    return orders.unionByName(nations).withColumn("place", F.lit(1))


def _lineage(t: Tables) -> tuple[DataFrame, DataFrame]:
    return column_lineage(_models(t), catalogue=_catalogue(t))


def _known(sources: Column) -> Column:
    return F.array_join(sources, ",")


@R.add(f"""SELECT 'm' || c_custkey AS model, output, place, replace(replace(sources, '$', c_custkey::VARCHAR), '#', c_nationkey::VARCHAR) AS sources, kind, transform FROM customer JOIN {_ANSWERS} ON shape = c_custkey % 10
UNION ALL SELECT 'm' || c_custkey, 'last', 1, 'base.t' || c_custkey || '.id', 'arithmetic', NULL FROM customer WHERE c_custkey % 10 = 0""")
def lineage_shapes(t: Tables) -> DataFrame:
    """Lineage to base columns through chains of expressions, subqueries, unions, windows, stars and renamed columns."""
    return _lineage(t)[0].select("model", "output", "place", _known(F.col("sources")).alias("sources"), "kind", "transform")


@R.add(f"SELECT reason, sum(each)::BIGINT AS n, count(DISTINCT c_custkey) AS models FROM customer JOIN {_GAPS} ON shape = c_custkey % 10 GROUP BY reason")
def lineage_gaps(t: Tables) -> DataFrame:
    """What is not resolved, counted by reason."""
    return _lineage(t)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("model").alias("models"))


@R.add(f"""WITH found AS (SELECT 'm' || c_custkey AS model, unnest(string_split(replace(replace(sources, '$', c_custkey::VARCHAR), '#', c_nationkey::VARCHAR), ',')) AS source FROM customer JOIN {_ANSWERS} ON shape = c_custkey % 10
  UNION ALL SELECT 'm' || c_custkey, 'base.t' || c_custkey || '.id' FROM customer WHERE c_custkey % 10 = 0)
SELECT source, count(DISTINCT model) AS models, count(*) AS outputs FROM found GROUP BY source HAVING count(DISTINCT model) > 1""")
def lineage_shared_columns(t: Tables) -> DataFrame:
    """Base columns that several models stand on, with their number of models and outputs."""
    used = _lineage(t)[0].select("model", F.explode("sources").alias("source"))
    return used.groupBy("source").agg(F.count_distinct("model").alias("models"), F.count(F.lit(1)).alias("outputs")).where("models > 1")


QUERIES, SQL = R.queries, R.sql
