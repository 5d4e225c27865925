"""Column lineage of single texts: expressions, chains, subqueries, unions, scopes, and what is reported as unresolved."""

import pytest

from loomgraph.functions.lineage import column_lineage

TABLES = {"raw.public.orders": ("id", "amount", "customer_id", "created_at"), "raw.public.customers": ("id", "name")}
O, C = "raw.public.orders.", "raw.public.customers."
# Text; outputs as name: (sources, kind, transform).
TEXTS = {
    "cast": ("select\n  cast(o.amount as numeric(10, 2)) as v\nfrom raw.public.orders o", {"v": ([O + "amount"], "cast", "cast")}),
    "window": ("select sum(o.amount) over (partition by o.customer_id order by o.created_at rows between 1 preceding and current row) as r from raw.public.orders o", {"r": ([O + "amount", O + "customer_id", O + "created_at"], "window", "window_sum")}),
    "chain": ("with c as (select o.id, trim(upper(o.name)) as nm from raw.public.customers o -- x, (y\n), d as (select c.id, c.nm from c) select d.nm, d.id as k, coalesce(d.nm, ', (') as q from d", {"nm": ([C + "name"], "function", "trim"), "k": ([C + "id"], "direct", None), "q": ([C + "name"], "function", "coalesce")}),
    "stars": ("with c as (select * from raw.public.customers), d as (select c.* from c) select * from d", {"id": ([C + "id"], "direct", None), "name": ([C + "name"], "direct", None)}),
    "subquery": ("select s.total, s.k+1 plus, (select max(u.v) from b.u u where u.k = s.k) as top from (select t.k, sum(t.a * (t.b - 1)) as total from b.t as t group by t.k) s where s.total > 3", {"total": (["b.t.a", "b.t.b"], "aggregate", "sum"), "plus": (["b.t.k"], "arithmetic", None), "top": (["b.u.v"], "subquery", None)}),
    "union": ("select a.x as p, a.y as q from b.a a union all (select b.m, b.n from b.b b) except select c.r, c.s from b.c c", {"p": (["b.a.x", "b.b.m", "b.c.r"], "direct", None), "q": (["b.a.y", "b.b.n", "b.c.s"], "direct", None)}),
    "bare": ("select amount, id from raw.public.orders", {"amount": ([O + "amount"], "direct", None), "id": ([O + "id"], "direct", None)}),
    "renamed": ("with r(n, m) as (select b.k, b.l from b.b b) select r.n, m from r", {"n": (["b.b.k"], "direct", None), "m": (["b.b.l"], "direct", None)}),
    "forms": ("select case when o.status = 'x' then o.amount else 0 end as v, count(distinct o.id) ids, extract(year from o.created_at) y, o.a::int as ai, date_trunc('day', o.created_at), 'from x' as lit, count(*) n, (o.a) q, sum(o.a)s from raw.public.orders o",
              {"v": ([O + "status", O + "amount"], "case", "case"), "ids": ([O + "id"], "aggregate", "count"), "y": ([O + "created_at"], "function", "extract"), "ai": ([O + "a"], "cast", "cast"), "created_at": ([O + "created_at"], "function", "date_trunc"), "q": ([O + "a"], "direct", None), "s": ([O + "a"], "aggregate", "sum")}),
    "outer": ("select (select o.amount + c.z from b.c c) as v from raw.public.orders o", {"v": ([O + "amount", "b.c.z"], "subquery", None)}),
    "shadowed": ("with c as (select a.x from b.a a) select o.y from (with c as (select d.z as y from b.d d) select c.y from c) o join c on true", {"y": (["b.d.z"], "direct", None)}),
    "joins": ("select l.a, r.b, m.c from b.l l left join b.r as r using (k), b.m m where l.a in (select x.q from b.x x)", {"a": (["b.l.a"], "direct", None), "b": (["b.r.b"], "direct", None), "c": (["b.m.c"], "direct", None)}),
    "deep": (f"select {'(' * 30}o.a{')' * 30} + 1 as v from b.o o", {"v": (["b.o.a"], "arithmetic", None)}),
}
# Text; (reference, reason) of its gaps.
GAPS = {
    "ambiguous": ("select id from raw.public.orders o join raw.public.customers c on o.id = c.id", {("id", "unqualified_column_reference_ambiguous")}),
    "lost": ("with c as (select o.id from raw.public.orders o) select c.nope, z.q, lost, y.* from c join b.zz y using (id)", {("c.nope", "cte_column_not_resolved"), ("z.q", "source_alias_not_resolved"), ("lost", "unqualified_column_reference_not_resolved"), ("y.*", "wildcard_projection_not_supported")}),
    "cycle": ("with recursive r(n) as (select b.k from b.b b union all select r.n + 1 from r) select r.n from r", {(None, "query_not_resolved")}),
    "other": ("update x set y = 1", {(None, "text_not_read")}),
    "empty": ("", {(None, "text_not_read")}),
}


@pytest.fixture(scope="module")
def results(spark):
    texts = [(k, v[0]) for k, v in (TEXTS | GAPS).items()] + [("null", None)]
    models = spark.createDataFrame(texts, "model string, compiled string")
    catalogue = spark.createDataFrame([(t, c, i + 1) for t, cs in TABLES.items() for i, c in enumerate(cs)], "relation string, column string, place int")
    known, gaps = column_lineage(models, catalogue=catalogue)
    return known.collect(), gaps.collect()


@pytest.mark.parametrize("name", TEXTS)
def test_texts(results, name):
    assert {r["output"]: (r["sources"], r["kind"], r["transform"]) for r in results[0] if r["model"] == name} == TEXTS[name][1]
    assert [r for r in results[1] if r["model"] == name] == []


@pytest.mark.parametrize("name", GAPS)
def test_gaps(results, name):
    assert {(r["reference"], r["reason"]) for r in results[1] if r["model"] == name} == GAPS[name][1]


def test_no_texts(spark):
    known, gaps = column_lineage(spark.createDataFrame([("a", None)], "model string, compiled string"))
    assert known.collect() == gaps.collect() == []
