"""OpenAPI documents whose references form chains, cycles, dangling ends and links into other files, by their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import api_refs
from ..sources.tables import Tables
from .registry import Registry

R = Registry()

#: Documents by shape; $ is the customer's key, ~ a chain of references from S0 to S1 and so on, ^ its last name.
SHAPES = (
    '{"openapi": "3.0.0", "paths": {"/c$/{id}": {"get": {"responses": {"200": {"content": {"json": {"schema": {"$ref": "#/components/schemas/S0"}}}}}}}}, "components": {"schemas": {~, "^": {"type": "object"}}}}',
    '{"paths": {"/c$": {"post": {"requestBody": {"$ref": "#/components/schemas/A"}, "parameters": [{"name": "$ref"}, {"$ref": "#/components/parameters/none"}]}}}, "components": {"schemas": {"A": {"$ref": "#/components/schemas/B"}, "B": {"$ref": "#/components/schemas/A"}}}}',
    '{"paths": {"/c$": {"put": {"responses": {"default": {"$ref": "../shared/n#.json#/models/M"}}}}}, "x": "\\"$ref\\": \\"#/no\\""}',
)


def _documents(t: Tables) -> DataFrame:
    """A document for each customer, and for each nation one that others refer to."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    shape = F.col("c_custkey") % len(SHAPES)
    text = F.coalesce(*[F.when(shape == i, F.lit(x)) for i, x in enumerate(SHAPES)])
    length = F.col("c_nationkey") % 4 + 1
    link = lambda i: F.concat(F.lit('"S'), i.cast("string"), F.lit('": {"$ref": "#/components/schemas/S'), (i + 1).cast("string"), F.lit('"}'))
    chain = F.array_join(F.transform(F.sequence(F.lit(0), length - 1), link), ", ")
    filled = F.replace(F.replace(text, F.lit("~"), chain), F.lit("^"), F.concat(F.lit("S"), length.cast("string")))
    # $ref stays, $ elsewhere is the key; # of a path stays, n# is the nation's file.
    filled = F.replace(F.replace(F.replace(F.replace(filled, F.lit("$ref"), F.lit("@ref")), F.lit("$"), key), F.lit("@ref"), F.lit("$ref")), F.lit("n#.json"), F.concat(F.lit("n"), nation, F.lit(".json")))
    own = t.customer.select(F.lit("repo:api").alias("repo_id"), F.concat(F.lit("specs/"), key, F.lit(".json")).alias("path"), filled.alias("content"))
    shared = t.nation.select(F.lit("repo:api").alias("repo_id"), F.concat(F.lit("shared/n"), F.col("n_nationkey"), F.lit(".json")).alias("path"), F.concat(F.lit('{"models": {"M": {"$ref": "#/models/'), F.when(F.col("n_regionkey") == 0, "gone").otherwise("N"), F.lit('"}, "N": {"type": "string"}}}')).alias("content"))
    return own.unionByName(shared)


_FOUND = """SELECT '/c' || c_custkey || '/{id}' AS route, 'get' AS method, 'responses' AS place, 'resolved' AS status, '/components/schemas/S' || (c_nationkey % 4 + 1) AS target, (c_nationkey % 4 + 2)::INT AS hops FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT '/c' || c_custkey, 'post', place, status, target, hops FROM customer, (VALUES ('requestBody', 'cycle', '/components/schemas/A', 3), ('parameters', 'missing', '/components/parameters/none', 1)) x(place, status, target, hops) WHERE c_custkey % 3 = 1
UNION ALL SELECT '/c' || c_custkey, 'put', 'responses', CASE WHEN n_regionkey = 0 THEN 'missing' ELSE 'resolved' END, CASE WHEN n_regionkey = 0 THEN '/models/gone' ELSE '/models/N' END, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 2"""


def _operations(t: Tables) -> DataFrame:
    nodes = api_refs.json_nodes(_documents(t))
    return api_refs.operation_schemas(api_refs.resolve(api_refs.references(nodes), nodes))


@R.add(_FOUND)
def api_references(t: Tables) -> DataFrame:
    """Where the references of operations end: resolved through chains and other files, missing, or a cycle."""
    return _operations(t).select("route", "method", "place", "status", "target", "hops")


@R.add(f"SELECT status, count(*) AS n, max(hops) AS longest, count(DISTINCT route) AS routes FROM ({_FOUND}) GROUP BY status")
def api_reference_health(t: Tables) -> DataFrame:
    """References of operations by how they end, and the longest chain."""
    return _operations(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("hops").alias("longest"), F.count_distinct("route").alias("routes"))


QUERIES, SQL = R.queries, R.sql
