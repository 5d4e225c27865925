"""References of API documents: chains, cycles, missing targets, other files, JSON and YAML."""

import json

from loomgraph.functions import api_refs as A

MAIN = {
    "paths": {"/a/{id}": {"get": {"parameters": [{"$ref": "#/components/parameters/P"}], "responses": {"200": {"content": {"x": {"schema": {"$ref": "#/components/schemas/One"}}}}}}, "post": {"requestBody": {"$ref": "other/b.json#/bodies/B"}}, "put": {"responses": {"404": {"$ref": "#/nowhere"}}}, "patch": {"requestBody": {"$ref": "#/components/schemas/Loop"}}}},
    "components": {"schemas": {"One": {"$ref": "#/components/schemas/Two"}, "Two": {"$ref": "#/components/schemas/Three"}, "Three": {"type": "object"}, "Loop": {"$ref": "#/components/schemas/Back"}, "Back": {"$ref": "#/components/schemas/Loop"}}, "parameters": {"P": {"name": "p"}}},
}
OTHER = {"bodies": {"B": {"$ref": "../api.json#/components/schemas/Three"}, "x/y~z": {"k": [1, {"m": None}]}}}
YAML = "paths:\n  /y:\n    get:\n      responses:\n        '200':\n          $ref: '#/components/r/R'\ncomponents:\n  r:\n    R:\n      $ref: \"api.json#/components/schemas/Two\"\n"


def test_references(spark):
    files = spark.createDataFrame([("r", "api.json", json.dumps(MAIN)), ("r", "other/b.json", json.dumps(OTHER)), ("r", "bad.json", "{"), ("r", "null.json", None), ("r", "y.yaml", YAML), ("s", "api.json", "{}")], "repo_id string, path string, content string")
    nodes = A.json_nodes(files).unionByName(A.yaml_nodes(files))
    assert {(r["pointer"], r["kind"], r["value"]) for r in nodes.where("path = 'other/b.json' AND pointer LIKE '%x~1y%'").collect()} == {("/bodies/x~1y~0z", "object", None), ("/bodies/x~1y~0z/k", "array", None), ("/bodies/x~1y~0z/k/0", "scalar", "1"), ("/bodies/x~1y~0z/k/1", "object", None), ("/bodies/x~1y~0z/k/1/m", "scalar", None)}
    got = {(r["path"], r["route"], r["method"], r["place"]): (r["status"], r["target_path"], r["target"], r["hops"]) for r in A.operation_schemas(A.resolve(A.references(nodes), nodes)).collect()}
    three = "/components/schemas/Three"
    assert got == {
        ("api.json", "/a/{id}", "get", "parameters"): ("resolved", "api.json", "/components/parameters/P", 1), ("api.json", "/a/{id}", "get", "responses"): ("resolved", "api.json", three, 3),
        ("api.json", "/a/{id}", "post", "requestBody"): ("resolved", "api.json", three, 2), ("api.json", "/a/{id}", "put", "responses"): ("missing", "api.json", "/nowhere", 1),
        ("api.json", "/a/{id}", "patch", "requestBody"): ("cycle", "api.json", "/components/schemas/Loop", 3), ("y.yaml", "/y", "get", "responses"): ("resolved", "api.json", three, 3),
    }


def test_depth_and_length(spark):
    deep = {}
    for _ in range(A.DEPTH + 3):
        deep = {"k": deep}
    chain = {"paths": {"/z": {"get": {"requestBody": {"$ref": "#/c/0"}}}}, "c": {str(i): {"$ref": f"#/c/{i + 1}"} for i in range(A.HOPS + 2)}}
    files = spark.createDataFrame([("r", "d.json", json.dumps(deep)), ("r", "c.json", json.dumps(chain))], "repo_id string, path string, content string")
    nodes = A.json_nodes(files)
    assert nodes.where("kind = 'too_deep'").count() == 1
    assert {r["status"] for r in A.operation_schemas(A.resolve(A.references(nodes), nodes)).collect()} == {"too_long"}
