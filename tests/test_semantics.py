"""Meanings of definitions and build files on small files, with nulls, empty texts and forms that don't count."""

from loomgraph.functions import semantics

FILES = "repo_id string, path string, content string, language string"


def rows(spark, path, content, language):
    return spark.createDataFrame([("r", path, content, language), ("r", "empty", "", language), ("r", "null", None, language)], FILES)


def test_trait_adaptations(spark):
    text = "class C {\n use A, B;\n use A, B {\n  A::f insteadof B, \\N\\D, B;\n  \\N\\B::f as protected g;\n  B::h as private;\n }\n $x = A::f();\n}"
    found = {(r["type"], r["trait"], r["method"], r["target"]) for r in semantics.trait_adaptations(rows(spark, "c.php", text, "php")).collect()}
    assert found == {("OVERRIDES", "A", "f", "B"), ("OVERRIDES", "A", "f", "D"), ("ALIASES", "B", "f", "g"), ("ALIASES", "B", "h", "private")}


def test_python_profiles(spark):
    text = "@a\n@b.c(1)\ndef one():\n  pass\nasync def two(x: int) -> int:\n  '''Doc.'''\n  y = yield 1\nclass Three(metaclass=M):\n  def four(self):\n    \"\"\"Doc.\"\"\"\n\nfive = lambda x: x\nsix = 1\ndef seven(): return yielded"
    found = {r["name"]: r for r in semantics.python_profiles(rows(spark, "a.py", text, "python")).collect()}
    assert {k: v["surface_kind"] for k, v in found.items()} == {
        "one": "decorated_function", "two": "async_generator_function", "Three": "metaclass_class", "four": "documented_function", "five": "lambda_function", "seven": "plain",
    }
    assert found["two"]["documented"] and found["two"]["annotated"] == "return" and not found["Three"]["generator"]


def test_go_roots(spark):
    text = 'func main() {\n\tmux.Handle("/a", http.HandlerFunc(show))\n\thttp.HandleFunc("/b", func(w http.ResponseWriter, r *http.Request) {})\n}\nfunc (s *S) show(w http.ResponseWriter, r *http.Request) {}\nfunc mainly() {}\nvar c = &cobra.Command{PreRunE: check, Run: do}\n'
    found = {(r["name"], r["root"]) for r in semantics.go_roots(rows(spark, "m.go", text, "go")).collect()}
    assert found == {("main", "go.entrypoint"), ("show", "go.net_http_handler_registration"), ("show", "go.net_http_handler_signature"), ("check", "go.cobra_run_registration"), ("do", "go.cobra_run_registration")}


def test_controllers(spark):
    text = "@Library('a@v1') _\nlibrary('b')\nlibrary identifier: \"a@v2\"\npipelineX(use_configd: true)\nsh 'ansible-playbook p.yml -i h'\nsh 'ansible-playbook p.yml'\n"
    (r,) = [x for x in semantics.controllers(rows(spark, "x.groovy", text, "groovy")).collect()]
    assert (r["libraries"], r["pipelines"], r["playbooks"], r["use_configd"], r["pre_deploy"]) == (["a", "b"], ["pipelineX"], ["p.yml"], True, False)
    assert semantics.controllers(rows(spark, "ci/Jenkinsfile", "", "groovy")).count() == 1


def test_identity_keys(spark):
    text = '{"t1": {"bucket": "string", "name": "string"}, "t2": {"name": "number", "x_name": "string", "a_identifier": "string"}, "t3": {}}'
    found = {r[0]: r[1] for r in semantics.identity_keys(rows(spark, "s.json", text, "json")).collect()}
    assert found == {"t1": ["name"], "t2": ["a_identifier", "x_name"], "t3": []}
