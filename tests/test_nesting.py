"""Spans and nesting of definitions in indented, bracketed and worded languages."""

from loomgraph.functions import nesting as N

PY = '''import os

class A(Base):
    """doc { """
    x = 1

    def one(self):
        if x:
            return {"a": 1}

        def inner():
            # def no():
            pass
        return inner

    async def two(self): return 2

def last():
    s = "def fake(): {"
    return 1
'''
GO = """package main

type T struct {
	a int
}

// func no() {
func (t T) Run(x map[string]int) {
	if x { y("}") }
	f := func() {
	}
}

func one() { return }
func two()
{
	z()
}
"""
TS = """export class A {
  run() {
    return 1
  }
}
interface I {}
function outer() {
  function inner() { return 1 }
  const g = (a) => {
    return a
  }
}
"""
RB = "class A\n  def one\n    if x\n      y\n    end\n    [1].each do |i|\n      z\n    end\n  end\n\n  def two\n  end\nend\n"


def tree(spark):
    rows = [("r", "a.py", "python", PY), ("r", "a.go", "go", GO), ("r", "a.ts", "typescript", TS), ("r", "a.rb", "ruby", RB), ("r", "b.py", "python", None), ("r", "c.py", "python", "")]
    return spark.createDataFrame(rows, "repo_id string, path string, language string, content string")


def test_spans(spark):
    got = {(r["path"][2:], r["kind"], r["name"], r["line"], r["end_line"]) for r in N.spans(tree(spark)).collect()}
    assert got == {
        ("py", "Class", "A", 3, 16), ("py", "Function", "one", 7, 14), ("py", "Function", "inner", 11, 13), ("py", "Function", "two", 16, 16), ("py", "Function", "last", 18, 20),
        ("go", "Struct", "T", 3, 5), ("go", "Function", "Run", 8, 12), ("go", "Function", "one", 14, 14), ("go", "Function", "two", 15, 18),
        ("ts", "Class", "A", 1, 5), ("ts", "Interface", "I", 6, 6), ("ts", "Function", "outer", 7, 12), ("ts", "Function", "inner", 8, 8), ("ts", "Function", "g", 9, 11),
        ("rb", "Class", "A", 1, 13), ("rb", "Function", "one", 2, 9), ("rb", "Function", "two", 11, 12),
    }


def test_containment(spark):
    got = {(r["path"][2:], r["type"], r["src"], r["dst"]) for r in N.containment(N.spans(tree(spark))).collect() if r["path"] != "a.go"}
    assert got == {
        ("py", "FILE_CONTAINS", "a.py", "A"), ("py", "CLASS_CONTAINS", "A", "one"), ("py", "NESTS", "one", "inner"), ("py", "CLASS_CONTAINS", "A", "two"), ("py", "FILE_CONTAINS", "a.py", "last"),
        ("ts", "FILE_CONTAINS", "a.ts", "A"), ("ts", "FILE_CONTAINS", "a.ts", "I"), ("ts", "FILE_CONTAINS", "a.ts", "outer"), ("ts", "NESTS", "outer", "inner"), ("ts", "NESTS", "outer", "g"),
        ("rb", "FILE_CONTAINS", "a.rb", "A"), ("rb", "CLASS_CONTAINS", "A", "one"), ("rb", "CLASS_CONTAINS", "A", "two"),
    }


def test_unclosed(spark):
    files = spark.createDataFrame([("r", "a.go", "go", "func a() {\n\tx()\n\nfunc b() {\n}\n")], "repo_id string, path string, language string, content string")
    assert {(r["name"], r["line"], r["end_line"]) for r in N.spans(files).collect()} == {("a", 1, 5), ("b", 4, 5)}


def test_brackets_that_close_and_open_on_one_line(spark):
    text = "function a() {\n  if (x) { y() } else { z() }\n  try {\n  } catch (e) { } finally {\n  }\n}\nfunction b() { return {} }; function c() {\n}\n"
    files = spark.createDataFrame([("r", "a.ts", "typescript", text)], "repo_id string, path string, language string, content string")
    assert {(r["name"], r["line"], r["end_line"]) for r in N.spans(files).collect()} == {("a", 1, 6), ("b", 7, 7)}


def test_files_without_repository_path_language_or_content_give_no_row(spark):
    text = "func a() {\n}\n"
    rows = [(None, "a.go", "go", text), ("r", None, "go", text), ("r", "b.go", None, text), ("r", "c.go", "go", None), ("r", "d.go", "go", text)]
    found = N.containment(N.spans(spark.createDataFrame(rows, "repo_id string, path string, language string, content string")))
    assert [(r["path"], r["dst"]) for r in found.collect()] == [("d.go", "a")]
