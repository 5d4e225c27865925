"""Groups by shared keys against a union-find in plain Python: chains, hot keys, lone and null rows."""

import random

from loomgraph.operators import identity as I

SCHEMA = "entity long, kind string, key string"


def brute(rows):
    root = {e: e for e, _, _ in rows if e is not None}

    def find(e):
        while root[e] != e:
            e = root[e]
        return e

    first = {}
    for e, kind, key in rows:
        if None not in (e, kind, key):
            a, b = find(e), find(first.setdefault((kind, key), e))
            root[max(a, b)] = min(a, b)
    return {e: find(e) for e in root}


def grouped(spark, rows):
    return {r["entity"]: r["group"] for r in I.identity_groups(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_chain_and_hot_key(spark):
    order = list(range(60))
    random.Random(3).shuffle(order)
    rows = [x for i in range(59) for x in ((order[i], "arn" if i % 2 else "name", str(i)), (order[i + 1], "arn" if i % 2 else "name", str(i)))]
    rows += [(1000 + i, "tag", "all") for i in range(300)] + [(2000, None, None), (None, "tag", "all"), (2001, "arn", "tag"), (2002, "tag", "arn"), (2003, "arn", None)]
    got = grouped(spark, rows)
    assert got == brute(rows) and {got[i] for i in range(60)} == {0} and got[1299] == 1000 and got[2001] == 2001


def test_random(spark):
    r = random.Random(5)
    rows = [(r.randrange(120), r.choice("ab"), str(r.randrange(90))) for _ in range(130)]
    assert grouped(spark, rows) == brute(rows)


def test_clashes(spark):
    rows = [(1, "name", "n"), (2, "name", "n"), (1, "arn", "x"), (2, "arn", "y"), (3, "arn", "z"), (3, "arn", "z")]
    keys = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in I.key_clashes(keys, I.identity_groups(keys), ["arn"]).collect()] == [(1, "arn", 2, "x", "y")]
    assert I.identity_groups(keys.where("false")).collect() == []
