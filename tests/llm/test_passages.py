"""Repeated passages of one or two lines in longer documents."""

from loomgraph.llm import line_dedup, queries

from .conftest import SCHEMA, prose

LONG, OTHER, A, B = prose(31, 51), prose(32, 60), prose(33, 30), prose(34, 21)
FIFTY = prose(35, 50)
TEXTS = [
    ["one", LONG, "two", A, B, "three", FIFTY, "x"],
    ["four", LONG, "five", OTHER],
    ["six", A, B, "seven", FIFTY, "eight"],
    [LONG],
    [A, B],
    ["nine", A, "ten", B, "eleven"],
    ["twelve", OTHER, "thirteen", OTHER, "fourteen"],
]


def brute(texts, over=50):
    first, gone = {}, [set() for _ in texts]
    for d, lines in enumerate(texts):
        for pos in range(len(lines)):
            for n in (1, 2, 3):
                run = tuple(lines[pos : pos + n])
                if len(run) == n and (n == 3 or len(" ".join(run).split()) > over or len(lines) == n) and "".join(run).strip() and first.setdefault(run, (d, pos)) < (d, pos):
                    gone[d] |= set(range(pos, pos + n))
    return ["\n".join(x for i, x in enumerate(lines) if i not in gone[d]) for d, lines in enumerate(texts)]


def test_passages_of_one_and_two_lines(spark):
    docs = spark.createDataFrame([(i, "\n".join(x), "en", "a", 0) for i, x in enumerate(TEXTS)], SCHEMA)
    want = brute(TEXTS)
    assert want[1] == "\n".join(["four", "five", OTHER]) and want[2] == "\n".join(["six", "seven", FIFTY, "eight"]) and want[3] == want[4] == ""
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, over_words=50).collect()}
    assert [got[i] for i in range(len(TEXTS))] == want
    kept = {r["doc_id"]: r["text"] for r in queries.stage_line_dedup(spark, docs, "").collect()}
    assert kept == {i: x for i, x in enumerate(want) if x}
