"""Rules against plain Python, hard rows, and the two ways of looking lines up."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import quality_rules as Q
from tests.llm.conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute(rows, most, share, least):
    """(key, five counts, failed, words of lines above the limits, kept)."""
    lines, hosts = {}, Counter(r["source"] for r in rows)
    for i, r in enumerate(rows):
        for x in (r["text"] or "").split("\n"):
            if WORD.search(x):
                line = " ".join(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x)))
                lines.setdefault((r["source"], line), []).append((i, len(WORD.findall(x))))
    taken = Counter()
    for (host, _), where in lines.items():
        if (n := len({i for i, _ in where})) > most and n > share * hosts[host]:
            for i, words in where:
                taken[i] += words
    out = []
    for i, r in enumerate(rows):
        b = base(r["text"])
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        out.append((r["doc_id"], *b, failed, taken[i], not failed and b[0] - taken[i] >= least * b[0]))
    return sorted(out, key=repr)


def judged(docs, **more):
    return sorted((tuple(r) for r in Q.judge_documents(docs, **more).collect()), key=repr)


def corpus(spark):
    menu = "\n".join(f"Home  | Menu {k} " + prose(900 + k, 9) for k in range(5))
    rows = [(i, prose(i, 80) + "\n" + menu.upper() if i % 2 else menu, "en", "a" if i % 3 else None, 1) for i in range(40)]
    rows += [(100 + i, prose(i + 500, 70) + "\n" + menu.replace("  ", "\t"), "en", "b", 1) for i in range(4)] + [(200, "same three words " * 40, "en", "b", 1), (200, "same three words " * 40, "en", "b", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_frequent_lines(spark):
    docs = corpus(spark)
    want = brute([r.asDict() for r in docs.collect()], 5, 0.02, 0.5)
    assert judged(docs, most_documents=5) == want
    assert any(r[7] and r[8] for r in want) and any(r[7] and not r[8] and not r[6] for r in want)


def test_many_frequent_lines_are_joined(spark, monkeypatch):
    """Beyond the limit of a broadcast the result is the same, whichever lines count as hot."""
    docs = corpus(spark)
    want = judged(docs, most_documents=5)
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 0)
    for share in (1, 20, 10_000):
        monkeypatch.setattr(Q, "HOT_SHARE", share)
        assert judged(docs, most_documents=5) == want


def test_hard_rows(hard_docs, no_docs):
    rows = [r.asDict() for r in hard_docs.collect()]
    assert judged(hard_docs, most_documents=1) == brute(rows, 1, 0.02, 0.5)
    assert judged(no_docs) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t\r#<☃𝔘 ", max_size=60), max_size=4))
def test_counts(texts):
    got = list(Q.measured([t.encode() for t in texts]))
    assert [g[0] for g in got] == [base(t) for t in texts]
    for t, (_, lines, words) in zip(texts, got, strict=True):
        worded = [x for x in t.split("\n") if WORD.search(x)]
        assert list(words) == [len(WORD.findall(x)) for x in worded]
        normal = [" ".join(WORD.findall(x.replace("B", "b"))) for x in worded]
        assert len(set(lines.tolist())) == len(set(normal)) == len(set(zip(normal, lines.tolist(), strict=True)))
