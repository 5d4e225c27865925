import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is with thing other words of many kinds make a text that goes on and on about ships harbour tides rope anchor sails wind night stars maps".split()


def prose(seed: int, n: int) -> str:
    """n words, drawn by a small generator so that texts differ."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("s" if x % 7 == 0 else "") + ("ing" if x % 11 == 0 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and texts, surrogate-free Unicode, clashing names."""
    from loomgraph.llm.shared import ship

    ship(spark)
    long = " ".join(prose(5, 50) for _ in range(400))
    rows = [
        (None, None, None, None, None), (None, prose(1, 40), "en", "a", 1), (1, "", "en", "a", 0), (2, None, "en", None, None), (3, " \n\t ", None, "b", 4),
        (4, prose(2, 80), "en", "b", 9), (5, prose(2, 80), "en", "b", 9), (6, prose(2, 78) + " tail end", "en", "b", 9), (7, long, "en", "c", 7), (8, "Ünïcödé ☃ text 𝔘", "de", "c", 3),
        (8, "Ünïcödé ☃ text 𝔘", "de", "c", 3), (9, "a\nb\nc\nd\ne", "en", "d", 9), (10, "x\na\nb\nc\ny", "en", "d", 9), (11, "12345 !!! ###", None, "d", 1), (12, "one", "en", "d", 1), (13, "\n\n\n\n", "en", "d", 4),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = {c: "zz" for c in ("key", "name", "token", "n", "score", "rejected", "shard", "bucket", "rank", "text_hash", "removed", "item_id", "tail_n", "html", "host")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in clash.items()})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def bench(spark):
    return spark.createDataFrame([(1, prose(99, 30)), (2, None), (3, ""), (4, "three word item"), (None, prose(98, 20))], "item_id long, text string")
