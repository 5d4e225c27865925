"""One language with little text does not weaken the others; with some text it is found."""

from loomgraph.llm import language_id
from loomgraph.llm.shared import ship

from .conftest import SCHEMA, prose

GERMAN = str.maketrans("aeiourstn", "uoaiemklz")


def corpus(spark):
    rows = [(i, prose(i, 700), "en", "a", 0) for i in range(60)] + [(100 + i, prose(i, 700).translate(GERMAN), "de", "a", 0) for i in range(60)]
    rows += [(200 + i, "ye olde short text", "xx", "a", 0) for i in range(3)] + [(300, " ", "yy", "a", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_small_language_leaves_others_whole(spark):
    ship(spark)
    docs = corpus(spark)
    model = language_id.fit_languages(docs)
    assert {k: len(v) for k, v in model.texts.items()} == {"en": 64 * 1024, "de": 64 * 1024, "xx": 18}
    with_it = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(with_it[i]["lang_pred"] == ("en" if i < 100 else "de") and not with_it[i]["rejected"] for i in [*range(60), *range(100, 160)])


def test_middling_language_is_found_by_equal_slices(spark):
    third = str.maketrans("aeioustr", "oiuaernm")
    texts = {"en": b" ".join(prose(i, 700).encode() for i in range(20))[:65536], "cy": prose(5, 300).translate(third).encode()}
    coders = language_id.LanguageModel(texts, {"en": 20, "cy": 1}).coders()
    for text, lang in ((prose(77, 200), "en"), (prose(77, 200).translate(third), "cy")):
        got = coders.sizes(text)
        assert language_id.decide(coders.names, got, True)[0] == lang and not language_id.decide(coders.names, got, True)[3]


def test_pieces_come_from_the_whole_text(spark):
    texts = [("q" * 1999 + " ") + prose(i, 2000) for i in range(12)]
    model = language_id.fit_languages(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA))
    assert model.texts["en"].count(b"q") < len(model.texts["en"]) / 2
