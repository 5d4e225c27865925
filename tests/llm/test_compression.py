"""Languages by encoded sizes: recomputed with plain zstandard, no-letter texts, ties and narrow margins."""

import zstandard

from loomgraph.llm import language_id as L
from loomgraph.llm.shared import ship


def _model(spark, n=60):
    ship(spark)
    rows = [(k, f"the ship number {k} sails over the wide sea and the wind is with it on the way home", "en") for k in range(n)]
    rows += [(1000 + k, f"das schiff nummer {k} segelt über das weite meer und der wind ist mit ihm auf dem weg nach haus", "de") for k in range(n // 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, L.fit_languages(docs)


def test_sizes_by_plain_zstandard(spark):
    _, model = _model(spark)
    coders = model.coders()
    top = max(map(len, model.texts.values()))
    texts = ["the wind is with us", "der wind ist mit uns", "x", "the way home " * 900, "Über!"]
    for text in texts:
        data = "".join(c if c.isalpha() else " " for c in text.lower())
        data = " ".join(data.split(" ")) if "  " not in data else L.plain(text)
        raw = data.encode()
        for name, got in zip(coders.names, coders.sizes(text), strict=True):
            if len(model.texts[name]) != top:
                continue
            log = max(10, min(16, top.bit_length()))
            setting = zstandard.ZstdCompressionParameters(window_log=log + 1, chain_log=log, hash_log=log, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
            want = 0
            for i in range(0, len(raw), L.BLOCK):
                c = zstandard.ZstdCompressor(compression_params=setting, dict_data=zstandard.ZstdCompressionDict(model.texts[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                block = raw[i : i + L.BLOCK] * 2
                z = c.compress(block)
                assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(model.texts[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)).decompress(z, max_output_size=len(block)) == block
                want += len(z)
            assert got == want


def test_whole_table_against_decisions_of_one_text_each(spark):
    docs, model = _model(spark)
    coders = model.coders()
    for r in L.identify(docs, model, keep=("doc_id", "text", "lang")).collect():
        lang, score, margin, rejected = L.decide(coders.names, coders.sizes(r["text"]), True)
        assert (r["lang_pred"], r["score"], r["margin"], r["rejected"]) == (lang, score, margin, rejected) and lang == r["lang"]


def test_no_letter_is_und(spark):
    _, model = _model(spark)
    docs = spark.createDataFrame([(1, "²½ ¾"), (2, "12 !?"), (3, None), (4, ""), (5, "Ⅷ ①"), (6, "é")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in L.identify(docs, model).collect()}
    assert all(got[k] == ("und", True) for k in (1, 2, 3, 4, 5)) and got[6][0] in ("en", "de")


def test_ties_and_narrow_margins():
    assert L.decide(["a", "b"], [50.0, 50.0], True)[::3] == ("a", True)
    assert L.decide(["a", "b"], [50.0, 49.0], True)[::3] == ("b", False)
    assert L.decide(["a", "b"], [1000.0, 995.0], True)[::3] == ("b", True)
    assert L.decide(["a"], [9.0], True)[::3] == ("a", False)
    assert L.decide([], [], True) == ("und", 0.0, 0.0, True)
