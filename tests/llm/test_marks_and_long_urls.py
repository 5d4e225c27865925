"""Letters keep their combining marks; a long url costs time in proportion to its length."""

import time
import unicodedata

from loomgraph.llm import language_id as L
from loomgraph.llm import url_filter as U


def test_marks_stay_with_their_letters():
    assert L.plain("हिन्दी में पाठ।") == "हिन्दी में पाठ "
    assert L.plain("café DéJÀ-vu 12") == "café déjà vu "
    assert L.plain("ภาษาไทย, ที่") == "ภาษาไทย ที่"
    assert L.plain("a_b1c!?d") == "a b c d"
    assert L.plain("\U00011013\U00011038 \U0001f600 x") == "\U00011013\U00011038 x"  # a rare script's vowel sign


def test_decomposed_texts_are_judged_as_composed_ones():
    model = L.LanguageModel({"fr": "l'été à la forêt près de la mer où les élèves étaient déjà".encode(), "en": b"the summer in the forest near the sea where the pupils were already"}, {"fr": 1, "en": 1})
    coders = model.coders()
    text = "élèves à la forêt"
    assert unicodedata.normalize("NFD", text) != text and coders.sizes(unicodedata.normalize("NFD", text)) == coders.sizes(text)


def test_long_segments():
    rules = [("block", "net", "/" + "a" * k) for k in (1, 3, 7)] + [("allow", "net", "/x/" + "b" * 50), ("block", "net", "/")]
    trie = U.build_trie(rules)
    assert U.look_up(trie, "w.net", "/aaaa/z") == ("net/aaa", "block") and U.look_up(trie, "net", "/x/" + "b" * 60) == ("net/x/" + "b" * 50, "allow")
    assert U.look_up(trie, "net", "") is None and U.look_up(trie, "net", "/c") == ("net/", "block")
    began = time.time()
    assert U.look_up(trie, "net", "/" + "a" * 5_000_000) == ("net/aaaaaaa", "block")
    assert U.look_up(trie, "net", "/" + "q/" * 1_000_000) == ("net/", "block")
    assert time.time() - began < 5
