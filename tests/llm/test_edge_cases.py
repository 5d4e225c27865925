"""Every operator and stage on nulls, empty and long texts, repeats, clashing names, and empty tables."""

import pytest

from loomgraph.llm import decontaminate, fingerprints, html_extract, language_id, line_dedup, ngram_join, packing, quality, queries, sharding, url_filter


def run(df):
    return [r.asDict() for r in df.collect()]


def test_sharding(hard_docs, no_docs):
    rows = run(sharding.assign_shards(hard_docs, shards=3, grown=4))
    assert len(rows) == hard_docs.count()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    assert {r["size"] for r in rows if r["key"] == 2} == {8}
    assert run(sharding.assign_shards(no_docs)) == []


def test_line_dedup(hard_docs, no_docs):
    rows = run(line_dedup.dedup_lines(hard_docs))
    assert len(rows) == hard_docs.count() and {"key", "text_hash", "n_removed"} <= rows[0].keys()
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert by[9]["text"] == "a\nb\nc\nd\ne" and by[10]["text"] == "x\ny" and by[10]["n_removed"] == 3
    assert by[4]["n_removed"] == 0 and by[5]["text"] == "" and by[2]["text"] is None and by[1]["text"] == ""
    assert by[13]["text"] == "\n\n\n\n"
    assert [r["n_removed"] for r in rows if r["doc_id"] == 8] == [0, 0]
    assert run(line_dedup.dedup_lines(no_docs)) == []


def test_ngram_join(hard_docs, no_docs):
    rows = run(ngram_join.shingle_groups(hard_docs))
    assert len(rows) == hard_docs.count()
    by = {r["key"]: r for r in rows if r["key"] is not None}
    assert by[5]["component_id"] == by[6]["component_id"] == 4 and by[7]["component_id"] == 7
    assert by[1]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[12]["n_shingles"] == 1
    assert [r["component_id"] for r in rows if r["key"] is None] == [None, None]
    assert run(ngram_join.shingle_groups(no_docs)) == []


def test_language(hard_docs, no_docs):
    model = language_id.fit_languages(hard_docs)
    rows = run(language_id.identify(hard_docs, model))
    assert len(rows) == hard_docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    for k in (1, 2, 3, 11, 13):
        assert (by[k]["lang_pred"], by[k]["score"], by[k]["rejected"]) == ("und", 0.0, True)
    assert by[7]["lang_pred"] == "en" and not by[7]["rejected"]
    assert run(language_id.identify(no_docs, model)) == []
    none = language_id.fit_languages(no_docs)
    assert {r["lang_pred"] for r in run(language_id.identify(hard_docs, none))} == {"und"}


def test_quality(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 1, 0), (11, 0, 0), (None, 1, 0), (12, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(hard_docs, labels)
    rows = run(quality.score_quality(hard_docs, model))
    assert len(rows) == hard_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.fit_quality(no_docs, labels) is None and quality.fit_quality(hard_docs, labels.where("false")) is None
    assert {r["score"] for r in run(quality.score_quality(hard_docs, None))} == {0.5}
    assert run(quality.score_quality(no_docs, model)) == []


def test_decontaminate(hard_docs, no_docs, bench):
    assert run(decontaminate.find_contaminated(hard_docs, bench)) == []
    assert decontaminate.drop_contaminated(hard_docs, bench).count() == hard_docs.count()
    assert run(decontaminate.find_contaminated(no_docs, bench)) == []
    assert run(decontaminate.find_contaminated(hard_docs, bench.where("false"))) == []


def test_packing(hard_docs, no_docs):
    rows = run(packing.pack(hard_docs))
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["key"] in (1, 2)) == 2
    assert sum(r["length"] for r in rows if r["key"] == 8) == 2 * next(r["doc_tokens"] for r in rows if r["key"] == 8)
    assert run(packing.pack(no_docs)) == []


def test_fingerprints(hard_docs, no_docs):
    rows = run(fingerprints.compare_with_edits(hard_docs, fingerprints.fit_lexicon(hard_docs)))
    assert len(rows) == hard_docs.count()
    by = {r["key"]: r for r in rows if r["key"]}
    assert by[4]["fingerprint"] == by[5]["fingerprint"] and by[1]["fingerprint"] == "z" and by[5]["near_next"] == 1.0
    assert run(fingerprints.compare_with_edits(no_docs, fingerprints.fit_lexicon(no_docs))) == []


PAGES = [(None, None, None), (1, "http://h.example.net/en/x", None), (2, "no url", ""), (3, "https://A.Example.COM/de/y?q#f", "<p>one<p>two"), (3, "https://A.Example.COM/de/y?q#f", "<p>one<p>two"), (4, "://", "<" * 50 + "div" * 1000), (5, "https://h.example.net", "<div>" * 3000 + "deep")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "c", "c", 1) for p in PAGES], "page_id long, url string, html string, key string, host string, tokens int")


def test_html(spark, pages):
    rows = run(html_extract.extract_pages(pages))
    assert len(rows) == len(PAGES) and [r["text"] for r in rows if r["key"] == 3] == ["one\n\ntwo"] * 2
    assert {r["text"] for r in rows if r["key"] in (None, 1, 2)} == {""} and next(r["text"] for r in rows if r["key"] == 5) == "deep"
    assert run(html_extract.extract_pages(pages.where("false"))) == []


def test_urls(pages):
    rows = run(url_filter.judge_urls(pages))
    by = {r["key"]: r for r in rows}
    assert len(rows) == len(PAGES) and by[3]["rule"] == "example.com/de/" and by[3]["host"] == "a.example.com" and by[1]["verdict"] == "allow" and by[1]["rule"] == "example.net/en/"
    assert (by[2]["host"], by[2]["path"], by[2]["rule"]) == ("", "", None) and by[5]["rule"] is None
    assert sorted(map(str, run(url_filter.judge_urls(pages, trie_rules=0)))) == sorted(map(str, rows))
    assert run(url_filter.judge_urls(pages.where("false"))) == []


@pytest.mark.parametrize("stage", [queries.stage_language_id, queries.stage_line_dedup, queries.stage_ngram_join, queries.stage_decontaminate])
def test_stages(spark, data, stage, hard_docs, no_docs):
    out = stage(spark, hard_docs, data)
    assert out.columns == hard_docs.columns and out.count() <= hard_docs.count()
    assert stage(spark, no_docs, data).count() == 0


def test_last_stage(spark, data, hard_docs, no_docs):
    assert queries.stage_packing(spark, hard_docs, data).count() >= hard_docs.count()
    assert queries.stage_packing(spark, no_docs, data).count() == 0
