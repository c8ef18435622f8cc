"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fieldloom.llm import content_sort, digests, fair_mix, language, line_windows, lsh_forest, packing, secrets, toxicity, url_rules

R = random.Random(3)
WORDS = ["".join(R.choices("abcdefghij", k=R.randint(2, 8))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


LONG = prose(300_000, 1)
ROWS = [
    (1, prose(80, 2), "en", "a"), (1, prose(80, 2), "en", "a"), (2, prose(80, 2), None, None), (3, None, "de", "a"), (4, "", None, "b"), (5, " \t \n", "en", "b"),
    (6, LONG, "en", "a"), (None, prose(60, 5), "de", None), (None, None, None, None), (7, "...!!! ???", "de", "b"), (8, "ein " * 50, "de", "c"), (9, "ö\n\nö\n\nö", "de", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
CLASH = ("tokens", "group_id", "is_kept", "kept_id", "key", "finish", "slice", "weight", "probability", "toxic", "digest", "nearest", "l", "n", "h1", "pos", "block", "bin", "items", "u", "v", "row", "canonical_url")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, SCHEMA)
    return base.selectExpr("*", *[f"'x' AS {c}" for c in CLASH]).repartition(2)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def toxic_model():
    texts = [prose(40, k) + (" you are an idiot and a moron" if k % 3 == 0 else "") for k in range(120)]
    return toxicity.train(texts, np.array([k % 3 == 0 for k in range(120)]))


@pytest.fixture(scope="module")
def scanner():
    return secrets.train(secrets.findings.labelled(600))


#: Names that operators could use for columns of their own.
HELPERS = ("__gone", "__gone_0", "__taken", "__norm", "__hash", "__head", "__first", "__rank", "__id", "__toxic", "__row", "id", "rest", "first", "rank", "head", "hash", "norm")


def test_columns_with_helpers_names_pass_unchanged(spark, toxic_model):
    rows = [(i, t, "en", s) for i, t, _, s in ROWS if i not in (6,)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"concat('mine ', coalesce(doc_id, 0), ' ', '{c}') AS `{c}`" for c in HELPERS])
    for made in (
        lsh_forest.drop_near_duplicates(docs), content_sort.drop_exact_duplicates(docs), fair_mix.mix_documents(docs, budget_tokens=1 << 40), toxicity.drop_toxic(docs, toxic_model)
    ):
        assert made.columns == docs.columns
        got = made.collect()
        assert got and all(r[c] == f"mine {r.doc_id or 0} {c}" for r in got for c in HELPERS)


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_secret_scan(docs, empty, scanner):
    rows = secrets.scan_secrets(docs, scanner)
    assert rows.columns == ["doc_id", "start", "length", "finding", "probability"]
    texts = {(i, t) for i, t, *_ in ROWS}
    for r in rows.collect():
        assert any(i == r.doc_id and t and t[r.start : r.start + r.length] == r.finding for i, t in texts)
    assert secrets.scan_secrets(empty, scanner).count() == 0


def test_url_filters(spark):
    rows = [(1, "http://x.casino.com/a"), (1, "http://x.casino.com/a"), (2, None), (None, ""), (3, "http://ok.example/" + "a" * 100_000), (4, "  HTTP://Ads.Example.COM:80/?utm_source=1  ")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'x' AS rules", "'x' AS canonical_url", "'x' AS blocked")
    got = by_id(url_rules.filter_urls(pages), "page_id")
    assert [r.blocked for r in got[1]] == [True, True]
    assert (got[2][0].canonical_url, got[2][0].rules, got[2][0].blocked) == (None, "", False)
    assert (got[None][0].canonical_url, got[None][0].blocked) == ("", False)
    assert not got[3][0].blocked
    assert (got[4][0].canonical_url, got[4][0].blocked) == ("http://ads.example.com/", True)
    assert url_rules.filter_urls(pages.limit(0)).count() == 0
    assert not any(r.blocked for r in url_rules.filter_urls(pages, rules=()).collect())


def test_near_duplicates(docs, empty):
    got = {r.doc_id: (r.group_id, r.is_kept) for r in lsh_forest.near_duplicates(docs).collect()}
    assert set(got) == set(range(1, 10))
    assert got[2] == (1, False)
    assert all(got[k] == (k, True) for k in got if k != 2)
    assert lsh_forest.near_duplicates(empty).count() == 0


def test_near_duplicates_dropped(docs):
    kept = lsh_forest.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i, *_ in ROWS if i != 2)


def test_exact_duplicates(docs, empty):
    rows = content_sort.exact_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    first = [r for r in rows if r.kept_id == 1]
    assert len(first) == 3 and sum(r.is_kept for r in first) == 1 and all(r.doc_id == 1 for r in first if r.is_kept)
    assert {(r.doc_id, r.kept_id, r.is_kept) for r in rows if r.doc_id in (3, 4, 5)} == {(3, 3, True), (4, 4, True), (5, 4, False)}
    assert sum(r.doc_id is None and r.kept_id is None and r.is_kept for r in rows) == 2
    kept = content_sort.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3
    assert content_sort.exact_duplicates(empty).count() == content_sort.drop_exact_duplicates(empty).count() == 0


def test_language(docs, empty):
    made = language.train_dictionaries(docs)
    assert set(made) <= {"en", "de"} and made
    got = by_id(language.identify(docs, made))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [(r.language, r.margin) for r in got[3] + got[4]] == [("und", 0.0)] * 2
    assert language.train_dictionaries(empty) == {}
    assert {r.language for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.identify(empty, made).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, capacity=512, block=8).collect()
    fill = {}
    for r in rows:
        fill[r.bin] = fill.get(r.bin, 0) + r.tokens
    assert max(fill.values()) <= 512
    assert sum(r.tokens for r in rows) == sum(-(-len(t or "") // 4) for _, t, *_ in ROWS)
    assert sum(r.doc_id == 6 for r in rows) == -(-(-(-len(LONG) // 4)) // 512)
    assert sum(r.doc_id in (3, 4) and r.tokens == 0 for r in rows) == 2
    assert packing.pack(empty).count() == 0


def test_lines(docs, empty):
    got = by_id(line_windows.dedup_lines(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[3][0].clean_text is None and got[4][0].clean_text == ""
    assert got[6][0].clean_text == LONG
    assert (got[9][0].clean_text, got[9][0].removed_lines) == ("ö\n\nö", 2)
    assert line_windows.dedup_lines(empty).count() == 0


def test_toxicity(docs, empty, toxic_model):
    got = by_id(toxicity.classify(docs, toxic_model))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [r.probability for r in got[3] + got[4]] == [0.0, 0.0]
    kept = toxicity.drop_toxic(docs, toxic_model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.toxic for rows in got.values() for r in rows)
    assert toxicity.classify(empty, toxic_model).count() == toxicity.drop_toxic(empty, toxic_model).count() == 0


def test_toxicity_without_labels(spark, docs):
    for labels in ([], [(1, None), (None, 1)], [(3, 1)]):
        model = toxicity.train_from(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert {r.probability for r in toxicity.classify(docs, model).collect()} == {0.0}


def test_mix(docs, empty):
    rows = fair_mix.plan_mix(docs).collect()
    assert [r.cum_tokens for r in rows] == list(np.cumsum([r.tokens for r in rows]))
    assert len({r.doc_id for r in rows}) == len(rows)
    everything = fair_mix.plan_mix(docs, budget_tokens=1 << 40).collect()
    assert {r.doc_id for r in everything} == {i for i, *_ in ROWS}
    assert sum(r.tokens for r in everything) == sum(-(-len(t or "") // 4) for _, t, *_ in ROWS)
    kept = fair_mix.mix_documents(docs, budget_tokens=1 << 40)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert all(r.tokens == 0 for r in fair_mix.plan_mix(docs, budget_tokens=0).collect())
    assert fair_mix.plan_mix(empty).count() == 0
    with pytest.raises(ValueError):
        fair_mix.plan_mix(docs, weights={"a": 0.0})


def test_fingerprints(docs, empty):
    rank = digests.ranks(digests.level_counts(docs))
    made = digests.fingerprint(docs, rank)
    got = by_id(made)
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[1][0].digest == got[1][1].digest == got[2][0].digest and got[1][0].n_features > 10
    assert [(r.n_features, bytes(r.digest)) for r in got[3] + got[4]] == [(0, b"")] * 2
    reference = made.where("doc_id IN (2, 6)").withColumnRenamed("doc_id", "item_id")
    near = by_id(digests.match(made, reference))
    assert near[1][0].nearest == 2 and near[6][0].nearest == 6 and near[3][0].nearest is None and near[3][0].overlap is None
    assert digests.ranks(digests.level_counts(empty)).min() == 1023
    assert digests.fingerprint(empty, rank).count() == 0
    assert {r.nearest for r in digests.match(made, reference.limit(0)).collect()} == {None}
