"""Dictionaries, cascades, groups, clusters, ontologies, sources, sinks and the whole flow on literal rows."""

from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.errors import DiscoveryError, NormalizationError, SchemaError
from fieldloom.functions.jsonschema import object_of
from fieldloom.operators import canonical, cascade, clustering, discovery, mapping, ontology, profile, registry
from fieldloom.operators.checkpoint import Checkpoint, versions
from fieldloom.operators.extraction import LLMDirectExtraction
from fieldloom.pipeline import Pipeline
from fieldloom.providers import CannedClient, HashEmbeddings, RuleClient
from fieldloom.schemas import Schema
from fieldloom.sources import documents, ontologies, sinks
from fieldloom.streaming import incremental


def values(spark, items):
    return spark.createDataFrame([(v, i) for i, v in enumerate(items)], "value string, ord bigint")


def as_dict(df, key="raw", to="canonical"):
    return {r[key]: r[to] for r in df.collect()}


D = mapping.DictionaryNormalization


def test_dictionaries(spark):
    v = values(spark, ["Nyc", "Chicago", "Nyc", None])
    got = {r.raw: (r.canonical, r.confidence) for r in D({"NYC": "New York", "nyc": "N.Y."}, case_insensitive=True).normalize(v).collect()}
    assert got == {"Nyc": ("N.Y.", 1.0), "Chicago": ("Chicago", 0.0)}
    assert as_dict(D({"NYC": "New York"}).normalize(v))["Nyc"] == "Nyc"
    with pytest.raises(Exception, match="no entry"):
        D({}, passthrough_unmapped=False).normalize(v).collect()
    assert D({"a": "b"}).normalize(values(spark, [])).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cc")), min_size=1, max_size=12), min_size=1, max_size=12), st.dictionaries(st.text("abcAB", min_size=1, max_size=3), st.text("xyz", max_size=3), max_size=6))
def test_every_value_is_mapped(spark, items, table):
    got = as_dict(D(table).normalize(values(spark, items)))
    assert got == {v: table.get(v, v) for v in items}


def test_apply(spark):
    rows = spark.createDataFrame([(1, 5, ["a", None]), (2, None, None), (3, 7, [])], "k int, n int, l array<string>")
    m = D({"5": "five", "a": "A"}).normalize(values(spark, ["5", "a"]))
    assert as_dict(mapping.apply_mapping(rows, m, "n"), "k", "n") == {1: "five", 2: None, 3: "7"}
    assert as_dict(mapping.apply_mapping(rows, m, "l"), "k", "l") == {1: ["A", "None"], 2: None, 3: []}


def test_explanations(spark):
    m = D({"a": "X", "b": "X"}).normalize(values(spark, ["a", "b", "c"]))
    assert mapping.explain_value(m, "a") == "a → X (2 spellings)" and mapping.explain_value(m, "c") == "c → c"
    assert "not in the mapping" in mapping.explain_value(m, "z")
    unsure = m.withColumn("confidence", F.lit(None).cast("double"))
    assert as_dict(mapping.to_dictionary(unsure, 0.8)) == {"a": "X", "b": "X"}


def test_composite(spark):
    c = mapping.CompositeNormalization({"f": D({"a": "A"})})
    assert as_dict(c.normalize(values(spark, ["a"]), "f")) == {"a": "A"}
    with pytest.raises(NormalizationError):
        c.normalize(values(spark, ["a"]), "g")


def test_cascades(spark):
    v = values(spark, ["a", "b", "c", "A"])
    got = cascade.CascadeNormalization([D({"a": "A"}), D({"b": "B", "A": "Z"})]).normalize(v)
    assert as_dict(got) == {"a": "A", "b": "B", "c": "c", "A": "Z"}
    assert {(r.step, r.mapped, r.remaining) for r in cascade.step_counts(got, 2).collect()} == {(0, 1, 3), (1, 2, 1)}
    with pytest.raises(ValueError):
        cascade.CascadeNormalization([D({})], [0.1, 0.2])


class Sure:
    def __init__(self, table, confidence):
        self.table, self.confidence = table, confidence

    def normalize(self, v, field=""):
        return D(self.table).normalize(v, field).withColumn("confidence", F.lit(self.confidence).cast("double"))


def test_cascade_confidence(spark):
    v = values(spark, ["a"])
    route = lambda second: as_dict(cascade.CascadeNormalization([Sure({"a": "X"}, 0.5), second], [0.8, 0.9]).normalize(v))["a"]
    assert route(Sure({"a": "Y"}, 0.95)) == "Y" and route(Sure({}, 0.95)) == "a" and route(Sure({"a": "Y"}, None)) == "a"


def test_learning(spark, tmp_path):
    v = values(spark, ["a", "b"])
    c = cascade.CascadeNormalization([Sure({"a": "A"}, 0.9)], [0.8])
    learned = c.learn(c.normalize(v))
    assert len(learned.steps) == 2 and {r.raw: r.step for r in learned.normalize(v).collect()} == {"a": 0, "b": None}
    cache = cascade.LearnedDictionaryCache(str(tmp_path / "learned"))
    assert cache.load_dictionary(spark, "f") is None and cache.load_all(spark).count() == 0
    for conf, to in ((0.9, "A"), (0.8, "B"), (0.95, "C")):
        cache.save(Sure({"a": to}, conf).normalize(v, "f"))
    assert versions(spark, cache.path) == [1, 2, 3]
    assert as_dict(cache.load_dictionary(spark, "f").normalize(values(spark, ["A", "q"]))) == {"A": "C", "q": "q"}


@pytest.mark.parametrize("old, new, keeps", [(0.9, 0.8, "old"), (0.8, 0.8, "old"), (0.8, 0.9, "new")])
def test_upsert(spark, old, new, keeps):
    row = lambda to, c: spark.createDataFrame([("f", "r", to, c, "s")], "field string, raw string, canonical string, confidence double, source string")
    assert cascade.upsert_learned(row("old", old), row("new", new)).first().canonical == keeps


def test_groups(spark):
    g = spark.createDataFrame([(0, "Red ", ["r"], "x"), (1, "red", ["R", "r"], ""), (2, "RED", ["R"], "y"), (3, "B", ["b"], None)], canonical.GROUPS)
    got = {r.canonical: (r.members, r.rationale) for r in canonical.merge_groups(g).collect()}
    assert got == {"Red ": (["r", "R"], "x; y"), "B": (["b"], "")}
    three = spark.createDataFrame([(0, "A", ["a"], ""), (1, "B", ["b"], ""), (2, "C", ["c"], "")], canonical.GROUPS)
    told = spark.createDataFrame([(0, "AB", ["A", "B", "missing"]), (1, "no", ["A"])], "ord bigint, canonical string, merge array<string>")
    assert as_dict(canonical.merge_by_instructions(three, told), "canonical", "members") == {"AB": ["a", "b"], "C": ["c"]}
    assert canonical.parse_groups('{"groups": [{"canonical": "x", "members": ["x1"]}, {"canonical": "", "members": ["q"]}, 5]}', ["x1", "orphan"]) == [("x", ["x1"], ""), ("orphan", ["orphan"], "ungrouped")]


def fold(prompt):
    groups = {}
    for line in prompt.split("\n"):
        if line.startswith("- "):
            groups.setdefault(line[2:].lower(), []).append(line[2:])
    return json.dumps([{"canonical": g[0], "members": g} for g in groups.values()])


def test_model_groups(spark):
    v = values(spark, ["New York", "new york", "LA", "la", "LA"])
    assert as_dict(canonical.LLMCanonicalization(RuleClient(fold)).normalize(v)) == {"New York": "New York", "new york": "New York", "LA": "LA", "la": "LA"}
    batched = canonical.LLMCanonicalization(RuleClient(fold), batch_size=2, max_values_per_prompt=3).normalize(v)
    assert as_dict(batched)["la"] == "LA" and batched.count() == 4
    failing = canonical.LLMCanonicalization(CannedClient(["oops"])).normalize(v)
    assert as_dict(failing) == {x: x for x in ("New York", "new york", "LA", "la")}
    assert as_dict(canonical.LLMCanonicalization(CannedClient([])).normalize(values(spark, ["one", "one"]))) == {"one": "one"}


def test_profiles(spark):
    rows = spark.createDataFrame([(x, "p", [x], "long " * 20 + x, None) for x in "aabbccaabc"], "kind string, provider string, tags array<string>, body string, gone string")
    picked = profile.StatisticalFieldSelector().passing(rows).collect()
    assert {(r.field, r.n_unique, r.unique_ratio) for r in picked} == {("kind", 3, 0.3), ("tags", 3, 0.3)}
    assert profile.StatisticalFieldSelector().select(rows) == ["kind", "tags"]
    assert {r.field: r.coverage for r in profile.coverage(rows, ["kind", "gone", "none"]).collect()} == {"kind": 1.0, "gone": 0.0, "none": 0.0}
    assert profile.coverage(rows.limit(0), ["kind"]).count() == 0 and profile.coverage(rows, []).count() == 0
    edge = spark.createDataFrame([(v, w) for v, w in zip("aabbcc", ["x" * 50, "y" * 50, "z" * 50] * 2)], "half string, long string")
    assert profile.StatisticalFieldSelector().select(edge) == ["half", "long"]
    assert [r.line for r in profile.coverage_listing(profile.coverage(rows, ["kind", "gone"])).collect()] == ["gone: 0% (low)", "kind: 100%"]


def test_k_means_steps(spark):
    pts = spark.createDataFrame([(i, [float(x), float(y)]) for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 1), (1, 1)])], "id int, v array<double>")
    cs = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [9.0, 9.0])], "k int, c array<double>")
    got = clustering.assign(pts, cs)
    assert as_dict(got, "id", "k") == {0: 0, 1: 0, 2: 0, 3: 1}
    new = as_dict(clustering.update(got.select("k", "v"), cs), "k", "c")
    assert new[0] == pytest.approx([1 / 3, 1 / 3]) and new[1] == [1.0, 1.0] and new[2] == [9.0, 9.0]
    assert clustering.kmeans_pp(np.ones((5, 2)), 3).shape == (3, 2)
    s = clustering.silhouette(got.select("id", "v", "k")).collect()
    x = np.array([[0, 0], [1, 0], [0, 1], [1, 1]], float)
    assert np.mean([r.silhouette for r in s]) == pytest.approx(clustering.silhouette_score(x, np.array([0, 0, 0, 1])))


def test_silhouette_blocks(spark, monkeypatch):
    x, y = blobs()
    pts = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y))] + [(99, [5.0, 5.0, 5.0], 9)], "id int, v array<double>, k int")
    monkeypatch.setattr(clustering, "BLOCK_BYTES", 600)
    got = as_dict(clustering.silhouette(pts), "id", "silhouette")
    assert len(got) == 46 and got[99] == 0.0
    assert sum(got.values()) / 46 == pytest.approx(clustering.silhouette_score(np.vstack([x, [[5, 5, 5]]]), np.append(y, 9)))


def test_mode_names(spark):
    rows = spark.createDataFrame([(0, "NY", 1, 0), (0, "New York", 5, 1), (0, "NYC", 5, 2), (-1, "p", 9, 3), (-1, "q", 1, 4)], "label int, value string, freq int, first_ord int")
    assert as_dict(clustering.mode_canonical(rows), "value") == {"NY": "New York", "New York": "New York", "NYC": "New York", "p": "p", "q": "q"}


def blobs():
    r = np.random.default_rng(0)
    centres = np.array([[10, 0, 0], [0, 10, 0], [0, 0, 10]], float)
    return np.concatenate([c + r.normal(0, 0.3, (15, 3)) for c in centres]), np.repeat([0, 1, 2], 15)


@pytest.mark.parametrize("run", [lambda x: clustering.agglomerative(x, 0.2), lambda x: clustering.hdbscan(x, 5)])
def test_clusters_of_blobs(run):
    x, y = blobs()
    got = run(x)
    for k in range(3):
        names, n = np.unique(got[(y == k) & (got >= 0)], return_counts=True)
        assert len(names) == 1 and n[0] >= 10
    assert clustering.auto_k(x) == 3


def test_clustering_strategies(spark):
    v = values(spark, ["colour red", "colour red", "colour  red", "zebra", "Zebra", "unrelated thing"])
    near = as_dict(clustering.EmbeddingClustering(HashEmbeddings(), similarity_threshold=0.7).normalize(v, "f"))
    assert near["colour  red"] == near["colour red"] == "colour red" and near["Zebra"] == near["zebra"] == "zebra"
    assert as_dict(clustering.EmbeddingClustering(HashEmbeddings()).normalize(values(spark, ["x"]), "f")) == {"x": "x"}
    with pytest.raises(NormalizationError):
        clustering.EmbeddingClustering(HashEmbeddings(), "what").normalize(v)
    got = as_dict(clustering.KLLMeansClustering(HashEmbeddings(), RuleClient(lambda p: "named"), num_clusters=2).normalize(v, "f"))
    assert set(got) == {"colour red", "colour  red", "zebra", "Zebra", "unrelated thing"}
    assert as_dict(clustering.KLLMeansClustering(HashEmbeddings()).normalize(values(spark, ["a", "b"]))) == {"a": "a", "b": "b"}


ENTRIES = [("id1", "Cold", ["Chill"]), ("id2", "cold", None), ("id3", "Fever", [])]


def test_homonyms(spark):
    e = spark.createDataFrame(ENTRIES, "id string, name string, synonyms array<string>")
    shown = {(r.id, r.text): r.shown for r in ontology.index_texts(e).collect()}
    assert shown == {("id1", "Cold"): "Cold (also known as: Chill; [id1])", ("id1", "Chill"): "Chill", ("id2", "cold"): "cold ([id2])", ("id3", "Fever"): "Fever"}


def test_search_crowding_and_parts(spark, monkeypatch):
    index = spark.createDataFrame([("x", "X", i, [1.0, 0.01 * i]) for i in range(7)] + [("y", "Y", 0, [0.0, 1.0])], "id string, name string, text_ord int, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("zero", [0.0, 0.0])], "value string, embedding array<double>")
    for find in (ontology.search, ontology.search_matrix):
        assert [r.id for r in find(q.where("value = 'q'"), index, 2).collect()] == ["x"]
        assert {r.score for r in find(q.where("value = 'zero'"), index, 2).collect()} == {0.0}
    whole = {(r.value, r.id, round(r.score, 9)) for r in ontology.search_matrix(q, index, 2).collect()}
    monkeypatch.setattr(ontology, "INDEX_BYTES", 600)
    assert {(r.value, r.id, round(r.score, 9)) for r in ontology.search_matrix(q, index, 2).collect()} == whole
    assert ontology.search_matrix(q, index.limit(0)).count() == 0


def test_candidates(spark):
    c = lambda *rows: spark.createDataFrame([("v", i, i, s) for i, s in rows], "value string, id string, name string, score double")
    got = ontology.merge_candidates(c(("e1", 0.9), ("e2", 0.5)), c(("e2", 0.8), ("e3", 0.7)), 2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("e1", 0.9), ("e2", 0.8)]
    some = [{"id": "a", "score": 0.9}, {"id": "b", "score": 0.5}]
    assert ontology.parse_rerank("junk", some) == ("a", 0.9, None)
    assert ontology.parse_rerank('{"id": "b", "confidence": 0.7, "rationale": "r"}', some) == ("b", 0.7, "r")
    assert ontology.parse_rerank('{"id": "zz", "confidence": 1}', some)[:2] == ("a", 0.0) and ontology.parse_rerank("{}", [])[0] is None


def test_ontology_mapping(spark):
    e = spark.createDataFrame([("h1", "Seizure", ["Fits", "Epileptic seizure"]), ("h2", "Ataxia", []), ("h3", "Fever", None)], "id string, name string, synonyms array<string>")
    v = values(spark, ["seizures", "fever", "pyrexia"])
    got = {r.raw: r for r in ontology.OntologyMapping(e, HashEmbeddings(256)).normalize(v).collect()}
    assert (got["seizures"].canonical, got["seizures"].ontology_id, got["fever"].confidence) == ("Seizure", "h1", pytest.approx(1.0))
    assert got["fever"].explanation == "→ Fever (h3), confidence=1.000"
    strict = as_dict(ontology.OntologyMapping(e, HashEmbeddings(256), confidence_threshold=0.99).normalize(v))
    assert strict["pyrexia"] == "pyrexia" and strict["fever"] == "Fever"
    model = RuleClient(lambda p: '{"pyrexia": ["fever"]}' if p.startswith("Give") else '{"id": "h3", "confidence": 0.9, "rationale": "same"}')
    better = {r.raw: r for r in ontology.OntologyMapping(e, HashEmbeddings(256), model, augment_queries=True, use_rerank=True).normalize(v).collect()}
    assert better["pyrexia"].canonical == "Fever" and better["pyrexia"].explanation.endswith("confidence=0.900: same")
    with pytest.raises(NormalizationError):
        ontology.OntologyMapping(e, HashEmbeddings(), use_rerank=True).normalize(v)


def test_index_store(spark):
    e = spark.createDataFrame([("h1", "a", None), ("h2", "b", None)], "id string, name string, synonyms array<string>")
    stored = spark.createDataFrame([("a", [7.0] * 4), ("old", [1.0] * 4)], "shown string, embedding array<float>")
    got = {r.shown: list(r.embedding) for r in ontology.build_index(e, HashEmbeddings(4), stored).collect()}
    assert set(got) == {"a", "b"} and got["a"] == [7.0] * 4


def test_ontology_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text('id,name,synonyms\n1,Cold,"Chill; ;Flu"\n2,Fever,\n')
    (tmp_path / "o.json").write_text(json.dumps([{"id": "1", "name": "Cold", "synonyms": ["Chill"]}, {"id": "2", "name": "x"}]))
    (tmp_path / "bad.json").write_text(json.dumps([{"id": "1", "name": "Cold"}, {"name": "x"}]))
    (tmp_path / "no.csv").write_text("id,label\n1,x\n")
    (tmp_path / "o.obo").write_text('format-version: 1.2\n\n[Term]\nid: A:1\nname: Cold\nsynonym: "Chill" EXACT []\nsynonym: "a \\"b\\"" EXACT []\n\n[Term]\nid: A:2\nname: Old\nis_obsolete: true\n\n[Typedef]\nid: part_of\nname: part of\n')
    load = lambda n: {r.id: (r.name, r.synonyms) for r in ontologies.load_ontology(spark, str(tmp_path / n)).collect()}
    assert load("o.csv") == {"1": ("Cold", ["Chill", "Flu"]), "2": ("Fever", [])}
    assert load("o.json") == {"1": ("Cold", ["Chill"]), "2": ("x", [])}
    assert load("o.obo") == {"A:1": ("Cold", ["Chill", 'a \\"b\\"'])}
    with pytest.raises(Exception, match="entry 1"):
        load("bad.json")
    with pytest.raises(ValueError):
        load("no.csv")
    with pytest.raises(NormalizationError):
        ontologies.load_ontology(spark, "x.xml")


def test_document_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("b.txt", b"two"), ("a.txt", "ö1".encode()), ("bad.txt", b"\xff\xfe\x00"), ("sub/c.txt", b"three"), ("n.md", b"no")):
        (tmp_path / name).write_bytes(data)
    got = [(r.doc_id, r.content) for r in documents.load_glob(spark, f"{tmp_path}/*.txt").orderBy("doc_ord").collect()]
    assert got == [("a.txt", "ö1"), ("b.txt", "two")]
    assert {r.doc_id for r in documents.load_glob(spark, f"{tmp_path}/**/*.txt").collect()} == {"a.txt", "b.txt", "c.txt"}
    assert documents.load_glob(spark, f"{tmp_path}/none/*.txt").count() == 0
    both = documents.resolve(spark, [f"{tmp_path}/b.txt", f"{tmp_path}/*.txt"]).orderBy("doc_ord").collect()
    assert [r.doc_id for r in both] == ["b.txt", "a.txt", "b.txt"]
    assert documents.load_samples(spark, "tickets").first().source == "samples:tickets"
    with pytest.raises(ValueError):
        documents.load_samples(spark, "zzz")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", 'q"'], None)], "k int, l array<string>, s string")
    sinks.to_csv(df, f"{tmp_path}/c", single_file=True)
    assert spark.read.csv(f"{tmp_path}/c", header=True, escape='"').first().l == '["a","q\\""]'
    sinks.to_json(df, f"{tmp_path}/j")
    assert json.loads(spark.read.text(f"{tmp_path}/j").first().value) == {"k": 1, "l": ["a", 'q"'], "s": None}
    sinks.to_parquet(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").first() == df.first()
    array = lambda d: (sinks.to_json_array(d, f"{tmp_path}/a.json"), json.loads((tmp_path / "a.json").read_text()))[1]
    assert array(df) == [{"k": 1, "l": ["a", 'q"'], "s": None}] and array(df.limit(0)) == []
    assert array(spark.range(5).orderBy("id")) == [{"id": k} for k in range(5)]


def test_registry(spark, tmp_path):
    reg = registry.SchemaRegistry(spark, f"{tmp_path}/r")
    a, b = Schema(object_of(x="string"), {"x": {"d": 1}}, ["Given:1"]), Schema(object_of(y={}, z={}))
    assert [reg.register(a, timestamp=1.0), reg.register(b, "given", timestamp=2.0), reg.register(b, timestamp=3.0)] == ["given:v1", "given:v2", "schema_2fields:v1"]
    assert reg.get("given").json_schema == b.json_schema and reg.get("given", 1) == a and reg.get("given", 9) is None and reg.get("zz") is None
    assert [(r.name, r.version, r.n_fields) for r in reg.list_schemas().collect()] == [("given", 1, 1), ("given", 2, 2), ("schema_2fields", 1, 2)]
    assert reg.diff(a, b) == {"added": ["y", "z"], "removed": ["x"], "changed": []} and registry.auto_name(Schema({})) == "unnamed"


LINES = object_of(product="string", rating="integer", brand="string")


def model(prompt):
    if prompt.startswith("Extract"):
        return discovery.field_lines_extract(prompt)
    if prompt.startswith("Reply with a JSON Schema"):
        return discovery.field_lines_rule(prompt)
    if prompt.startswith("Reply with add_fields"):
        return json.dumps({"add_fields": {"color": {"type": "string"}}, "remove_fields": ["verdict"]})
    if prompt.startswith("Enrich"):
        return json.dumps({"fields": {"product": {"description": "what"}, "zz": {"description": "no"}}})
    if prompt.startswith("Which fields"):
        return '["brand", "nope"]'
    return fold(prompt)


def test_discovery(spark):
    docs, client = documents.load_samples(spark), RuleClient(model)
    first = discovery.SinglePassDiscovery(client).discover(docs)
    assert set(first.json_schema["properties"]) == {"product", "rating", "brand", "verdict"} and first.json_schema["properties"]["rating"] == {"type": "integer"}
    three = discovery.ThreeStageDiscovery(client)
    assert set(three.discover(docs).json_schema["properties"]) == {"product", "rating", "brand", "color"}
    assert three.reports["stage2"]["product"] == 1.0
    reviewed = discovery.ThreeStageDiscovery(client, human_review=True).discover(docs)
    assert reviewed.lineage[-1].endswith("stage2")
    with pytest.raises(DiscoveryError):
        discovery.SinglePassDiscovery(client).discover(docs.limit(0))
    best = discovery.SchemaOptimizer(client, 2).optimize(first, docs)
    assert best.field_metadata == {"product": {"description": "what"}} and best.lineage[-1] == "SchemaOptimizer:iter2" and best.json_schema == first.json_schema
    out = discovery.refine_schema(best, discovery.SchemaFeedback(remove_fields=["product"], instruction="do"), client)
    assert out.field_metadata == {} and out.lineage[-2:] == ["refine:instruction", "refine:explicit"]
    assert discovery.refine_schema(first, discovery.SchemaFeedback()).lineage[-1] == "refine:noop"


def test_whole_flow(spark, tmp_path):
    flow = Pipeline.quick(RuleClient(model), pricing={"rules": (1.0, 1.0)})
    got = flow.run(spark, documents.load_samples(spark))
    assert got.records.count() == 10 and got.errors.count() == 0
    brands = {r.brand for r in got.normalized_records().collect()}
    assert len(brands) == 3 and got.report().where("is_total").first().calls == 13
    calls = {r.stage: r.calls for r in got.report().where("NOT is_total").collect()}
    assert calls == {"discovery": 1, "extraction": 10, "selection": 1, "normalization": 1}
    assert got.usage.where("latency_ms <= 0").count() == 0
    got.to_parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    assert flow.estimate_cost(documents.load_samples(spark)).first().n_documents == 10


def test_resume_and_budget(spark, tmp_path):
    docs = documents.load_samples(spark)
    calls = Pipeline(extraction=LLMDirectExtraction(RuleClient(model)), checkpoint_path=f"{tmp_path}/cp")
    assert calls.run(spark, docs.where("doc_ord < 2"), schema=LINES).records.count() == 2
    cp = Checkpoint(spark, f"{tmp_path}/cp")
    assert {r.doc_id for r in cp.processed().collect()} == {"reviews_0", "reviews_1"} and cp.load_schema().json_schema == LINES
    assert calls.run(spark, docs, schema=LINES).records.count() == 10
    poor = Pipeline(extraction=LLMDirectExtraction(RuleClient(model)), max_cost_usd=1e-9, batches=5, pricing={"rules": (1.0, 1.0)}).run(spark, docs, schema=LINES)
    assert poor.stopped is not None and 0 < poor.records.count() < 10
    with pytest.raises(SchemaError):
        calls.__class__().run(spark, docs)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(0, "d", "a" * 25, None)], "doc_ord bigint, doc_id string, content string, source string").write.parquet(f"{tmp_path}/in")
    q = incremental.stream_chunks(incremental.stream_documents(spark, f"{tmp_path}/in"), 10, 3).writeStream.format("parquet").option("path", f"{tmp_path}/chunks").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == 4
    spark.createDataFrame([("a",), ("b",)], "value string").write.parquet(f"{tmp_path}/v")
    cache = cascade.LearnedDictionaryCache(f"{tmp_path}/learned")
    stream = spark.readStream.schema("value string").parquet(f"{tmp_path}/v")
    incremental.normalize_stream(stream, D({"a": "A"}), "f", cache, f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination(120)
    assert as_dict(spark.read.parquet(f"{tmp_path}/out")) == {"a": "A", "b": "b"} and as_dict(cache.load_all(spark)) == {"a": "A"}


def test_csv_keeps_texts_as_they_are(spark, tmp_path):
    texts = ["", None, " a", "a ", "\t", "\n", "a\r\nb", "\r", '"\n', '"', 'a\\"b', "\0", 'x\0"', "null", "a,b"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    sinks.to_csv(df, f"{tmp_path}/odd")
    assert [r.t for r in sorted(sinks.read_csv(spark, f"{tmp_path}/odd").collect(), key=lambda r: int(r.k))] == texts


def test_a_few_products_are_held_at_a_time_and_ties_go_to_the_first_text(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = np.repeat(rng.normal(size=(40, 4)), 5, axis=0)
    q = rng.normal(size=(7, 4))
    whole = np.round(q @ m.T, 12)
    want = [sorted(range(200), key=lambda j: (-w[j], j))[:9] for w in whole]
    for tile in (3, 7, 64, 4096):
        monkeypatch.setattr(ontology, "TILE", tile)
        scores, places = ontology._nearest(q, m, 9, (np.empty((7, 0)), np.empty((7, 0), dtype=np.int64)), 0)
        assert places.tolist() == want and np.allclose(scores, np.take_along_axis(whole, places, 1))


def test_silhouettes_shuffle_no_sums(spark):
    pts = spark.createDataFrame([(0, 0, [0.0]), (1, 0, [0.0]), (2, 1, [4.0]), (3, None, [1.0]), (4, 1, [4.0])], "id int, k int, v array<double>")
    out = clustering.silhouette(pts)
    assert "HashAggregate" not in out._jdf.queryExecution().toString()
    assert as_dict(out, "id", "silhouette") == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0, 4: 1.0}
