"""Model-backed operators on awkward documents and replies: what is lost, repeated, or asked twice."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import jsonschema
from fieldloom.operators import cascade, chunking, clustering, mapping, ontology, profile
from fieldloom.operators.checkpoint import versions
from fieldloom.operators.extraction import LLMDirectExtraction, conforms, lax
from fieldloom.operators.numbering import numbered
from fieldloom.pipeline import Pipeline, metered
from fieldloom.providers import CannedClient, HashEmbeddings, HttpClient, LocalEmbeddings, Meter, RuleClient, _said, in_flight
from fieldloom.errors import ProviderError
from fieldloom.schemas import DOCUMENTS
from fieldloom.sources import documents

LINE = jsonschema.object_of(line="string")


def body(prompt: str) -> str:
    return prompt.split("\n---\n", 1)[1].removesuffix("\n---")


def awkward(spark):
    rows = [(1, "a", "one", "s1", {}), (1, "a", "two", "s2", {}), (None, None, "three", None, {}), (2, "b", None, None, {}), (None, None, "four " * 30, "s3", {})]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.mark.parametrize("strategy", [
    None, chunking.FixedSizeChunking(40, 5), chunking.TokenChunking(8, 2), chunking.SentenceChunking(8, 0), chunking.RecursiveChunking(8), chunking.RecursiveChunking(8, recipe="markdown"),
    chunking.SemanticChunking(lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("float")), 0.1),
])
def test_null_and_repeated_identifiers_neither_lose_nor_multiply_documents(spark, strategy):
    client = RuleClient(lambda p: json.dumps({"line": body(p)[:9]}))
    got = LLMDirectExtraction(client, chunking=strategy).extract(awkward(spark), LINE).collect()
    first = sorted((r.doc_id or "", r.provenance.source_document, r.record.line.strip()) for r in got if not r.chunk_index)
    assert first == [("", "s3", "four four"), ("", "unknown", "three"), ("a", "s1", "one"), ("a", "s2", "two"), ("b", "b", "")]


def test_repeated_records_keep_the_evidence_of_all(spark):
    quoted = lambda v, q: {"line": {"value": v, "source_quotes": [q]}}
    client = RuleClient(lambda p: json.dumps([quoted("same", body(p)), quoted("own " + body(p), body(p))]))
    docs = documents.from_strings(spark, ["x", "y", "x"])
    got = LLMDirectExtraction(client, multi_record=True, provenance=True).extract(docs, LINE).collect()
    spans = {r.record.line: [(s.document_id, s.quote) for s in r.provenance.field_spans["line"]] for r in got}
    assert spans == {"same": [("doc_0", "x"), ("doc_1", "y"), ("doc_2", "x")], "own x": [("doc_0", "x"), ("doc_2", "x")], "own y": [("doc_1", "y")]}


class Odd:
    """Fails in every way, by the text it is asked about."""

    def complete(self, messages, *, schema=None, temperature=0.0):
        said = body(messages[0]["content"])
        if said == "boom":
            raise RuntimeError("no such thing")
        return CannedClient([{"inf": '{"n": Infinity}', "big": '{"n": 9007199254740993}', "text": '{"n": "9007199254740993"}', "huge": '{"n": 1e30}', "nan": '{"n": NaN}'}[said]]).complete(messages)


def test_replies_and_errors_of_any_kind_are_rows(spark):
    docs = documents.from_strings(spark, ["inf", "boom", "big", "text", "huge", "nan"])
    got = {r.doc_id: r for r in LLMDirectExtraction(Odd(), max_retries=0).extract(docs, jsonschema.object_of(n="integer")).collect()}
    assert [got[f"doc_{k}"].record.n for k in (2, 3)] == [9007199254740993] * 2
    assert {k: got[f"doc_{k}"].error.type for k in (0, 1, 4, 5)} == {0: "ExtractionError", 1: "RuntimeError", 4: "ExtractionError", 5: "ExtractionError"}


def test_numbers_are_read_without_a_float_between():
    long = jsonschema.spark_type({"type": "integer"})
    assert lax(9007199254740993, long) == lax("9007199254740993", long) == 9007199254740993 and lax("5.0", long) == 5
    assert not any(conforms(x, long) for x in (float("inf"), float("nan"), 1.5, "1.5", "x", 1 << 63, [1])) and conforms(-(1 << 62), long)


def entries(spark):
    return spark.createDataFrame([("e1", "Seizure", ["fit"]), ("e2", "Ataxia", []), ("e3", "Fever", None)], "id string, name string, synonyms array<string>")


def test_each_question_is_put_once(spark):
    def answer(prompt: str) -> str:
        if prompt.startswith("Give other"):
            return json.dumps({x[2:]: ["fever"] for x in prompt.split("\n")[1:]})
        return json.dumps({"id": "e3", "confidence": 0.9, "rationale": "why"})

    meter = Meter(spark)
    values = spark.createDataFrame([("hot head",), ("high temperature",)], "value string").coalesce(1)
    step = ontology.OntologyMapping(entries(spark), HashEmbeddings(), meter.client(RuleClient(answer), "x"), use_rerank=True, augment_queries=True)
    both = cascade.CascadeNormalization.default({"q": "Q"}, ontology=step)
    got = both.normalize(values)
    assert {r.raw: r.canonical for r in got.collect()} == {"hot head": "Fever", "high temperature": "Fever"} and got.count() == 2
    assert [(r.stage, r.calls) for r in meter.table().collect()] == [("x", 3)]  # one for other wordings, one for each choice


def test_index_store_keeps_vectors_between_runs(spark, tmp_path):
    path, values = f"{tmp_path}/index", spark.createDataFrame([("fit",), ("fevr",)], "value string")
    mapped = lambda: {r.raw: r.ontology_id for r in ontology.OntologyMapping(entries(spark), HashEmbeddings(), index_path=path).normalize(values).collect()}
    assert mapped() == {"fit": "e1", "fevr": "e3"} and versions(spark, path) == [1]
    assert mapped() == {"fit": "e1", "fevr": "e3"} and versions(spark, path) == [1]
    more = entries(spark).union(spark.createDataFrame([("e4", "Rash", [])], "id string, name string, synonyms array<string>"))
    assert ontology.build_stored_index(more, HashEmbeddings(), path).count() == 5 and versions(spark, path) == [1, 2]


def test_calls_in_flight_keep_their_order():
    assert in_flight(lambda x: x * 2, list(range(50)), 8) == [2 * k for k in range(50)] == in_flight(lambda x: x * 2, list(range(50)), 1)


def test_budget_counts_all_stages_and_progress_is_told(spark):
    def answer(prompt: str) -> str:
        if prompt.startswith("Reply with a JSON Schema"):
            return json.dumps(LINE)
        if prompt.startswith("Extract"):
            return json.dumps({"line": body(prompt)})
        return "[]"

    told = []
    docs = documents.from_strings(spark, ["x"] * 8)
    flow = Pipeline.quick(RuleClient(answer), max_cost_usd=1e-12, pricing={"rules": (1.0, 1.0)}, progress=lambda *x: told.append(x))
    poor = flow.run(spark, docs)
    assert poor.stopped is not None and poor.records.count() == 0 and told == [("discovery", 1, 1)]
    flow.max_cost_usd, flow.batches = 100.0, 2
    rich = flow.run(spark, docs)
    assert rich.stopped is None and rich.records.count() == 8 and told[1:] == [("discovery", 1, 1), ("extraction", 1, 2), ("extraction", 2, 2), ("selection", 1, 1)]
    assert {r.stage: r.calls for r in rich.usage.collect()} == {"discovery": 1, "extraction": 8, "selection": 1}


def test_function_calls_carry_structured_replies(monkeypatch):
    call = {"tool_calls": [{"function": {"name": "reply", "arguments": '{"items": [{"a": 1}]}'}}]}
    assert _said(call, {"type": "array"}) == '[{"a": 1}]' and _said(call, {"type": "object"}) == '{"items": [{"a": 1}]}' and _said({"content": None}, None) == ""
    asked = []

    def post(self, path, message):
        asked.append(message)
        if "tools" not in message:
            raise ProviderError("not here", False)
        return {"choices": [{"message": call}], "usage": {}}

    monkeypatch.setattr(HttpClient, "_post", post)
    assert HttpClient("m").complete([], schema={"type": "array"}).content == '[{"a": 1}]' and len(asked) == 3


def test_local_embeddings_need_their_library():
    with pytest.raises(ProviderError, match="sentence-transformers"):
        LocalEmbeddings().embed(["x"])


def test_numbered_is_the_place_in_order(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS x").repartition(7)
    assert all(r.x == r.r for r in numbered(df, "x").collect())
    assert numbered(df.limit(0), "x").count() == 0


def test_token_chunks_against_a_walk_over_the_tokens(spark):
    import regex

    texts = ["", "  ", "one", " two  words. ", "a,b c" * 40, "é ü_1 – x\n\n" * 30, "w " * 100]
    got = {}
    for r in sorted(chunking.chunk_tokens(documents.from_strings(spark, texts), 10, 3).collect(), key=lambda r: (r.doc_ord, r.chunk_index)):
        got.setdefault(r.doc_ord, []).append((r.char_start, r.char_end, r.content))
    for k, t in enumerate(texts):
        at = [m.start() for m in regex.finditer(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\r\n\f]", t)][1:] + [len(t)]
        want, i = [], 0
        while True:
            a, b = (at[i - 1] if i else 0), at[min(i + 10, len(at)) - 1]
            want.append((a, b, t[a:b]))
            if i + 10 >= len(at):
                break
            i += 7
        assert got[k] == want


def test_arrays_are_mapped_alike_in_place_and_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(1, ["a", None, "z"]), (2, []), (3, None), (4, ["a", None, "z"])], "k int, f array<string>")
    m = spark.createDataFrame([("a", "A"), ("None", "nothing")], "raw string, canonical string")
    want = [(1, ["A", "nothing", "z"]), (2, []), (3, None), (4, ["A", "nothing", "z"])]
    assert sorted(map(tuple, mapping.apply_mapping(rows, m, "f").collect())) == want
    monkeypatch.setattr(mapping, "INLINE_ROWS", 1)
    assert sorted(map(tuple, mapping.apply_mapping(rows, m, "f").select("k", "f").collect())) == want


def test_auto_k_takes_the_room_of_pairs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (200, 256)) for c in (0, 3, 6)])
    assert clustering.auto_k(x) == 3
    labels = np.repeat([0, 1, 2], 200)
    d = np.sqrt(((x[:60, None] - x[None, :60]) ** 2).sum(-1))
    assert np.allclose(clustering.distances(x[:60]), d, atol=1e-5)
    assert clustering.silhouette_score(x, labels) > 0.9


def test_centres_are_drawn_from_all_points(spark):
    rows = [(f"p{k}", [float(k % 3) * 10 + (k % 7) * 0.01, 1.0]) for k in range(90)]
    points = spark.createDataFrame(rows, "id string, v array<double>").repartition(3)
    centres = clustering.draw_centres(points, 3)
    assert sorted(round(c[0] / 10) for c in centres) == [0, 1, 2] and centres == clustering.draw_centres(points.repartition(5), 3)
    assert len(clustering.draw_centres(points.where("id IN ('p0', 'p21')"), 2)) == 2


def test_changes_that_are_no_fields_are_left_out():
    assert jsonschema.apply_changes(LINE, {"add_fields": {"x": "string", "y": {"type": "string"}}})["properties"].keys() == {"line", "y"}


def test_files_are_numbered_by_path(spark, tmp_path):
    for k in (3, 1, 2):
        (tmp_path / f"f{k}.txt").write_text(f"text {k}")
    (tmp_path / "f0.txt").write_bytes(b"\xff\xfe\x00")
    rows = documents.load_glob(spark, f"{tmp_path}/*.txt").orderBy("doc_ord").collect()
    assert [(r.doc_id, r.content) for r in rows] == [(f"f{k}.txt", f"text {k}") for k in (1, 2, 3)]
    assert documents.load_samples(spark, "cases").count() == 10 and profile.head(documents.load_samples(spark), 2).count() == 2


def test_search_by_expressions_takes_larger_indexes_as_matrices(spark, monkeypatch):
    index = spark.createDataFrame([(f"e{k}", "n", 0, [1.0, float(k)]) for k in range(6)], "id string, name string, text_ord int, embedding array<double>")
    queries = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 1.0])], "value string, embedding array<double>")
    rows = lambda: sorted((r.value, r.id, round(r.score, 9), r.rank) for r in ontology.search(queries, index, 2).collect())
    want = rows()
    assert [r[1] for r in want] == ["e2", "e3", "e4", "e5"]
    monkeypatch.setattr(ontology, "LISTED", 3)
    assert rows() == want


def test_embeddings_are_metered(spark, monkeypatch):
    meter = Meter(spark)
    step = metered(ontology.OntologyMapping(entries(spark), HashEmbeddings()), meter, "normalization")
    step.normalize(spark.createDataFrame([("fit",)], "value string")).collect()
    (row,) = meter.table().collect()
    assert (row.stage, row.model, row.output_tokens) == ("normalization", "HashEmbeddings", 0) and row.calls >= 2 and row.input_tokens >= 5
    monkeypatch.setattr(HttpClient, "_post", lambda self, path, message: {"data": [{"index": k, "embedding": [1.0]} for k in range(len(message["input"]))], "usage": {"prompt_tokens": 7}})
    counted = Meter(spark)
    assert counted.embeddings(HttpClient("text-embedding-3-small"), "x").embed(["a", "b"]) == [[1.0], [1.0]]
    assert [(r.model, r.calls, r.input_tokens) for r in counted.table().collect()] == [("text-embedding-3-small", 1, 7)]
