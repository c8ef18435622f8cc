"""Chunks, text functions, quotes, replies and costs on literal rows."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.errors import BudgetExceededError, DiscoveryError, ExtractionError, ProviderError, SchemaError
from fieldloom.functions import batches, jsonschema, plain, text
from fieldloom.operators import chunking, extraction, provenance, records, usage
from fieldloom.providers import CannedClient, HashEmbeddings, HttpClient, RuleClient, complete_rows, embed_column, embed_distinct, resolve_provider
from fieldloom.schemas import DOCUMENTS
from fieldloom.sources.documents import from_strings

SPANS = "array<struct<quote:string,document_id:string,start:int,end:int,confidence:string>>"
SCHEMA = jsonschema.object_of("title", title="string", rating="integer", pros=dict(items=dict(type="string"), type="array"))


def one(spark, column, *values, kinds="string"):
    names = [f"c{i}" for i in range(len(values))]
    kinds = kinds.split(";") * len(values)
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return df.select(column(*map(F.col, names)).alias("x")).first().x


def spans_of(spark, body, size, overlap):
    docs = from_strings(spark, [body], "x").withColumn("doc_id", F.lit("x"))
    rows = chunking.chunk_fixed(docs, size, overlap).orderBy("chunk_index").collect()
    assert chunking.FixedSizeChunking(size, overlap).estimate_chunks(docs) == len(rows)
    assert all(r.char_start is None or body[r.char_start : r.char_end] == r.content for r in rows)
    return [(r.chunk_id, r.char_start, r.char_end) for r in rows]


def test_fixed_chunks(spark):
    assert spans_of(spark, "a" * 25, 10, 3) == [("x__chunk_0", 0, 10), ("x__chunk_1", 7, 17), ("x__chunk_2", 14, 24), ("x__chunk_3", 21, 25)]
    assert [s[1:] for s in spans_of(spark, "a" * 17, 10, 3)] == [(0, 10), (7, 17), (14, 17)]
    assert spans_of(spark, "a" * 10, 10, 3) == [("x", None, None)]
    assert [s[1:] for s in spans_of(spark, "abcd😀fghijkl", 5, 1)] == [(0, 5), (4, 9), (8, 12)]
    assert spans_of(spark, "", 10, 3) == [("x", None, None)]
    assert len(spans_of(spark, "abc", 1, 5)) == 3


def test_chunk_sizes_in_effect():
    assert [chunking.effective_chunk_size(*x) for x in ((-1, False), (-1, True), (50, True), (0, False))] == [4000, 0, 50, 0]


def test_estimates(spark):
    df = spark.createDataFrame([(n,) for n in (0, 4000, 4001, 7700)], "n int").select(chunking.estimate_chunks(F.repeat(F.lit("a"), F.col("n"))).alias("k"))
    assert [r.k for r in df.collect()] == [1, 1, 2, 3]


PARA = "First one here. Second, longer one! Third?\n\nA new paragraph begins; it has parts, too. " * 6


@pytest.mark.parametrize("made", [chunking.TokenChunking(20, 5), chunking.SentenceChunking(12, 4), chunking.RecursiveChunking(8), chunking.RecursiveChunking(5)])
def test_other_chunks_cover_the_text(spark, made):
    docs = from_strings(spark, [PARA, "", "short"])
    rows = made.chunk(docs).collect()
    for o, body in enumerate((PARA, "", "short")):
        own = sorted((r.char_start, r.char_end, r.content) for r in rows if r.doc_ord == o)
        assert own[0][0] == 0 and own[-1][1] == len(body)
        assert all(body[a:b] == c for a, b, c in own)
        assert all(y[0] <= x[1] for x, y in zip(own, own[1:]))
    assert made.estimate_chunks(docs) == len(rows)


def test_recursive_chunks_keep_the_budget():
    spans = chunking.split_recursively(PARA + "x" * 100, 8)
    assert all(-(-(b - a) // 4) <= 8 for a, b in spans) and "".join((PARA + "x" * 100)[a:b] for a, b in spans) == PARA + "x" * 100


def test_semantic_chunks(spark):
    docs = from_strings(spark, ["aaa bbb. aaa bbb. zzz qqq.", ""])
    rows = chunking.SemanticChunking(embed_column(HashEmbeddings()), 0.5).chunk(docs).orderBy("doc_ord", "chunk_index").collect()
    assert [r.content for r in rows] == ["aaa bbb. aaa bbb. ", "zzz qqq.", ""]


def test_text_functions(spark):
    assert one(spark, text.strip_fences, "```json\n{}\n```") == "{}"
    assert one(spark, text.strip_fences, "say\n```\nx") == "say\n```\nx" == plain.strip_fences("say\n```\nx")
    assert one(spark, text.sanitize, "a\x00b \n c") == "a b c"
    assert one(spark, text.sanitize, "a" * 201) == "a" * 200 + "..."
    assert one(spark, text.sanitize, " x  y ") == "x y"
    assert one(spark, lambda c: text.truncate(c, 3, "…"), "abcd") == "abc…"
    assert one(spark, text.tokens, "abcde") == 2 and one(spark, text.tokens, None) == 0
    assert one(spark, text.document_label, "", "") == "unknown" and one(spark, text.document_label, None, "d") == "d"
    assert one(spark, text.folded, "ﬁn\n\tX") == "fin x"
    df = spark.createDataFrame([(k,) for k in range(5)], "a int").select(text.attempt_confidence(F.col("a")).alias("c"))
    assert [r.c for r in df.collect()] == [1.0, 0.7, 0.4, 0.1, 0.1]


def test_spans(spark):
    body = "It said: hello  there, twice."
    quotes = [(q, body) for q in ("hello  there", "hello there", "HELLO THERE!", "nowhere", " ", None, '"said"', "...")]
    got = provenance.locate(spark.createDataFrame(quotes, "quote string, content string")).collect()
    found = {r.quote: (r.start, r.end, r.confidence) for r in got}
    assert found["hello  there"] == (9, 21, "exact")
    assert found["hello there"] == found["HELLO THERE!"] == (9, 21, "fuzzy")
    assert found["nowhere"] == (None, None, "unresolved")
    assert found[" "] == found[None] == found["..."] == (None, None, "inferred")
    assert found['"said"'] == (3, 7, "exact")


def test_loose_offsets_are_those_of_the_text_itself():
    body = "İstanbul  ﬁne"
    a, b = provenance.find_loosely("fine", body)
    assert body[a:b] == "ﬁne"


def test_quotes_across_documents(spark):
    docs = from_strings(spark, ["nothing", "a hello b", "hello"])
    got = provenance.locate_across(spark.createDataFrame([("hello.",), ("no such",)], "quote string"), docs).orderBy("quote").collect()
    assert [(r.doc_id, r.start, r.end) for r in got] == [("doc_1", 2, 7), (None, None, None)]


def test_quotes_in_several_passes(spark, monkeypatch):
    docs = from_strings(spark, ["öne two three", "two three four", None, "four"])
    quotes = spark.createDataFrame([(q,) for q in ("two", "two three", "three four", "four", "ne", "", None, "zz")], "quote string")
    monkeypatch.setattr(provenance, "QUOTE_CHARS", 8)
    got = {r.quote: (r.doc_id, r.start, r.end) for r in provenance.locate_across(quotes, docs).collect()}
    none = (None, None, None)
    assert got == {"two": ("doc_0", 4, 7), "two three": ("doc_0", 4, 13), "three four": ("doc_1", 4, 14), "four": ("doc_1", 10, 14), "ne": ("doc_0", 1, 3), "": none, None: none, "zz": none}


def test_span_union(spark):
    a, b = [("q", "d", 0, 1, "exact")] * 2, [("q", "d", 0, 1, "exact"), ("r", "d", 2, 3, "fuzzy"), ("r", "d", 2, 3, "fuzzy")]
    df = spark.createDataFrame([(a, b), (None, b), (a, None)], f"a {SPANS}, b {SPANS}").select(provenance.merge_spans(F.col("a"), F.col("b")).alias("m"))
    assert [len(r.m) for r in df.collect()] == [3, 3, 2]
    maps = spark.createDataFrame([({"x": a}, {"x": b, "y": b})], f"a map<string,{SPANS}>, b map<string,{SPANS}>").select(provenance.merge_field_spans(F.col("a"), F.col("b")).alias("m"))
    assert {k: len(v) for k, v in maps.first().m.items()} == {"x": 3, "y": 3}


@pytest.mark.parametrize("reply, want", [('{"a": 1}', ['{"a":1}']), ('```\n[{"a": 1}, {"b": 2}]\n```', ['{"a":1}', '{"b":2}']), ("[1, 2]", None), ("oops", None), ("", None), ("[]", [])])
def test_parse_replies(spark, reply, want):
    got = one(spark, records.parse_objects, reply)
    assert (got if got is None else [json.loads(x) for x in got]) == (want if want is None else [json.loads(x) for x in want])


def test_nulls_by_type(spark):
    kind = "a array<string>, o map<string,string>, s string, n struct<x:array<int>,y:int>, l array<struct<z:array<int>>>"
    df = spark.createDataFrame([(None, None, None, (None, None), [(None,)])], kind)
    r = records.coerce_nulls(df, df.columns).first()
    assert (r.a, r.o, r.s, r.n.x, r.n.y, r.l[0].z) == ([], {}, None, [], None, [])


def test_record_dedup(spark):
    rows = [(1, "a", {"x": "1", "y": "2"}), (0, "a", {"y": "2", "x": "1"}), (2, "b", None), (3, "b", None)]
    got = records.dedup_records(spark.createDataFrame(rows, "ord int, t string, m map<string,string>"), ["t", "m"]).collect()
    assert sorted(r.ord for r in got) == [0, 2]


def test_usage_and_budget(spark):
    calls = spark.createDataFrame([(k, "s", "m", 1, 1, 0.0, 0.4) for k in range(3)], "call_ord int, stage string, model string, input_tokens int, output_tokens int, latency_ms double, cost_usd double")
    assert usage.within_budget(calls, 1.0).count() == 3 and usage.within_budget(calls, 0.39).count() == 1
    with pytest.raises(BudgetExceededError) as e:
        usage.check_budget(calls, 1.0)
    assert round(e.value.spent, 6) == 1.2 and e.value.limit == 1.0
    assert usage.check_budget(calls, None) == pytest.approx(1.2)
    assert usage.check_budget(calls.limit(0), 0.0) == 0.0
    priced = usage.with_cost(calls.withColumn("model", F.lit("gpt-4o")), {"gpt-4o": (1e6, 2e6)}).first()
    assert priced.cost_usd == 3.0 and usage.with_cost(calls).first().cost_usd == 0.0
    assert usage.is_priced("gpt-4o") and not usage.is_priced("m") and usage.is_priced("m", {"m": (1, 1)})
    assert {(r.stage, r.calls) for r in usage.usage_report(calls).collect()} == {("s", 3), (None, 3)}


def test_cost_estimate(spark):
    r = usage.estimate_pipeline_cost(from_strings(spark, ["a" * 4000])).first()
    assert (r.discovery_usd, r.extraction_usd, r.normalization_usd, r.total_usd) == (0.0009, 0.0003, 0.001, 0.0022)
    assert usage.estimate_pipeline_cost(spark.createDataFrame([], DOCUMENTS)).first().total_usd == 0.0


def test_json_schema_types():
    ref = lambda n: {"$ref": f"#/$defs/{n}"}
    union = {"anyOf": [dict(type=t) for t in ("null", "integer")]}
    deep = jsonschema.object_of(a=ref("A"), e={"enum": ["x"]}, u=union, t={"type": ["null", "boolean"]}, l="array", o="object", w="date", x=ref("No"))
    deep["$defs"] = {"A": jsonschema.object_of(again=ref("A"), n="number")}
    assert jsonschema.to_struct(deep).simpleString() == "struct<a:struct<again:map<string,string>,n:double>,e:string,u:bigint,t:boolean,l:array<string>,o:map<string,string>,w:string,x:map<string,string>>"
    assert jsonschema.leaf_fields(deep) == 9
    with pytest.raises(SchemaError):
        jsonschema.to_struct({"type": "object"})
    assert jsonschema.string_fields(deep) == ["e", "l", "w"]


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.from_regex(r"[a-z]{1,8}", fullmatch=True), st.sampled_from(["string", "integer", "number", "boolean"]), min_size=1, max_size=8))
def test_schema_round_trip(fields):
    schema = jsonschema.object_of(**fields)
    back = jsonschema.from_struct(jsonschema.to_struct(schema))
    assert back["properties"] == schema["properties"]


def test_schema_edits():
    of = jsonschema.object_of
    s = of("b", "a", a="string", b=dict(title="B", type="string"))
    changes = dict(add_fields=of(c="integer", a="number")["properties"], remove_fields=["a", "zz"], modify_fields=of(b="integer")["properties"])
    assert jsonschema.apply_changes(s, changes) == of("b", b=dict(title="B", type="integer"), c="integer")
    assert jsonschema.apply_changes(s, {"remove_fields": ["a", "b"]}) == s
    assert set(jsonschema.apply_changes(s, {"remove_fields": ["a"], "add_fields": {"d": {}}}, True)["properties"]) == {"a", "b", "d"}
    wrapped = jsonschema.with_sources(s)
    assert jsonschema.with_sources(wrapped) == wrapped and set(wrapped["properties"]["a"]["properties"]) == {"value", "source_quotes"}
    assert jsonschema.without_sources({"a": {"value": 1, "source_quotes": ["x", ""]}, "b": 2}) == ({"a": 1, "b": 2}, {"a": ["x"]})
    assert jsonschema.diff({"properties": {"a": 1, "b": 1}}, {"properties": {"b": 2, "c": 1}}) == {"added": ["c"], "removed": ["a"], "changed": ["b"]}
    assert jsonschema.parse_schema('```\n{"schema": {"properties": {"a": {}}}}\n```') == {"type": "object", "properties": {"a": {}}}
    for bad in ("no", "[]", "{}"):
        with pytest.raises(DiscoveryError):
            jsonschema.parse_schema(bad)


def extract(spark, replies, texts=("a text",), **options):
    client = replies if callable(getattr(replies, "complete", None)) else CannedClient(replies, by_order=True)
    return extraction.LLMDirectExtraction(client, **options).extract(from_strings(spark, list(texts)), SCHEMA)


def test_extraction_retries_then_succeeds(spark):
    r = extract(spark, ["not json", '{"rating": 1}', '{"title": "t", "rating": "5", "pros": null}']).first()
    assert (r.record.title, r.record.rating, r.record.pros, r.error) == ("t", 5, [], None)
    assert r.provenance.confidence == pytest.approx(0.4) and r.input_tokens == 300 and r.output_tokens == 150


def test_extraction_failures(spark):
    r = extract(spark, ["no"], max_retries=1).first()
    assert r.record is None and r.error.type == "ExtractionError" and r.input_tokens == 200
    assert extract(spark, ["no"], on_error="skip").count() == 0
    with pytest.raises(Exception, match="extraction failed"):
        extract(spark, ["no"], on_error="raise").collect()
    with pytest.raises(ExtractionError):
        extract(spark, ["no"], on_error="what")


class Broken:
    def complete(self, messages, *, schema=None, temperature=0.0):
        raise ProviderError("down", True)


def test_provider_failures_are_rows(spark):
    r = extract(spark, Broken()).first()
    assert r.error.type == "ProviderError" and r.error.message == "down"
    got = complete_rows(spark.createDataFrame([(1, "p")], "k int, prompt string"), Broken(), ["k"]).first()
    assert (got.k, got.reply, got.error) == (1, None, "down")


def test_multi_records_and_sources(spark):
    many = '[{"title": "x"}, {"title": "y"}, {"title": "x"}]'
    assert sorted(r.record.title for r in extract(spark, [many], multi_record=True).collect()) == ["x", "y"]
    assert extract(spark, [many], multi_record=True, deduplicate=False).count() == 3
    assert extract(spark, ['[{"title": "x"}, {"rating": 2}]'], multi_record=True).first().error is not None
    sourced = lambda v, *q: dict(value=v, source_quotes=q)
    wrapped = json.dumps(dict(title=sourced("t", "b  text", "", "zzz"), rating=sourced(None)))
    r = extract(spark, [wrapped], ["the b text"], provenance=True).first()
    assert [(s.start, s.end, s.confidence) for s in r.provenance.field_spans["title"]] == [(4, 10, "fuzzy"), (None, None, "unresolved")]


def test_spans_are_document_offsets(spark):
    body = "x" * 30 + "needle" + "y" * 30
    client = RuleClient(lambda p: json.dumps({"title": {"value": "t", "source_quotes": ["needle"] if "needle" in p.split("---")[1] else []}}))
    rows = extraction.LLMDirectExtraction(client, chunk_size=40, overlap=10, provenance=True).extract(from_strings(spark, [body]), SCHEMA).collect()
    found = {(s.start, s.end) for r in rows for s in r.provenance.field_spans["title"]}
    assert found == {(30, 36)}


def test_http_client_retries(monkeypatch):
    import io
    import urllib.error

    seen, waits = [], []

    class Answer(io.BytesIO):
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

    def fake(request, timeout):
        seen.append(json.loads(request.data))
        if len(seen) == 1:
            raise urllib.error.HTTPError(request.full_url, 429, "slow", {}, io.BytesIO(b"rate limit"))
        if len(seen) == 2:
            raise urllib.error.HTTPError(request.full_url, 400, "bad", {}, io.BytesIO(b"no schema"))
        return Answer(json.dumps({"choices": [{"message": {"content": "{}"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}).encode())

    monkeypatch.setattr("urllib.request.urlopen", fake)
    r = HttpClient("openai/m", sleep=waits.append).complete([{"role": "user", "content": "x"}], schema={"type": "object"})
    assert (r.content, r.input_tokens, r.output_tokens) == ("{}", 3, 2) and waits == [1.0]
    assert [s.get("response_format", {}).get("type") for s in seen] == ["json_schema", "json_schema", "json_object"]
    assert resolve_provider("ollama/x")[0:2] == ("x", "http://localhost:11434/v1") and resolve_provider("a/b", "u")[0:2] == ("a/b", "u")


def test_distinct_texts_are_embedded_once(spark):
    rows = embed_distinct(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "text string"), HashEmbeddings(8)).collect()
    assert sorted(r.text for r in rows) == ["a", "b"] and all(len(r.embedding) == 8 for r in rows)


def test_evidence_of_many_equal_records_is_merged_in_linear_time(spark):
    span = F.struct(F.lit("q").alias("quote"), (F.col("ord") % 4000).cast("string").alias("document_id"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("exact").alias("confidence"))
    twice = F.when(F.col("ord") == 0, F.array(span, span)).otherwise(F.array(span))
    df = spark.range(8000).select(F.col("id").alias("ord"), F.lit("same").alias("t"), F.create_map(F.lit("x"), twice).alias("spans"))
    out = records.dedup_records(df, ["t"], "ord", "spans")
    assert "array_contains" not in out._jdf.queryExecution().toString()
    (row,) = out.collect()
    assert row.ord == 0 and [int(s.document_id) for s in row.spans["x"]] == [0, *range(4000)]


def test_documents_become_objects_piece_by_piece():
    batch = pa.RecordBatch.from_pydict({"content": ["a" * n for n in (10, batches.PIECE_BYTES * 2, 10, 10)] + [None], "n": range(5)})
    made = list(batches.pieces(batch, "content"))
    assert [x for b in made for x in b.column("n").to_pylist()] == [0, 1, 2, 3, 4] and len(made) > 1
    assert not list(batches.pieces(batch.slice(0, 0), "content"))


def test_loose_search_traces_only_found_places(monkeypatch):
    body = "Ⅷ  ﬁne\t" + "x y " * 50
    folded, places = provenance.fold_with_places(body)
    assert folded == provenance.fold(body) and len(places) == len(folded)
    traced = []
    real = provenance.fold_with_places
    monkeypatch.setattr(provenance, "fold_with_places", lambda b, most=None: traced.append(most) or real(b, most))
    assert provenance.find_loosely("fine  x", body) == (3, 8) and provenance.find_loosely("absent", body) is None
    assert traced == [len("viii fine x")]


def test_long_texts_are_composed_and_trimmed_without_batches_or_patterns(spark):
    assert "ArrowEvalPython" not in spark.range(1).select(text.folded(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().toString()
    assert one(spark, text.folded, "ﬁ   É") == "fi é"
    blanks = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    assert set(text.BLANKS) == set(blanks) and one(spark, text.strip_blank, f"{blanks}a {blanks}b{blanks}") == f"a {blanks}b"
    assert "regexp_replace" not in spark.range(1).select(text.strip_fences(F.col("id").cast("string")))._jdf.queryExecution().toString()
