"""The corpus pipeline, stage by stage, against what its input was made of; and on awkward tables."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from fieldloom.llm import packing, shared

R = random.Random(21)
WORDS = ["".join(R.choices("etaoinshrdlu", k=R.randint(2, 9))) for _ in range(600)]
KINDS = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}


def prose(n: int) -> str:
    return " ".join(R.choices(WORDS, k=n))


def write(folder, docs, labels, extra=()):
    table = pa.table({c: pa.array([d.get(c) for d in docs], k) for c, k in KINDS.items()} | {c: pa.array(["x"] * len(docs)) for c in extra})
    pq.write_table(table, folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()), "toxic": pa.array([t for _, t in labels], pa.int32())}), folder / "labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    docs, labels, toxic, copies, near = [], [], set(), set(), set()
    for i in range(240):
        text = prose(R.randint(40, 300))
        if i % 6 == 0:
            text += " you worthless moron, you pathetic idiot, scum"
            toxic.add(i)
        if i < 180:
            labels.append((i, int(i in toxic)))
        docs.append({"doc_id": i, "text": text, "lang": "en", "source": f"s{i % 4}", "n_chars": len(text)})
    clean = [d for d in docs if d["doc_id"] not in toxic]
    for k in range(20):
        docs.append(clean[k] | {"doc_id": 1000 + k, "text": clean[k]["text"].replace(" ", "  ")})
        copies.add(1000 + k)
    for k in range(20, 40):
        words = clean[k]["text"].split()
        words[len(words) // 2] = "changed"
        docs.append(clean[k] | {"doc_id": 1000 + k, "text": " ".join(words)})
        near.add(1000 + k)
    return docs, labels, toxic, copies, near


def test_stages_do_what_they_say(spark, planted, tmp_path):
    docs, labels, toxic, copies, near = planted
    folder = write(tmp_path, docs, labels)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    columns, alive = table.columns, {d["doc_id"]: d for d in docs}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "source mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, folder).write.parquet(f"{folder}/{k}")
        table = spark.read.parquet(f"{folder}/{k}")
        if k == 4:
            break
        assert table.columns == columns
        rows = {r.doc_id: r.asDict() for r in table.collect()}
        assert all(alive[i] == row for i, row in rows.items()), name
        gone = set(alive) - set(rows)
        if k == 0:
            assert gone == toxic
        elif k == 1:
            assert gone == copies
        elif k == 2:
            assert gone == near
        else:
            tokens = lambda ds: sum(-(-len(d["text"]) // 4) for d in ds)
            assert 0.85 * tokens(alive.values()) <= tokens(rows.values()) <= 0.9 * tokens(alive.values())
            assert {d["source"] for d in rows.values()} == {"s0", "s1", "s2", "s3"}
        alive = rows
    out = table.collect()
    fill = {}
    for r in out:
        fill[r.bin] = fill.get(r.bin, 0) + r.tokens
    want = {i: -(-len(d["text"]) // 4) for i, d in alive.items()}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.tokens
    assert got == want and max(fill.values()) <= packing.CAPACITY
    assert len(fill) <= 1.1 * sum(want.values()) / packing.CAPACITY + 1


def test_run_equals_the_stages(spark, planted, tmp_path):
    docs, labels, *_ = planted
    folder = write(tmp_path, docs, labels)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, folder).write.parquet(f"{folder}/{k}")
        table = spark.read.parquet(f"{folder}/{k}")
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, table.collect()))


def test_run_leaves_nothing_but_its_result(spark, planted, tmp_path):
    docs, labels, *_ = planted
    kept = Path(shared.checkpoint_dir(spark).removeprefix("file:"))
    before = {p for p in kept.rglob("*") if p.is_dir()}
    out = corpus_pipeline.run(spark, write(tmp_path, docs, labels))
    new = {p for p in kept.rglob("*") if p.is_dir()} - before
    assert {p.name for p in new if p.name.startswith(("rdd-", "scratch-"))} == set()
    (folder,) = [p for p in new if p.name.startswith("pipeline-")]
    assert [p.name for p in folder.iterdir()] == ["4"] and out.count() > 0
    assert shared.checkpoint_dir(spark).removeprefix("file:") == str(kept)
    corpus_pipeline._forget(spark, str(folder))
    assert not folder.exists()




def test_awkward_tables(spark, tmp_path):
    docs = [{"doc_id": i, "text": t, "source": s} for i, t, s in [(1, "a b c d", None), (1, "a b c d", None), (None, None, None), (None, "x y", "s"), (2, None, "s"), (3, "", "s"), (4, prose(60_000), "s"), (5, "a b c d", "t")]]
    folder = write(tmp_path, docs, [(1, None), (None, 1)], extra=("group_id", "tokens", "finish", "bin", "__x", "kept_id", "__gone", "__taken", "__norm", "__hash", "__head", "rest", "id", "first"))
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = stage(spark, table, folder)
        assert now.columns == table.columns
        now.write.parquet(f"{folder}/{k}")
        table = spark.read.parquet(f"{folder}/{k}")
    assert corpus_pipeline.run(spark, folder).where("doc_id = 1").count() <= 1


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(tmp_path, [], [])).count() == 0
