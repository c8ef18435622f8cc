"""Cases that operators once cut short."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa

from fieldloom.llm import digests, findings, line_windows, secrets, url_rules
from fieldloom.llm.textbytes import slices

R = random.Random(21)
WORDS = ["".join(R.choices("etaoinshrdlu", k=R.randint(2, 9))) for _ in range(500)]


def prose(n: int) -> str:
    return " ".join(R.choices(WORDS, k=n))


def chains(texts: list[str]) -> list[bytes]:
    (_, _, data, offs), = slices(pa.array(texts), 1 << 24)
    level, whole = digests.entropies(data, offs)
    h, row = digests.feature_hashes(data, offs, digests.ranks(np.bincount(level[whole], minlength=digests.LEVELS)))
    return [digests.chain(h[row == k])[1] for k in range(len(texts))]


def test_digests_find_passages_wherever_they_lie_in_long_texts():
    passages = [prose(n) for n in (60, 300, 1500)]
    around = [(prose(n), prose(2500 - n)) for n in range(0, 1500, 75)]
    made = chains([*passages, *(" ".join((a, p, b)) for p in passages for a, b in around), *(" ".join((a, b)) for a, b in around)])
    docs = made[3:63]
    for k, p in enumerate(made[:3]):
        assert all(digests.compare(d, p) >= digests.MATCH for d in docs[20 * k : 20 * k + 20])
        assert not any(digests.compare(d, p) >= digests.MATCH for d in made[63:])


def test_digests_are_compared_in_tiles(monkeypatch):
    made = chains([prose(n) for n in (30, 700, 60, 1500)])
    ref = chains([prose(40), prose(900), prose(20)]) + [made[2]]
    want = digests.scores(made, ref)
    assert want[2, 3] == 1.0 and (np.delete(want[:, 3], 2) < digests.MATCH).all()
    monkeypatch.setattr(digests, "TILE", (3, 5))
    assert np.allclose(digests.scores(made, ref), want)


def test_short_passages_are_found(spark):
    items = [(k, prose(17)) for k in range(40)]  # about 110 characters
    rows = [(k, " ".join((prose(120), items[k][1], prose(120)))) for k in range(40)] + [(k, prose(250)) for k in range(40, 120)]
    docs, ref = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    rank = digests.ranks(digests.level_counts(docs))
    found = digests.match(digests.fingerprint(docs, rank), digests.fingerprint(ref, rank, id_col="item_id").withColumnRenamed("doc_id", "item_id")).collect()
    assert sum(r.doc_id in (r.matches or []) for r in found) >= 37
    assert not any(set(r.matches or []) - {r.doc_id} for r in found)


def test_digests_name_every_passage_of_a_document(spark, monkeypatch):
    items = [(k, prose(40)) for k in range(12)]
    items += [(20, items[3][1]), (3, items[3][1])]  # equal passages, and a repeated row
    rows = [(k, " ".join((prose(150), items[k][1], prose(150), items[k + 1][1], prose(30)))) for k in range(6)] + [(6, prose(200)), (7, items[9][1]), (8, "short"), (9, None)]
    docs, ref = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    rank = digests.ranks(digests.level_counts(docs))
    made, known = digests.fingerprint(docs, rank).cache(), digests.fingerprint(ref, rank, id_col="item_id").withColumnRenamed("doc_id", "item_id").cache()
    want = {k: [k, k + 1] + [20] * (3 in (k, k + 1)) for k in range(6)} | {6: [], 7: [9], 8: None, 9: None}
    for held in (digests.REFERENCE_BYTES, 1000):
        monkeypatch.setattr(digests, "REFERENCE_BYTES", held)
        found = digests.match(made, known).collect()
        assert {r.doc_id: r.matches for r in found} == want
        assert {r.doc_id: r.nearest for r in found} == {k: m[0] if m else None for k, m in want.items()}


def test_secret_values_are_candidates_whatever_their_length_and_characters():
    cases = {
        'password = "S3cret!x"': "S3cret!x", "passwd=hunter": "hunter", '{"db_password": "a&b!c$d#e"}': "a&b!c$d#e", "secret 'correct horse battery'": "correct horse battery",
        "Authorization: Bearer abcdefGHIJ": "abcdefGHIJ", "token sunshine": "sunshine", "ghp_" + "Abcdef" * 6: "ghp_" + "Abcdef" * 6, "x=1&token=pä$s": "pä$s",
    }
    for text, want in cases.items():
        data, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        starts, ends, _ = secrets.candidates(data, offs)
        assert want in {data[a:b].tobytes().decode() for a, b in zip(starts, ends)}, text


def test_secret_recall_counts_what_candidates_miss():
    texts = findings.labelled(1200, seed=78)
    data, lows, highs, a, b, y = secrets._encode(texts)
    score = secrets.score_held(secrets.train(findings.labelled(600)), data, lows, highs, a, b)
    assert np.isfinite(score[y == 1]).mean() >= 0.995
    assert secrets.choose_threshold(np.array([3.0, 2.0, -np.inf]), np.array([1.0, 1.0, 1.0]), 0.6) == 2.0


def test_chains_of_assignments_take_linear_room():
    text = b"a=b:" * 20_000
    starts, ends, _ = secrets.candidates(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert ends.max() == len(text) and (ends - starts).sum() <= 300 * len(text)


def test_all_bytes_of_values_within_values_are_candidates():
    text = b"u=x=" + b"la," * 300 + b"y=" + b"lo," * 300 + b" end"
    starts, ends, _ = secrets.candidates(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    y, whole = text.index(b"y=") + 2, text.index(b" end")
    assert {(2, whole), (4, 4 + secrets.NESTED), (4, y), (y, y + secrets.NESTED), (y, whole)} <= set(zip(starts.tolist(), ends.tolist()))


def test_secrets_within_values_are_found_whole(spark):
    scan, r = secrets.train(findings.labelled(4000)), random.Random(5)
    token, other = "".join(r.choices(findings._B62, k=600)), "".join(r.choices(findings._B62, k=100))
    cases = [
        ("see url=https://h.example/cb?token=", token, " end"), ('{"config": "mode=fast&api_key=', token, '"}'), ("u=token=", f"{other}={token}", " end"),
        ("u=token=", "pä$" * 300, " end"), ("u=token=", other + "$la" * 200 + "$" + other, " end"), ("a=b:" * 3000 + "token=", token, " end"),
    ]
    docs = spark.createDataFrame([(k, "".join(c)) for k, c in enumerate(cases)], "doc_id bigint, text string")
    found = secrets.scan_secrets(docs, scan).collect()
    for k, (before, secret, behind) in enumerate(cases):
        mine = [x for x in found if x.doc_id == k]
        text, seen = before + secret + behind, set()
        for x in mine:
            assert x.finding == text[x.start : x.start + x.length]
            seen |= set(range(x.start, x.start + x.length))
        assert seen >= set(range(len(before), len(before + secret))), k
        assert sum(x.length for x in mine) <= 4 * len(text)


def test_many_url_rules_in_small_lots(spark, monkeypatch):
    rules = [f"*/{k}/*" for k in range(0, 3000, 7)] + ["@*keep*"]
    rows = [(k, f"http://h.example/{k}/{'keep' * (k % 5 == 0)}") for k in range(200)] + [(200, ""), (201, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    want = sorted(map(tuple, url_rules.filter_urls(pages, rules).collect()))
    assert [r[0] for r in want if r[3]] == [k for k in range(0, 200, 7) if k % 5]
    monkeypatch.setattr(url_rules, "STATES", 1 << 14)
    assert sorted(map(tuple, url_rules.filter_urls(pages, rules).collect())) == want


def test_long_copies_lose_their_lines_in_linear_time(spark):
    text = "\n".join(f"line {k}" for k in range(100_000))
    rows = [(1, text), (2, "own\n" + text + "\nend"), (3, text + "\nmore"), (3, "a\nb")]
    began = time.monotonic()
    got = {(r.doc_id, r.removed_lines): r.clean_text for r in line_windows.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, 0): text, (2, 100_000): "own\nend", (3, 100_000): "more", (3, 2): ""}
    assert time.monotonic() - began < 60
