"""Operators against brute force on small tables, and their queries against SQL on tables with nulls."""

from __future__ import annotations

import fnmatch
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fieldloom.llm import content_sort, digests, fair_mix, findings, language, line_windows, lsh_forest, packing, queries, secrets, shared, toxicity, trees, url_rules

R = random.Random(9)


def vocabulary(letters: str, n: int = 500) -> list[str]:
    return ["".join(R.choices(letters, k=R.randint(2, 9))) for _ in range(n)]


ENGLISH, GERMAN = vocabulary("etaoinshrdlu"), vocabulary("enisratdhulöäß")


def prose(words: list[str], n: int) -> list[str]:
    return R.choices(words, k=n)


def near_copy(words: list[str], changes: int) -> list[str]:
    out = list(words)
    for _ in range(changes):
        out[R.randrange(len(out))] = R.choice(ENGLISH)
    return out


@pytest.fixture(scope="module")
def corpus():
    texts = [prose(ENGLISH, R.randint(5, 300)) for _ in range(150)]
    for _ in range(120):
        base = texts[R.randrange(150)]
        texts.append(near_copy(base, R.randint(0, max(1, len(base) // 5))))
    texts += [texts[0]] * 5 + [near_copy(texts[1], 1) for _ in range(40)]
    order = R.sample(range(len(texts)), len(texts))
    return [(i, " ".join(texts[k])) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3)


def shingles(text: str) -> set[tuple[str, ...]]:
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def test_near_duplicates_recall_and_precision(docs, corpus):
    sets = {i: shingles(t) for i, t in corpus}
    jac = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sets, 2)}
    group = {r.doc_id: r.group_id for r in lsh_forest.near_duplicates(docs).collect()}
    want = [p for p, j in jac.items() if j >= 0.6]
    assert sum(group[a] == group[b] for a, b in want) >= 0.99 * len(want)
    close = [p for p, j in jac.items() if 0.52 <= j < 0.6]  # at the threshold itself an estimate is as often below as above
    assert not close or sum(group[a] == group[b] for a, b in close) >= 0.8 * len(close)
    part = {i: i for i in sets}  # what any links of at least 0.35 could connect
    for (a, b), j in jac.items():
        if j >= 0.35:
            old, new = max(part[a], part[b]), min(part[a], part[b])
            part = {k: new if v == old else v for k, v in part.items()}
    assert all(part[i] == part[g] for i, g in group.items())
    assert all(g == min(k for k, v in group.items() if v == g) for g in group.values())


def forest_lot(n_groups: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A lot of entries in order: groups of similar sketches, in few labels that share values."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (n_groups, lsh_forest.HASHES), dtype=np.uint16)
    sketch = base[np.repeat(np.arange(n_groups), size)].copy()
    noise = rng.random(sketch.shape) < 0.2
    sketch[noise] = rng.integers(0, 256, int(noise.sum()))
    label = rng.integers(0, 2, (n_groups, lsh_forest.DEPTH), dtype=np.uint16)[np.repeat(np.arange(n_groups), size)]
    key = np.concatenate([rng.integers(0, 2, (n_groups * size, 1), dtype=np.uint16), label, sketch], axis=1)
    key = key[np.lexsort(key.T[::-1])]
    return key, lsh_forest._sketch(key)


def components(n: int, links: list[tuple[int, int]]) -> set[tuple[int, ...]]:
    of = list(range(n))
    for u, v in links:
        old, new = of[v], of[u]
        of = [new if x == old else x for x in of]
    return {tuple(np.flatnonzero(np.array(of) == x)) for x in set(of)}


def candidates_brute(key: np.ndarray, crowd: int, near: int) -> set[tuple[int, int]]:
    """Pairs of one region of at most ``crowd`` entries of any depth, and neighbours in the order with the same first value."""
    rows, out = [tuple(r) for r in key.tolist()], set()
    for depth in range(2, key.shape[1] + 1):
        runs = {}
        for i, r in enumerate(rows):
            runs.setdefault(r[:depth], []).append(i)
        out |= {p for run in runs.values() if len(run) <= crowd for p in combinations(run, 2)}
        if depth == 2:
            out |= {p for run in runs.values() for p in combinations(run, 2) if p[1] - p[0] <= near}
    return out


def test_forest_candidates_against_brute_force(monkeypatch):
    monkeypatch.setattr(lsh_forest, "CROWD", 24)
    monkeypatch.setattr(lsh_forest, "NEIGHBOURS", 3)
    for seed in range(4):
        key, sketch = forest_lot(9, 30, seed)
        least = (0.5 * (1 - 1 / 256) + 1 / 256) * lsh_forest.HASHES
        want = [(i, j) for i, j in candidates_brute(key, 24, 3) if (sketch[i] == sketch[j]).sum() >= least]
        whole = components(len(key), lsh_forest.lot_links(key, sketch, 0.5))
        assert whole == components(len(key), want) and len(whole) < len(key) // 2
        for step in (40, 61):  # in lots that overlap by an edge
            links = []
            for a in range(0, len(key), step):
                lo, hi = max(0, a - 25), min(len(key), a + step)
                links += [(lo + i, lo + j) for i, j in lsh_forest.lot_links(key[lo:hi], sketch[lo:hi], 0.5, a > 0, hi < len(key))]
            assert components(len(key), links) == whole


def test_forest_parts_and_lots_give_the_same_groups(spark, monkeypatch):
    base, r = prose(ENGLISH, 60), random.Random(3)
    texts = [" ".join(near_copy(base, 2)) for _ in range(1200)] + [" ".join(prose(ENGLISH, 40)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(r.sample(texts, len(texts)))), "doc_id bigint, text string").repartition(3)
    want = sorted(lsh_forest.near_duplicates(docs).collect())
    monkeypatch.setattr(lsh_forest, "PART_ROWS", 5000)
    monkeypatch.setattr(lsh_forest, "HELD", 1500)
    assert sorted(lsh_forest.near_duplicates(docs).collect()) == want
    monkeypatch.setattr(lsh_forest, "PART_ROWS", 400)  # parts too short for an edge: fewer are taken
    assert sorted(lsh_forest.near_duplicates(docs).collect()) == want
    assert sum(not row.is_kept for row in want) >= 1190


def test_identifiers_that_repeat_join_the_groups_of_their_texts(spark):
    a, b, c = (" ".join(prose(ENGLISH, 40)) for _ in range(3))
    rows = [(5, a), (3, a), (5, b), (9, b), (7, c), (7, None), (8, None), (8, "")]
    got = {r.doc_id: (r.group_id, r.is_kept) for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {3: (3, True), 5: (3, False), 9: (3, False), 7: (7, True), 8: (8, True)}


def test_near_duplicates_need_integers(spark):
    with pytest.raises(TypeError, match="integers"):
        lsh_forest.near_duplicates(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_connected_components(spark):
    edges = [(a, a + 1) for a in range(50)] + [(100, k) for k in range(101, 180)] + [(7, 7), (None, 3)] + [(200, 201), (201, 200)]
    got = dict(shared.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 180)} | {200: 200, 201: 200}


def test_min_hashes_estimate_jaccard():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 1 << 63, 300, dtype=np.uint64)])
    x, y = ((lsh_forest.min_hashes(s) & 0xFF).astype(np.uint8) for s in (a, b))
    assert abs(lsh_forest.estimate(x, y) - 700 / 1300) < 0.15


def test_globs_against_fnmatch():
    globs = ["*", "", "a?c*", "*://*casino*/*", "*.jpg", "?", "*?*?*", "x" * 70 + "*y", "ä?ö*", "*ö"]
    texts = ["", "abc", "ac", "http://best-casino.com/a", "x.jpg", "ä", "äxö", "ääö?", "x" * 70 + "zzy", "x" * 69 + "y", "aöc", "日本"]
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    got = url_rules.GlobAutomaton(globs).match(np.frombuffer(b"".join(data), np.uint8), offs)
    assert got.tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]


@pytest.mark.parametrize("url, want", [
    ("HTTPS://A.Example.COM:443?utm_source=x&b=2#top", "https://a.example.com/?b=2"), ("http://h.example", "http://h.example/"), (" http://h.example/P?ref=1 ", "http://h.example/P"), (None, None),
])
def test_canonical_urls(spark, url, want):
    assert url_rules.filter_urls(spark.createDataFrame([(1, url)], "page_id bigint, url string")).first().canonical_url == want


def test_exact_against_dictionary(docs, corpus):
    first = {}
    for i, t in sorted(corpus):
        first.setdefault(" ".join(t.split()), i)
    got = {r.doc_id: (r.kept_id, r.is_kept) for r in content_sort.exact_duplicates(docs).collect()}
    assert got == {i: (first[" ".join(t.split())], first[" ".join(t.split())] == i) for i, t in corpus}


def lines_brute(rows: list[tuple[int, str]]) -> dict[int, tuple[str, int]]:
    seen, first, later = set(), {}, {}
    for i, t in sorted(rows):
        lines = [x.rstrip(" \t\r\f") for x in t.split("\n")]
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(w):
                (later if w in seen else first).setdefault(i, []).append((p, w))
                seen.add(w)
    many = {w for ws in later.values() for _, w in ws}
    out = {}
    for i, t in rows:
        gone = {p + k for p, _ in later.get(i, []) for k in range(3)} - {p + k for p, w in first.get(i, []) if w in many for k in range(3)}
        kept = [x for p, x in enumerate(t.split("\n")) if p not in gone]
        out[i] = ("\n".join(kept), len(gone))
    return out


def test_lines_against_brute_force(spark):
    r = random.Random(2)
    pool = ["", "a", "b", "c ", "d\t", "long line of text", "ü"]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(0, 9)))) for i in range(200)]
    got = {x.doc_id: (x.clean_text, x.removed_lines) for x in line_windows.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == lines_brute(rows)


def test_language_held_out(spark):
    make = lambda k: (k, " ".join(prose((ENGLISH, GERMAN)[k % 2], 120)), ("en", "de")[k % 2])
    schema = "doc_id bigint, text string, lang string"
    made = language.train_dictionaries(spark.createDataFrame([make(k) for k in range(60)], schema))
    test = [make(k) for k in range(100, 200)]
    got = {r.doc_id: r.language for r in language.identify(spark.createDataFrame(test, schema), made).collect()}
    assert sum(got[i] == lang for i, _, lang in test) >= 95
    assert all(got[i] in (lang, "und") for i, _, lang in test)


def test_language_query_against_brute_force(spark, tmp_path):
    """The whole query: the sample, dictionaries, whole texts in blocks, the margin."""
    r = random.Random(31)
    rows = []
    for k in range(160):
        words = prose((ENGLISH, GERMAN)[k % 2], r.choice((3, 20, 120, 900)))
        rows.append((k if k % 37 else None, "A-1 " + " ".join(words).title() if k % 23 else r.choice((None, "", "!?")), ("en", "de", None)[k % 2 if k % 11 else 2]))
    rows += [(4, "x" * 60, "en"), (5, "word " * 20_000, "de")]
    pq.write_table(pa.table({c: pa.array([x[i] for x in rows], k) for i, (c, k) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())))}), tmp_path / "documents.parquet")
    got = sorted((repr(x.doc_id), x.language, round(x.margin, 9)) for x in queries.op5_language_id(spark, str(tmp_path)).collect())

    flat = lambda t: re.sub(r"[\x00-@\[-`{-\x7f]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t)).encode()
    hashed = {x.id: x.h for x in spark.range(200).selectExpr("id", "xxhash64(id, 'language') AS h").collect()}
    pool: dict[str, dict[int, str]] = {}
    for i, t, lang in rows:
        if None not in (i, t, lang) and 41 <= len(t) <= 16_384:
            pool.setdefault(lang, {})[i] = min(t, pool.get(lang, {}).get(i, t))
    made = {lang: b"".join(flat(ts[i]) + b" " for i in sorted(ts, key=lambda i: (hashed[i], i))[: language.SAMPLE_DOCS]) for lang, ts in pool.items()}
    assert language.train_dictionaries(spark.read.parquet(str(tmp_path / "documents.parquet"))) == made
    coders = language.Compressors(made)
    want = []
    for i, t, _ in rows:
        b, size = flat(t or ""), {}
        for name, c in zip(coders.names, coders.each):
            size[name] = sum(len(c.compress(b[a : a + 2048])) for a in range(0, len(b), 2048))
        best, other = sorted(size.items(), key=lambda x: (x[1], x[0]))
        by = other[1] / best[1] - 1 if b else 0.0
        want.append((repr(i), best[0] if by >= language.MARGIN else "und", round(by, 9)))
    assert got == sorted(want)


def test_language_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="3 values"):
        language.train_dictionaries(spark.createDataFrame([(k, "word " * 20, f"l{k}") for k in range(3)], "doc_id bigint, text string, lang string"))


def test_language_margins():
    assert language.decide(["a", "b"], [100, 100]) == ("und", 0.0)
    assert language.decide(["a", "b"], [1000, 1001], margin=0.005)[0] == "und"
    assert language.decide(["a", "b"], [120, 100]) == ("b", pytest.approx(0.2))


def test_packing_is_near_the_lower_bound():
    r = np.random.default_rng(8)
    sizes = r.integers(1, 1500, 800)
    plan = packing.evolve(sizes, 2048, 1, [])[0]
    fill = np.bincount(plan, weights=sizes)
    assert fill.max() <= 2048 and len(plan) == 800
    assert len(fill) <= 1.03 * -(-sizes.sum() // 2048)


def document_sizes(n: int, capacity: int, seed: int) -> np.ndarray:
    """Rests of documents with a long tail, as the query has them."""
    r = np.random.default_rng(seed)
    tokens = np.minimum(r.lognormal(5.3, 1, n), 30_000).astype(np.int64) + 1
    return np.sort(tokens - (tokens - 1) // capacity * capacity)


def test_generations_run_and_improve_where_best_fit_reaches_the_least_bins(monkeypatch):
    sizes = next(s for s in (document_sizes(3000, 2048, k) for k in range(20)) if -(-s.sum() // 2048) * 2048 - s.sum() > 400)  # room to gather
    made, cross = [], packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: made.append(cross(*a)) or made[-1])
    first = packing.evolve(sizes, 2048, 1, [], 0)[0]
    assert not made and packing.fitness(sizes, first, 2048)[0] == packing.ideal(sizes, 2048)[0]
    best = packing.evolve(sizes, 2048, 1, [])[0]
    assert len(made) == packing.GENERATIONS
    assert packing.ideal(sizes, 2048) <= packing.fitness(sizes, best, 2048) < packing.fitness(sizes, first, 2048)
    again = packing.evolve(sizes, 2048, 2, [best, packing.evolve(sizes, 2048, 7, [])[0]])[0]
    assert packing.fitness(sizes, again, 2048) <= packing.fitness(sizes, best, 2048)


def least_bins(sizes: tuple[int, ...], capacity: int) -> int:
    """By trying all assignments, larger items first."""
    best = len(sizes)

    def put(k: int, fill: list[int]) -> None:
        nonlocal best
        if len(fill) >= best:
            return
        if k == len(sizes):
            best = len(fill)
            return
        for b in range(len(fill)):
            if fill[b] + sizes[k] <= capacity and fill[b] not in fill[:b]:
                fill[b] += sizes[k]
                put(k + 1, fill)
                fill[b] -= sizes[k]
        put(k + 1, [*fill, sizes[k]])

    put(0, [])
    return best


def test_small_sets_are_packed_as_well_as_by_brute_force():
    r = random.Random(4)
    for seed in range(25):
        sizes = np.sort(np.array([r.randint(15, 70) for _ in range(11)]))
        best = packing.evolve(sizes, 100, seed, [])[0]
        assert packing.fitness(sizes, best, 100)[0] == least_bins(tuple(sorted(sizes.tolist(), reverse=True)), 100)


def test_packing_query_packs_every_token_once(spark, tmp_path):
    r = random.Random(6)
    rows = [(k if k % 29 else None, "x" * r.choice((0, 7, 900, 5000, 8192, 40_000))) for k in range(300)] + [(7, "repeated")] * 4 + [(8, None)]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}), tmp_path / "documents.parquet")
    got, fill = {}, {}
    for x in queries.op6_best_fit_packing(spark, str(tmp_path)).collect():
        got.setdefault((x.doc_id, x.piece), []).append(x.tokens)
        fill[x.bin] = fill.get(x.bin, 0) + x.tokens
    want = {}
    for i, t in rows:
        n = -(-len(t or "") // 4)
        for piece in range(max(1, -(-n // 2048))):
            want.setdefault((i, piece), []).append(min(2048, n - piece * 2048))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    rests = np.array([v for vs in want.values() for v in vs if v < 2048])
    full = sum(v == 2048 for vs in want.values() for v in vs)
    large = int((rests > 1024).sum())  # no two of these fit in a bin
    assert max(fill.values()) <= 2048 and len(fill) - full <= max(large, packing.ideal(rests, 2048)[0]) + 1


def test_rows_of_one_key_are_spread_over_blocks(spark, monkeypatch):
    rows = [(None, "x" * 40)] * 900 + [(k, "y" * 400) for k in range(100)]
    monkeypatch.setattr(packing, "BLOCK", 50)
    made = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), block=50).collect()
    assert len(made) == 1000 and sum(r.tokens for r in made) == 900 * 10 + 100 * 100
    blocks = {}
    for r in made:
        blocks[r.bin.split("-")[1]] = blocks.get(r.bin.split("-")[1], 0) + 1
    assert max(blocks.values()) <= 150


def test_crossover_keeps_every_document_within_capacity():
    r = np.random.default_rng(6)
    sizes = r.integers(0, 900, 300)
    start = []
    for k in range(2):
        a = np.zeros(300, dtype=np.int64)
        packing.best_fit(sizes, r.permutation(300), 1000, a, np.zeros(0, np.int64))
        start.append(packing._compact(a))
    for _ in range(50):
        child = packing.crossover(*start, sizes, 1000, r)
        assert len(child) == 300 and np.bincount(child, weights=sizes).max() <= 1000
        start = [start[1], child]


def test_crossover_evolution_improves():
    r = np.random.default_rng(5)
    sizes = r.integers(300, 900, 400)
    a = np.zeros(400, dtype=np.int64)
    packing.best_fit(sizes, r.permutation(400), 1000, a, np.zeros(0, np.int64))
    first = packing._compact(a)
    best = packing.evolve(sizes, 1000, 2, [first], 40)[0]
    assert packing.fitness(sizes, best, 1000) <= packing.fitness(sizes, first, 1000)


def test_toxicity_held_out():
    r = random.Random(1)
    def make(k: int) -> tuple[str, bool]:
        bad = k % 3 == 0
        words = prose(ENGLISH, r.randint(30, 200))
        if bad:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "moron", "scum you", "worthless"]))
        return " ".join(words), bad
    train, test = [make(k) for k in range(300)], [make(k) for k in range(300, 500)]
    model = toxicity.train([t for t, _ in train], np.array([b for _, b in train]))
    p = np.concatenate([model.probability(d, o) for _, _, d, o in toxicity.slices(pa.array([t for t, _ in test]))])
    y = np.array([b for _, b in test])
    assert ((p >= toxicity.REJECT) & y).sum() >= 0.95 * y.sum()
    assert ((p >= toxicity.REJECT) & ~y).sum() <= 0.02 * (~y).sum()


def features_brute(text: str, lexicon: toxicity.Lexicon) -> list[float]:
    """One text, word by word."""
    b = text.encode()
    if not b:
        return [0.0] * len(toxicity.FEATURES)
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", b)]
    fold = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), b[i:j]) for i, j in spans]
    h = lambda w: int(toxicity.span_hash(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    odds = dict(zip(lexicon.words.tolist(), lexicon.odds.tolist()))
    tables = [set(t.tolist()) for t in lexicon.beginnings]
    found = [h(w) in odds for w in fold]
    early = [any(len(w) > k and h(w[:k]) in t for k, t in zip(toxicity.PREFIXES, tables)) for w in fold]
    you = [w.decode(errors="replace") in toxicity.SECOND for w in fold]
    n, size = len(fold), len(b)
    per, marked = max(n, 1), [f or e for f, e in zip(found, early)]
    near = sum(m and any(you[max(0, k - 8) : k + 9]) for k, m in enumerate(marked))
    sign = lambda c: c > 32 and not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128)
    letter = lambda c: 65 <= c < 91 or 97 <= c < 123 or c >= 128
    return [
        sum(found) / per, sum(early) / per, sum(odds[h(w)] for w, f in zip(fold, found) if f) / per,
        len({k // 64 for k, m in enumerate(marked) if m}) / max(1, -(-n // 64)), near / per, sum(you) / per,
        sum(65 <= c < 91 for c in b) / size, sum(j - i > 2 and re.fullmatch(rb"[A-Z]+", b[i:j]) is not None for i, j in spans) / per,
        b.count(b"!") / size, b.count(b"?") / size, sum(map(sign, b)) / size, sum(48 <= c < 58 for c in b) / size,
        sum(letter(b[k - 1]) and (sign(b[k]) or 48 <= b[k] < 58) and letter(b[k + 1]) for k in range(1, size - 1)) / size,
        sum(b[k] == b[k - 1] == b[k - 2] for k in range(2, size)) / size, np.log1p(n),
    ]


def test_toxicity_query_against_brute_force(spark, tmp_path):
    """Scores of the whole query: features word by word, trees branch by branch, calibration by interpolation."""
    r = random.Random(15)
    rows = []
    for k in range(260):
        words = prose(ENGLISH, r.choice((2, 40, 300)))
        if k % 3 == 0:
            words[r.randrange(len(words))] += r.choice((" you MORON!!!", " idiot, du", " w0rthless scum you", " y-o-u loser"))
        rows.append((k if k % 50 else None, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (3, "repeated id")]
    labels = [(k, int(k % 3 == 0)) for k in range(1, 200)] + [(None, 1), (5, None)]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in labels], pa.int64()), "toxic": pa.array([y for _, y in labels], pa.int32())}), tmp_path / "labels.parquet")
    got = queries.op8_toxicity(spark, str(tmp_path)).collect()
    read = lambda name: spark.read.parquet(str(tmp_path / f"{name}.parquet"))
    model = toxicity.train_from(read("documents"), read("labels"))
    (_, _, data, offs), = toxicity.slices(pa.array([t or "" for _, t in rows]))
    assert np.allclose(toxicity.features(data, offs, model.lexicon), [features_brute(t or "", model.lexicon) for _, t in rows], atol=1e-12)
    want = []
    for i, t in rows:
        x, margin = features_brute(t or "", model.lexicon), model.model.base
        for tree in model.model.trees:
            node = 0
            for _ in range(tree.depth):
                node = 2 * node + (2 if x[tree.feature[node]] > tree.edge[node] else 1)
            margin += tree.value[node - (2**tree.depth - 1)]
        p = float(np.interp(margin, model.model.x_cal, model.model.y_cal)) if t else 0.0
        want.append((repr(i), round(p, 6), p >= toxicity.REJECT))
    assert sorted((repr(x.doc_id), round(x.probability, 6), x.toxic) for x in got) == sorted(want)
    assert 60 < sum(w[2] for w in want) < 110


def test_lexicon_of_frequent_hashes_is_that_of_all():
    r = random.Random(16)
    texts = [" ".join(prose(ENGLISH[:80], 30) + (["vile", "vileness"] if k % 4 == 0 else [])) for k in range(80)]
    y = np.array([k % 4 == 0 for k in range(80)])
    column, use = pa.array(texts, pa.large_string()), np.array([r.random() < 0.7 for _ in texts])
    some, every = (toxicity.fit_lexicon(toxicity._hash_sets(column, y, n), y, use) for n in (3, 0))
    assert some.words.tolist() == every.words.tolist() and some.odds.tolist() == every.odds.tolist()
    assert [b.tolist() for b in some.beginnings] == [b.tolist() for b in every.beginnings] and len(some.words) > len(toxicity.SEEDS)


def test_isotonic_is_monotone_and_calibrated():
    r = np.random.default_rng(2)
    s = np.round(r.normal(size=500), 1)
    y = (r.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float)
    xs, ys = trees.isotonic(s, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()
    assert abs(np.interp(s, xs, ys).mean() - y.mean()) < 1e-9


def test_mix_follows_weights(spark):
    rows = [(i, "x" * 400, "ab"[i % 2]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = fair_mix.plan_mix(docs, weights={"a": 3.0, "b": 1.0}, budget_tokens=100_000).groupBy("source").sum("tokens").collect()
    share = {s: n / 100_000 for s, n in got}
    assert abs(share["a"] - 0.75) < 0.01 and abs(share["b"] - 0.25) < 0.01
    only = fair_mix.plan_mix(docs, weights={"b": 2.0}).select("source").distinct().collect()
    assert [r.source for r in only] == ["b"]


def test_entropies_against_counting():
    r = random.Random(4)
    texts = ["".join(r.choices("abcdeföx ", k=n)) for n in (0, 5, digests.WINDOW - 1, 200, 90)] + ["aaaa" * 40]
    (_, _, data, offs), = toxicity.slices(pa.array(texts))
    level, whole = digests.entropies(data, offs)
    for t, a, b in zip(texts, offs[:-1], offs[1:]):
        for k in range(a, b):
            if k + digests.WINDOW > b:
                assert not whole[k]
                continue
            _, c = np.unique(data[k : k + digests.WINDOW], return_counts=True)
            share = c / digests.WINDOW
            want = -(share * np.log2(share)).sum() / np.log2(digests.WINDOW) * (digests.LEVELS - 1)
            assert whole[k] and abs(level[k] - want) <= 0.51


def test_features_against_brute_force():
    r = random.Random(14)
    texts = ["".join(r.choices("etaoin shrdlu", k=n)) for n in (20, 40, 64, 300, 1000)]
    (_, _, data, offs), = toxicity.slices(pa.array(texts))
    level, whole = digests.entropies(data, offs)
    rank = digests.ranks(np.bincount(level[whole], minlength=digests.LEVELS))
    got_hash, got_row = digests.feature_hashes(data, offs, rank)
    for row, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
        n = b - a - digests.WINDOW + 1
        own = [int(rank[level[a + k]]) for k in range(max(n, 0))]
        points = [0] * max(n, 0)
        for k in range(n - digests.FRAME + 1):
            points[min(range(k, k + digests.FRAME), key=lambda j: (own[j], j))] += 1
        chosen = [k for k in range(max(n, 0)) if points[k] >= digests.POINTS] if n >= digests.FRAME else ([min(range(n), key=lambda j: (own[j], j))] if n > 0 else [])
        want = [digests.span_hash(data, np.array([a + k]), np.array([a + k + digests.WINDOW]))[0] for k in chosen if own[k] < 1023]
        assert got_hash[got_row == row].tolist() == want


def test_digests_find_copied_passages(spark):
    items = [(k, " ".join(prose(ENGLISH, 50))) for k in range(12)]
    rows = [(k, " ".join(prose(ENGLISH, 90)) + (" " + items[k][1] + " " if k < 12 else " ") + " ".join(prose(ENGLISH, 90))) for k in range(60)]
    docs, ref = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    rank = digests.ranks(digests.level_counts(docs))
    found = digests.match(digests.fingerprint(docs, rank), digests.fingerprint(ref, rank, id_col="item_id").withColumnRenamed("doc_id", "item_id"))
    assert {r.doc_id: r.nearest for r in found.collect()} == {k: k if k < 12 else None for k in range(60)}


def test_digests_in_several_passes_match_the_same(spark, monkeypatch):
    rows = [(k, " ".join(prose(ENGLISH, 80))) for k in range(30)] + [(k + 30, " ".join(prose(ENGLISH, 4))) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = digests.fingerprint(docs, digests.ranks(digests.level_counts(docs))).cache()
    ref = made.withColumnRenamed("doc_id", "item_id")
    one = sorted((r.doc_id, r.nearest, r.overlap) for r in digests.match(made, ref).where("overlap IS NOT NULL").collect())
    monkeypatch.setattr(digests, "REFERENCE_BYTES", 2000)
    assert sorted((r.doc_id, r.nearest, r.overlap) for r in digests.match(made, ref).where("overlap IS NOT NULL").collect()) == one
    assert digests.match(made, ref).count() == 33


def test_secrets_held_out():
    scan = secrets.train(findings.labelled(4000))
    test = findings.labelled(800, seed=77)
    data, lows, highs, a, b, y = secrets._encode(test)
    hit = scan.score(data, lows, highs, a, b) >= scan.threshold
    assert hit[y == 1].mean() >= 0.97
    assert hit[y == 0].mean() <= 0.12


def secrets_brute(text: str, scan: secrets.Scanner) -> list[tuple[int, int, str, float]]:
    """Candidates from every place, each piece convolved position by position, findings within findings compared pair by pair."""
    b, spans = text.encode(), set()
    spans |= {m.span() for m in re.finditer(rb"[A-Za-z0-9+/_.=~:@%-]{12,}", b)}
    word = rb"(?:password|passwd|passphrase|secret|secret_key|token|api_?key|private_key|access_key|credentials?|authorization|bearer|basic)"
    at = reach = 0
    while m := re.compile(rb"[:=]>?[ \t]*|(?i:" + word + rb")[\"']?[ \t]+").search(b, at):
        k = m.end()
        for shape in (rb'"([^"\n]+)"', rb"'([^'\n]+)'", rb"[\"']?([^\s:=\"'][^\s\"']*)"):
            if v := re.compile(shape).match(b, k):
                lo, hi = v.span(1)
                if lo < reach and hi - lo > secrets.NESTED:
                    hi = lo + secrets.NESTED
                    while b[hi] & 0xC0 == 0x80:
                        hi -= 1
                reach = max(reach, hi)
                spans.add((lo, hi))
                at = k + (b[k : k + 1] in (b'"', b"'") and shape[0] in b"\"'[" and v.start(1) > k)
                break
        else:
            at = m.start() + 1
            continue
        at = max(at, m.end())
    net, hits = scan.net, []
    for lo, hi in sorted(spans):
        best = -np.inf
        for p in range(lo, max(lo + 1, hi), secrets.PIECE):
            codes = []
            for q in range(p - secrets.BEFORE, p + secrets.PIECE + secrets.AFTER):
                codes.append(int(secrets._CLASS[b[q]]) + secrets.CLASSES * (lo <= q < hi) if 0 <= q < len(b) else 2 * secrets.CLASSES)
            conv = [np.maximum(net.bias + sum(net.table[w][codes[k + w]] for w in range(secrets.WIDTH)), 0) for k in range(len(codes) - secrets.WIDTH + 1)]
            best = max(best, float(np.concatenate([np.max(conv, axis=0), np.mean(conv, axis=0)]) @ net.dense + net.dense_bias))
        if best >= scan.threshold:
            hits.append((lo, hi, best))
    inner = [x for x in hits if not any(y[:2] != x[:2] and x[0] <= y[0] and y[1] <= x[1] for y in hits)]
    return [(len(b[:lo].decode()), len(b[lo:hi].decode()), b[lo:hi].decode(), round(float(np.interp(s, scan.x_cal, scan.y_cal)), 5)) for lo, hi, s in inner]


def test_secret_query_against_brute_force(spark, tmp_path, monkeypatch):
    scan = secrets.train(findings.labelled(3000))
    monkeypatch.setattr(secrets, "default_scanner", lambda: scan)
    texts = [t for t, *_ in findings.labelled(160, seed=101)]
    texts = ["\n".join(texts[k : k + 4]) for k in range(0, 160, 4)] + [None, "", "ä = ü", 'k: "ö" ' * 3, "x=" * 200 + "y", "token='" + "pä$" * 30 + "'"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    got = sorted((r.doc_id, r.start, r.length, r.finding, round(r.probability, 5)) for r in queries.op1_secret_scan(spark, str(tmp_path)).collect())
    assert got == sorted((i, *f) for i, t in enumerate(texts) if t for f in secrets_brute(t, scan)) and len(got) > 60


def test_threshold_keeps_recall():
    score, y = np.arange(100.0), np.repeat([0.0, 1.0], 50)
    assert 49 < secrets.choose_threshold(score, y, 1.0) < 50
    assert secrets.choose_threshold(score, np.zeros(100), 0.9) == 0.0


def test_long_runs_are_scored_whole(spark):
    scan = secrets.train(findings.labelled(4000))
    secret = "api_key = \"" + "".join(random.Random(5).choices("ABCdef0123456789xyzQRS", k=40)) + "\""
    text = "word " * 200_000 + secret + " word" * 1000
    rows = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), scan).collect()
    assert [text[r.start : r.start + r.length] for r in rows] == [r.finding for r in rows] and any(r.start >= 1_000_000 for r in rows)


def test_queries_against_sql_on_tables_with_nulls(spark, tmp_path):
    r = random.Random(12)
    texts = [" ".join(prose(ENGLISH, r.randint(1, 60))) for _ in range(60)]
    pool = [None, "", "  ", "\n\n\n", *texts, *[" " + t.replace(" ", "  ") for t in texts[:9]], "\n".join(texts[:7]), "\n".join(texts[2:9]), "ä\n" * 9]
    docs = [(None if k % 41 == 0 else k, r.choice(pool), None, None if k % 13 == 0 else f"s{k % 5}", None) for k in range(300)]
    urls = [None, "", "http://a.example/x.jpg", "HTTP://Poker.site.com", "ftp://a/b", "http://a.example/?utm_x=1&ref=2#f", "http://m.ththth.example.net/casino/1/", "javascript:alert(1)", "http://ä.example/ß?session_id=1"]
    pages = [(None if k % 17 == 0 else k % 40, r.choice(urls), None) for k in range(120)]
    names = {"documents": (docs, ["doc_id", "text", "lang", "source", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]), "pages": (pages, ["page_id", "url", "html"], [pa.int64(), pa.string(), pa.string()])}
    con = duckdb.connect()
    for name, (rows, cols, kinds) in names.items():
        pq.write_table(pa.table({c: pa.array([x[i] for x in rows], kinds[i]) for i, c in enumerate(cols)}), tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}.parquet'")
    # Equal texts of rows with the same null identifier are told apart by nothing, so rows are compared as multisets.
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = con.execute(sql)
        cols = [d[0] for d in want.description]
        plain = lambda row: tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in row)
        assert sorted(got.columns) == sorted(cols), name
        assert sorted(map(plain, got.select(*cols).collect())) == sorted(map(plain, want.fetchall())), name
