import re

import pyarrow.parquet as pq

from strata.llm.near_dedup import ROWS, bands_for, components, near_dedup, sign
from strata.llm.registry import QUERIES

DIR = "/root/testdata/sf0.01"


def brute(rows, n=3, num=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    ids, up = sorted(sets), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for p, i in enumerate(ids):
        for j in ids[:p]:
            a, b = sets[i], sets[j]
            if a and min(len(a), len(b)) * 100 >= num * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= num * (len(a) + len(b) - both):
                    x, y = sorted((root(i), root(j)))
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_equals_brute_force(spark):
    want = brute([(r["doc_id"], r["text"]) for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_near_dedup"](spark, DIR).collect()}
    assert got == want


def test_chain_is_one_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long")
    assert {r.node: r.comp for r in components(e).collect()} == {**{i: 0 for i in range(1, 41)}, 91: 90}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A b"), (6, "a b c"), (6, "a b c"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component_id", "2 as digest")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs, 3, 85).collect())
    assert got == [(0, 1, 4, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True)]
    assert near_dedup(docs.limit(0)).count() == 0


def test_bands_suit_the_similarity(spark):
    assert all((1 - s**ROWS) ** bands_for(s) <= 1e-6 < (1 - s**ROWS) ** (bands_for(s) - 1) for s in (0.5, 0.8, 0.85, 0.95)) and bands_for(1.0) == 1
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert (bands_for(0.85), len(sign(docs, 5, bands_for(0.8)).first().bands)) == (44, 76)


def varied(seed, base, edits):
    import random

    rng, w = random.Random(seed), list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def test_near_copies_under_the_threshold_are_settled_without_all_pairs(spark, monkeypatch):
    from strata.llm import near_dedup as m

    base = [f"w{i}" for i in range(200)]
    # Two hundred variants of one text, mostly unlinked to it, with near copies of some of them.
    rows = [(i + 1, varied(i, base, 6)) for i in range(200)]
    rows += [(1000 + i, varied(1000 + i, rows[i][1].split(), 1)) for i in range(0, 200, 10)] + [(5000, " ".join(base))]
    rows += [(6000, "word " * 30_000), (6001, "word " * 30_000 + "end"), (7, "a text of its own beside variant seven"), (None, rows[3][1])]
    seen, beside = [], m._beside
    monkeypatch.setattr(m, "_beside", lambda *a: seen.append(beside(*a)) or seen[-1])
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    want = brute([(k, t) for k, (_, t) in enumerate(rows)])
    group, low = [want[k][1] for k in range(len(rows))], {}
    for k, (i, _) in enumerate(rows):
        low[group[k]] = min(low.get(group[k], 10**9), 10**9 if i is None else i)
    assert got == sorted((-1 if i is None else i, want[k][0], low[group[k]]) for k, (i, _) in enumerate(rows))
    assert len(set(group)) > 100 and seen[0].count() < 221 * 220 // 2 // 3


def test_long_texts_and_long_words(spark):
    rows = [(1, "x" * 1_000_000), (2, "x" * 1_000_000), (3, "A b " * 100_000), (4, "a B " * 100_000 + "c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (3, 4)}
