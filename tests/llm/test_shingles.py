import random

import numpy as np

import corpus_pipeline as P
from cellweave.llm import components as C
from cellweave.llm import shingles as S
from cellweave.llm import simhash


def slow_set(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_heads(rows):
    sets = {i: slow_set(t or "") for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in sets if find(i) == i}


def corpus():
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows = []
    for i in range(60):
        w = text(rng.randint(80, 300))
        rows.append((10 * i, " ".join(w)))
        for k in range(1, 5):  # from near to just under 0.8
            v = list(w)
            for at in rng.sample(range(len(v)), max(1, len(v) * k // 160)):
                v[at] = text(1)[0]
            rows.append((10 * i + k, " ".join(v)))
    rows += [(1000, None), (1001, ""), (1002, "two words"), (1003, "TWO words"), (1004, "two others")]
    return rows


def test_the_stage_keeps_one_of_each_component_at_similarity_eight_tenths(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in P.one_of_near_duplicates(spark, df, "").collect()]
    assert sorted(got) == sorted(slow_heads(rows))
    assert P.one_of_near_duplicates(spark, df.limit(0), "").count() == 0


def test_bucket_links_connect_like_all_pairs():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 62, 100, dtype=np.uint64))
    sets = []
    for k in range(150):
        s = base.copy()
        at = rng.choice(len(s), rng.integers(0, 20), replace=False)
        s[at] = rng.integers(0, 1 << 62, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    ids = np.arange(len(sets))
    links = S.bucket_links(ids, sets)
    alike = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    assert all(alike(sets[u], sets[v]) for u, v in links) and len(links) < 150
    pairs = [(i, j) for i in ids for j in ids[:i] if alike(sets[i], sets[j])]
    got, want = (C.forest(*map(np.array, zip(*e))) for e in (links, pairs))
    assert all((x == y).all() for x, y in zip(got, want))


def test_a_large_loose_group_is_linear(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    sets = []
    for k in range(1500):  # about 0.82 alike to one another, and a few that are nothing alike
        s = base.copy() if k % 100 else rng.integers(0, 1 << 62, 200, dtype=np.uint64)
        at = rng.choice(200, 10, replace=False)
        s[at] = rng.integers(0, 1 << 62, 10, dtype=np.uint64)
        sets.append(np.unique(s))
    compared, real = [], S._overlap
    monkeypatch.setattr(S, "_overlap", lambda one, words, starts, sizes: compared.append(len(sizes)) or real(one, words, starts, sizes))
    links = S.bucket_links(np.arange(len(sets)), sets)
    assert len(links) == 1484 and sum(compared) < 60 * len(sets)


def test_texts_that_share_a_passage_are_not_compared_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(2)
    new = lambda n: rng.integers(0, 1 << 62, n, dtype=np.uint64)
    passage, sets, pairs = new(60), [], set()
    for k in range(1500):  # the passage is from a fifth to six sevenths of the text
        sets.append(np.unique(np.concatenate((passage, new(int(rng.integers(10, 240)))))))
        if k % 50 == 0:
            pairs.add((len(sets) - 1, len(sets)))
            sets.append(np.unique(np.concatenate((sets[-1][3:], new(2)))))
    compared, real = [], S._overlap
    monkeypatch.setattr(S, "_overlap", lambda one, words, starts, sizes: compared.append(len(sizes)) or real(one, words, starts, sizes))
    links = S.bucket_links(np.arange(len(sets)), sets)
    assert {tuple(sorted(map(int, x))) for x in links} == pairs
    assert sum(compared) < 10 * len(sets)


def test_sets_of_any_loose_clusters_connect_like_all_pairs():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        pool = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
        sets = {}
        for _ in range(int(rng.integers(9, 60))):  # small sets from one pool, so that many pairs are near the bound
            base = pool[: rng.integers(1, 40)]
            s = np.unique(base[rng.random(len(base)) < rng.choice([0.8, 0.9, 1])])
            if len(s):
                sets.setdefault(s.tobytes(), s)
        sets = list(sets.values())
        links = S.bucket_links(np.arange(len(sets)), sets)
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        assert bool(links) == bool(pairs)
        if pairs:
            got, want = (C.forest(*map(np.array, zip(*e))) for e in (links, pairs))
            assert all((x == y).all() for x, y in zip(got, want))


def test_a_crowded_bucket_is_split_by_sizes_without_a_loss(spark, monkeypatch):
    sizes = np.arange(1, 3000)
    band = np.searchsorted(S.size_edges(), sizes, "right")
    assert all(band[b - 1] - band[a - 1] in (0, 1) for a in sizes.tolist() for b in {a, min(2999, 5 * a // 4)})
    monkeypatch.setattr(S, "CROWD", 1)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in P.one_of_near_duplicates(spark, df, "").collect()) == sorted(slow_heads(rows))


def test_fingerprints_of_the_sets_propose_pairs_by_multi_index_hashing(spark):
    rows = [(i, t) for i, t in corpus() if t and i % 10 < 2]
    rng = random.Random(3)
    for i, t in rows[::2]:  # one word more at the end
        rows.append((i + 5, f"{t} w{rng.randint(0, 10**6)}"))
    sets = {i: S.shingle_set(t) for i, t in rows}
    prints = {i: simhash.majority(s) for i, s in sets.items()}
    assert prints[0] == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in sets[0]) > len(sets[0]))
    alike = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    pairs = [(i, j) for i in sets for j in sets if i < j and (prints[i] ^ prints[j]).bit_count() <= S.RADIUS and alike(sets[i], sets[j])]
    assert len(pairs) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["key"]: r["component"] for r in S.similar_classes(df, orders=0).collect()}
    nodes, roots = C.forest(*map(np.array, zip(*pairs)))
    # without a common least element: these links, and no others but between members of a class of fingerprints
    assert {i: got[i] for i in nodes.tolist()} == dict(zip(nodes.tolist(), roots.tolist()))
    assert all(alike(sets[i], sets[c]) for i, c in got.items() if i // 10 == c // 10) and all(i // 10 == c // 10 for i, c in got.items())
