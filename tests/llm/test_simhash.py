import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cellweave.llm import components as C
from cellweave.llm import simhash as S


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def slow_roots(fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fs}


def test_fingerprint_matches_definition():
    for t in ("", " \n", "One", "one two three", "A b C d", "É É é ß X y z", "a\xa0b c　d e\x1cf g", "w " * 70_000, "the same the same the same the Same the SAME"):
        assert S.fingerprint(t) == slow_fingerprint(t), t


@pytest.mark.parametrize("plan", [S.SMALL_PLAN, S.LARGE_PLAN])
def test_links_connect_like_all_pairs(spark, plan):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {0, 1, (1 << 64) - 1}
    for b in base:
        for _ in range(rng.integers(0, 12)):
            flip = rng.choice(64, rng.integers(0, 8), replace=False)
            fps.add(int(b) ^ sum(1 << int(k) for k in flip))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {f: f for f in fps}
    pairs = S.links(df, len(fps), plan=plan).toPandas().to_numpy().view(np.uint64).reshape(-1, 2)
    nodes, roots = C.forest(pairs[:, 0], pairs[:, 1])
    got.update({int(a): int(b) for a, b in zip(nodes, roots)})
    assert got == slow_roots(fps)


def test_crowded_bucket_connects_like_all_pairs():
    rng = np.random.default_rng(2)
    for spread in (2, 5, 9):
        centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
        fps = {int(c) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, spread), replace=False)) for c in centre for _ in range(150)}
        a = np.array(sorted(fps), np.uint64)
        u, v = S.crowded_links(a, 4)
        assert (np.bitwise_count(u ^ v) <= 4).all()
        nodes, roots = C.forest(u, v)
        want = slow_roots(fps)
        got = {f: f for f in fps} | {int(x): int(y) for x, y in zip(nodes, roots)}
        assert got == want
        bucket = np.zeros(len(a), np.uint64)
        for crowd in (10, 10_000):
            n2, r2 = S.bucket_links(bucket, a, np.ones(len(a), bool), 4, crowd)
            assert {f: f for f in fps} | {int(x): int(y) for x, y in zip(n2, r2)} == want


def test_components_of_paths_stars_and_cliques(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(a, b) for a in range(200, 212) for b in range(200, a)] + [(300, 300), (-5, 400), (400, -5)]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(8, 60)} | {i: 200 for i in range(200, 212)} | {-5: -5, 400: -5}
    assert got == want
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_table(spark):
    rng = np.random.default_rng(0)
    words = ["w%d" % i for i in range(400)]
    texts = [" ".join(rng.choice(words, 90)) for _ in range(25)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 10 + 5, t, "s", "x"))
        if i % 3 == 0:
            rows += [(i * 10 + k, t, "s", "x") for k in (1, 7)]
        if i % 4 == 0:
            w = t.split()
            w[40] = "changed"
            rows.append((i * 10 + 2, " ".join(w), "s", "x"))
    rows += [(900, None, "s", "x"), (901, "", None, "x"), (902, " \n", "s", "x"), (None, texts[0], "s", "x"), (None, "alone here", "s", "x"), (903, "two words", "s", "x"), (903, "two words", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string")
    got = S.near_duplicate_classes(df).collect()
    assert len(got) == len(rows)
    fps = {slow_fingerprint(t or "") for _, t, _, _ in rows}
    root = slow_roots(fps)
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            r = root[slow_fingerprint(t or "")]
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, least.get(root[slow_fingerprint(t or "")])) for i, t, _, _ in rows), key=str)
    assert sorted(((r["doc_id"], r["component"] if r["component"] < S.NO_ID else None) for r in got), key=str) == want
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([*set(least.values()), None], key=str)
    assert S.near_duplicate_classes(df.limit(0)).count() == 0 and S.one_of_each(df.limit(0)).count() == 0
