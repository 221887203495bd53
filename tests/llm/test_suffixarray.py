import random
from collections import defaultdict

import numpy as np
import pytest

from cellweave.llm import suffixarray as A


def brute(rows):
    """Words of each document in a run of PASSAGE words that another document has."""
    runs = defaultdict(set)
    docs = [(i, t.lower().split()) for i, t in rows if t]
    for i, w in docs:
        for k in range(len(w) - A.PASSAGE + 1):
            runs[tuple(w[k : k + A.PASSAGE])].add(i)
    out = {}
    for i, w in docs:
        cover = set()
        for k in range(len(w) - A.PASSAGE + 1):
            if len(runs[tuple(w[k : k + A.PASSAGE])]) > 1:
                cover.update(range(k, k + A.PASSAGE))
        if cover:
            out[i] = out.get(i, set()) | cover
    return out


def corpus():
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    text = lambda n: [word() for _ in range(n)]
    p50, p49, p120, line = text(50), text(49), text(120), text(40)
    rows = []
    for i in range(90):
        w = text(rng.randint(20, 200))
        at = rng.randint(0, len(w))
        if i % 6 == 0:
            w[at:at] = p50
        elif i % 6 == 1:
            w[at:at] = p49
        elif i % 6 == 2:
            k = rng.randint(0, 60)
            w[at:at] = p120[k : k + 60]
        elif i % 6 == 3:
            w[at:at] = line
        elif i % 6 == 4 and i > 10:
            w = rows[i - 6][1].split()
            w[len(w) // 2] = word()
        rows.append((i, " ".join(w)))
    own = text(60)
    rows += [(200, " ".join(own + text(30) + own)), (201, None), (202, ""), (203, "one"), (204, " ".join(["x", "y"] * 3000)), (205, " ".join(["x", "y"] * 3000)), (200, rows[3][1]), (206, " ".join(p50).upper())]
    return rows


@pytest.mark.parametrize("frequent", [2_000, 3])
def test_spans_match_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(A, "FREQUENT", frequent)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, key int").repartition(3)
    got = defaultdict(set)
    for r in A.repeated_passages(df).collect():
        got[r["doc_id"]].update(range(r["first_word"], r["end_word"]))
        assert r["words"] >= A.PASSAGE and r["earliest_id"] <= r["doc_id"]
    want = brute(rows)
    assert set(got) == set(want)
    for i in want:
        assert got[i] == want[i], i


def test_every_passage_selects_a_position():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    at = A.minimisers(w)
    assert np.diff(at).max() <= A.WINDOW and len(at) < 5000 / 6
    inside = A.minimisers(np.concatenate((w[4000:4100], w[1000:1050], w[:90])))
    shared = set(at) & {x - 100 + 1000 for x in inside}
    assert any(1000 <= x < 1000 + A.WINDOW for x in shared)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert A.repeated_passages(df).count() == 0
    w = " ".join(f"n{i}" for i in range(70))
    two = spark.createDataFrame([(None, w), (5, w)], "doc_id long, text string")
    assert sorted(map(tuple, A.repeated_passages(two).collect()), key=str) == [(5, 0, 70, 70, 5), (None, 0, 70, 70, 5)]


def test_every_occurrence_within_a_document_has_its_span(spark):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    p60, p55 = text(60), text(55)
    many = [w for _ in range(40) for w in text(rng.randint(5, 60)) + p60]
    rows = [(1, " ".join(text(30) + p60 + text(9))), (2, " ".join(many)), (3, " ".join(text(12) + p55 + text(40)))]
    for i in range(4, 24):  # these share more with each other, on either side, than with the third
        rows += [(i, " ".join(text(25) + p55[: 50 + i % 6] + text(25))), (i + 100, " ".join(text(25) + p55[5 - i % 6 :] + text(25)))]
    got = defaultdict(set)
    for r in A.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r["doc_id"]].update(range(r["first_word"], r["end_word"]))
    want = brute(rows)
    assert len(want[2]) == 40 * 60
    assert dict(got) == want


def test_one_document_names_itself_for_a_passage_in_many(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = text(50)
    rows = [(i, " ".join(text(25) + passage + text(25))) for i in range(200)]
    got = A.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(200))
    assert {r["earliest_id"] for r in got} == {0}
