import random

from cellweave.llm import linededup as L


def brute(rows):
    """Removes by comparing whole chunk texts in order of (id, line)."""
    seen, gone = {}, {}
    for i, text in sorted({(i, t) for i, t in rows if t is not None and i is not None}):
        for first, end, _, body in L.chunks(text):
            if body in seen:
                gone.setdefault(i, set()).update(range(first, end))
            else:
                seen[body] = i
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows if t is not None}


def corpus():
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(6))
    passage = [line() for _ in range(14)]
    rows = []
    for i in range(60):
        own = [line() for _ in range(rng.randint(0, 12))]
        if i % 3 == 0:
            at = rng.randint(0, len(own))
            own[at:at] = passage
        if i % 5 == 0:
            own += own[:6]
        rows.append((i, "\n".join(own)))
    return rows + [(70, None), (71, ""), (72, "\n\n\n"), (73, "\n\n\n"), (74, "x\ny\n" * 20_000), (5, rows[5][1])]


def test_boundaries_move_with_the_content():
    rng = random.Random(1)
    lines = [str(rng.random()) for _ in range(200)]
    a, b = L.chunk_ends(lines), L.chunk_ends(["new", "lines", "before"] + lines)
    same = {e + 3 for e in a} & set(b)
    assert len(same) >= len(a) - 2 and a[-1] == 200
    assert all(y - x >= L.LEAST for x, y in zip([0, *a[:-2]], a[:-1]))


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, source string, n_lines int")
    out = L.dedup_lines(df).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        assert r["text"] == want.get(r["doc_id"])
    assert sum(r["removed_lines"] for r in out) > 100
    assert {r["n_lines"] for r in out if r["doc_id"] in (70, 71)} == {0, 1}


def test_equal_hashes_with_different_bytes(spark, monkeypatch):
    """Chunks are told apart by bytes even if every hash is the same."""
    real = L.chunks

    def same_hash(text):
        return [(a, b, 7, body) for a, b, _, body in real(text)]

    rows = [(1, "a\nb"), (2, "c\nd"), (3, "a\nb"), (4, "c\nd"), (5, "e\nf")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(L, "chunks", same_hash)
    import pyspark.cloudpickle as cp

    cp.register_pickle_by_value(L)  # workers get the patched module
    try:
        got = {r["doc_id"]: r["text"] for r in L.dedup_lines(df).collect()}
    finally:
        cp.unregister_pickle_by_value(L)
    assert got == {1: "a\nb", 2: "c\nd", 3: "", 4: "", 5: "e\nf"}


def test_no_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a\nb\nc\nd\ne"), (3, "a\nb\nc\nd\ne"), (None, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in L.dedup_lines(df).collect() if r["doc_id"] is not None}
    assert out == {3: "a\nb\nc\nd\ne"}
    assert L.dedup_lines(df.limit(0)).count() == 0
