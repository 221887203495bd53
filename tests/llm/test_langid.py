from collections import Counter

import numpy as np

from cellweave.llm import langid as L

EN = "the quick brown fox jumps over the lazy dog and the cat that was with them"
DE = "der schnelle braune fuchs springt über den faulen hund und die katze mit ihnen"


def brute_grams(text):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    out = Counter()
    for w in words:
        for n in (1, 2, 3):
            p = w if n == 1 else f" {w} "
            out.update(p[i : i + n] for i in range(len(p) - n + 1) if n < 3 or p[i + 1] != " ")
    return out


def as_text(code):
    code = int(code)
    n = code >> 48
    return "".join(chr(code >> s & 0xFFFF) if code >> s & 0xFFFF else " " for s in (32, 16, 0)[3 - n :])


def test_counts_match_brute_force(monkeypatch):
    for text in (EN, DE, "a", "Ab-ab, ÄÖ! x1y", "one  two\n\nthree"):
        for chunk in (1 << 20, 7):
            monkeypatch.setattr(L, "CHUNK", chunk)
            v, c = L.counted_text(L.letters(text))
            got = Counter({as_text(a): int(b) for a, b in zip(v, c)})
            want = brute_grams(text)
            # a space shared by two words is one code: its 2-grams are counted once on each side
            assert got == want, (text, chunk, got - want, want - got)


def test_distance_matches_brute_force():
    prof = {n: L.ranked(*L.counted_text(L.letters(t)), 50).tolist() for n, t in (("en", EN), ("de", DE))}
    p = L.Profiles(prof, 50)
    top = L.ranked(*L.counted_text(L.letters("the house of the dog")), 50).tolist()
    for i, name in enumerate(p.names):
        want = sum(min(50, abs(r - prof[name].index(g))) if g in prof[name] else 50 for r, g in enumerate(top))
        assert np.isclose(p.distances("the house of the dog")[i], want / (50 * len(top)))


def test_table(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "x") for i in range(20)]
    rows += [(100, None, "en", "x"), (101, "123 !?", None, "x"), (None, "", None, None), (102, "the dog " * 30_000, None, None), (103, "😀 漢字", None, None), (102, "the dog " * 30_000, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, id_text string")
    out = L.identify(d, L.learn(d, depth=60)).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r["lang_pred"] for r in out}
    assert all(got[i] == ("en" if i % 2 else "de") for i in range(20))
    assert (got[100], got[101], got[None], got[102]) == ("und", "und", "und", "en")
    assert got[103] in ("de", "en")
    assert all(0 <= r["score"] <= 1 for r in out)
    empty = d.limit(0)
    assert {r["lang_pred"] for r in L.identify(d, L.learn(empty)).collect()} == {"und"}
    assert L.identify(empty, L.learn(d)).count() == 0
