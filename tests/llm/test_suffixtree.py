import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellweave.llm import exchange as X
from cellweave.llm import suffixtree as S


def toks(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


class Brute:
    def __init__(self, texts, least, depth=None):
        self.c, full = Counter(), []
        for t in texts:
            w = toks(t)
            self.c.update(w)
            full.append(["<s>"] + w)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.states, self.depth = {}, 0
        while depth is None or self.depth < depth:
            d, succ, found = self.depth + 1, defaultdict(Counter), {}
            for f in full:
                for i in range(d, len(f)):
                    succ[tuple(f[i - d : i])][f[i]] += 1
            for s, n in succ.items():
                if sum(n.values()) < least:
                    continue
                once = sum(1 for x in n.values() if x == 1)
                k, c2 = once + 1, sum(x for x in n.values() if x > 1)
                below = math.log(max(c2 - 1 + k, 1))
                gain = once * (math.log(k) - below)
                for w, x in n.items():
                    if x > 2:
                        gain += x * (math.log((x - 1) / math.exp(-round(-64 * math.log(self.prob(s[1:], w))) / 64) + k) - below)
                    elif x == 2:
                        gain += 2 * (math.log(k + 1) - below)
                if gain > math.log(max(self.n, 2)):
                    found[s] = ({w: x for w, x in n.items() if x > 1}, k, c2)
            if not found:
                break
            self.states.update(found)
            self.depth = d

    def root(self, w):
        return (self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def prob(self, context, w):
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return self.root(w)
        n, k, c2 = self.states[context]
        return n.get(w, 0) / (c2 + k) + k / (c2 + k) * self.prob(context[1:], w)

    def score(self, text):
        w = ["<s>"] + toks(text)
        return sum(math.log10(self.prob(tuple(w[max(0, i - self.depth) : i]), w[i])) for i in range(1, len(w)))

    def base(self, text):
        return sum(math.log10(self.root(w)) for w in toks(text))


def corpus(n=260):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    chain = {w: rng.sample(words, 3) for w in words}
    rows = []
    for i in range(n):
        w = [rng.choice(words)]
        for _ in range(rng.randint(1, 40)):
            w.append(rng.choice(chain[w[-1]]) if rng.random() < 0.8 else rng.choice(words))
        rows.append((i, " ".join(w).title() if i % 9 == 0 else "\n".join(w), "clash"))
    # each word depends on one, two and three words before it
    sign = {key: rng.choice("abcdef") for d in (1, 2, 3) for key in itertools.product("abcdef", repeat=d)}
    for i in range(40):
        w = ["a", "b", "c"]
        for _ in range(80):
            w.append(sign[tuple(w[-rng.choice([1, 2, 3, 3]) :])])
        rows.append((1000 + i, " ".join(w), "clash"))
    rows += [(500, None, ""), (501, "", ""), (502, "unseen words only", ""), (None, "w1 w2", ""), (3, rows[3][1], "")]
    return rows


@pytest.mark.parametrize("hot, size", [(None, S.BLOCK), (False, 300), (True, S.BLOCK), (True, 300)])
def test_scores_match_brute_force(spark, hot, size, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, held string").repartition(3)
    from pyspark.sql import functions as F

    from cellweave.llm.common import remainder

    if hot:  # few tokens to a range: many states count as hot and are spread
        monkeypatch.setattr(S, "ranges_for", lambda df, text: 512)
        monkeypatch.setattr(S.Model, "often", property(lambda self: 30.0))
    if hot is None:  # no context is cut
        monkeypatch.setattr(S.Model, "often", property(lambda self: 1e9))
    # several blocks, texts longer than a block among them
    monkeypatch.setattr(S.blocks, "__defaults__", (size,))
    out = S.score_texts(df, remainder(F.col("doc_id"), 5) == 1, least=12, worth=0).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    model = Brute([t for i, t, _ in rows if not held(i)], 12)
    assert len(out) == len(rows)
    assert sum(len(s) == 1 for s in model.states) > 5 and model.depth >= 3
    want = {i: (t, held(i)) for i, t, _ in rows}
    for r in out:
        t, h = want[r["doc_id"]]
        assert r["held_out"] == h and r["train_tokens"] == model.n and r["n_tokens"] == len(toks(t))
        assert r["n_known"] == sum(model.c[w] > 0 for w in toks(t))
        assert r["base_score"] == pytest.approx(model.base(t), rel=1e-9)
        assert r["score"] == pytest.approx(model.score(t), rel=1e-9), (r, model.score(t))
    unseen = [r for r in out if r["held_out"] and r["doc_id"] not in (500, 501, 502, None)]
    assert len(unseen) > 30
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_distributions_sum_to_one():
    model = Brute([t for _, t, _ in corpus()], 12)
    for s in list(model.states)[:20] + [()]:
        assert sum(model.prob(s, w) for w in model.c) + model.prob(s, "never seen") == pytest.approx(1)


def test_lengths_stop_when_they_gain_too_little(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus(), "doc_id long, text string, held string")
    total = lambda **how: S.score_texts(df, F.col("doc_id") % 5 == 1, least=12, **how).agg(F.sum("score"), F.sum("base_score")).first()
    short, one, all_ = total(worth=10), total(depth=1), total(worth=0)
    assert tuple(short) == pytest.approx(tuple(one)) and one[1] < one[0] < all_[0]


def test_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b", ""), (2, None, "")], "doc_id long, text string, x string")
    out = S.score_texts(df, F.lit(True), worth=0).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in sorted(out)] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert S.score_texts(df.limit(0), F.lit(False)).count() == 0


def test_packing_round_trips():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        k = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        got = X.unpack(X.pack(k, np.arange(n, dtype=np.uint32), rng.random(n), k.astype(np.uint8), ascending=1))
        assert (got[0] == k).all() and (got[1] == np.arange(n)).all() and len(got[2]) == n and (got[3] == k.astype(np.uint8)).all()
