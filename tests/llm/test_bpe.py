import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cellweave.llm import bpe


@pytest.fixture(scope="module")
def both():
    mine = bpe.tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})
    return mine, theirs


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


ALPHABETS = ["abcdeth  '", "\n\t \x1c\x85\xa0　x1", "éüñ漢字😀 a²½", "ththeing", "!!*#$ \r\n", "aA'sS'll 0123", "<|endoftext|>"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 40, 300])
def test_matches_the_library_and_decodes(both, n):
    mine, theirs = both
    rng = random.Random(n)
    for a in [*ALPHABETS, "".join(ALPHABETS)]:
        for _ in range(60):
            s = "".join(rng.choice(a) for _ in range(n))
            assert ids(mine.encode(s)) == theirs.encode_ordinary(s), s
            assert mine.decode(mine.encode(s)) == s.encode()


def test_very_long_pieces(both):
    mine, theirs = both
    for s in ("a" * 30_000, "the" * 20_000, " " * 9_999, "漢" * 5_000, "ab cd\n" * 20_000):
        assert ids(mine.encode(s)) == theirs.encode_ordinary(s)
        assert mine.decode(mine.encode(s)) == s.encode()


def test_any_grouping_gives_the_same(both):
    """join is associative: cutting the bytes anywhere gives the same encoding."""
    mine, _ = both
    rng = random.Random(5)
    for _ in range(300):
        b = "".join(rng.choice("thenigsé!") for _ in range(24)).encode()
        i, j = sorted(rng.sample(range(len(b) + 1), 2))
        x, y, z = (mine.merge(p) for p in (b[:i], b[i:j], b[j:]))
        assert mine.join(mine.join(x, y), z) == mine.join(x, mine.join(y, z)) == mine.merge(b)


def test_memo_turnover(both):
    small = bpe.MonoidBPE(both[0].ranks, P.PATTERN)
    small.MEMO = 3
    s = "many different words that fall out of a small memo, and come again: many different words"
    assert ids(small.encode(s)) == both[1].encode_ordinary(s)


def test_table(spark, both):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (2, None, "x"), (None, "", "x"), (3, "long " * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encoded_documents(df).collect()
    assert len(out) == len(rows)
    for doc_id, text, _ in rows:
        want = np.array(both[1].encode_ordinary(text or ""), "<u4").tobytes()
        got = [r for r in out if r["doc_id"] == doc_id]
        assert all(r["n_tokens"] == len(want) // 4 for r in got)
        assert all(r["ids_sha256"] == hashlib.sha256(want).hexdigest() for r in got)
        assert all(r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest() for r in got)
    assert bpe.encoded_documents(df.limit(0)).count() == 0


def test_vocabulary_is_the_public_one():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        assert len({base64.b64decode(line.split()[0]) for line in f}) == 50_256
