"""LM scoring with a probabilistic suffix tree.

Symbols are words and one end for each text; a text's first word follows a start.  A state is a
context of any number of symbols.  A context is a candidate if it occurs ``least`` times in the
training texts, and is retained by a divergence test: what its next-symbol distribution gains, in
log likelihood with each occurrence left out of its own prediction, over its parent (the longest
retained proper suffix) must exceed the logarithm of the number of training tokens.  Lengths go up
by one to the first whose retained contexts gain less than a tenth of a nat for each training token:
gains fall five- to thirtyfold from one length to the next, and shared passages alone would retain single
contexts of any length for next to no gain.

A retained state's distribution interpolates with its parent's:
``P(w|s) = c(s,w) / D + (k / D) * P(w|parent)``, where ``c`` counts successors seen at least twice,
``k`` is one plus the number seen once (their mass goes to the parent) and ``D`` makes it sum to 1;
the root is the smoothed word distribution.  A position is scored in the longest suffix state of
its context.

Texts are tokenised once, into blocks that are staged as packed numbers.  For each length there is
one exchange: a block sends its distinct (context, successor) pairs with their training counts and
what the parent gives them to the ranges of the contexts' hashes, and gets the whole counts and the
contexts' weights back.  The count of a pair is that of the next longer context one position on, so
a block knows which of its contexts are candidates before it asks.  A very frequent context is cut
by its successors into as many shards as it has shares; of these, a fixed number for each range,
sums are added up on the driver.  Contexts are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import col, documents, drop_staged, lean, let_go, remainder, staged
from .exchange import mix, pack, pair, range_of, ranges_for, split_sorted, summed, unpack

#: Tokens of a block; a longer text is a block of its own.
BLOCK = 1_000_000
#: A length whose retained contexts gain less than this for each training token, in nats, is the last.
WORTH = 0.1
#: Parts of a nat in which the parent's probabilities reach the divergence test.
PARTS_OF_NAT = 64
#: The hash of the end; the id of what stands before a text's first word.
END, START = np.uint64(0x6A09E667F3BCC909), 0
#: Rows of all exchanges: range, block, length of context (-1: the block itself), kind, arrays, two numbers.
ROWS = "p int, block long, level int, kind int, payload binary, a long, b long"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
#: Kinds of rows: a block or its answers for whole contexts, answers for shards, what ranges found of whole contexts, of shards.
WHOLE, SHARDS, FOUND, PARTS = 0, 1, 2, 3


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased, and the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    a = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(a, kinds, strict=True)], names=NAMES)


def small(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest kind that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def runs_of(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """(block id, token hashes, lengths of texts, ids, held-out marks) of columns id, held, text."""
    base, seq = TaskContext.get().partitionId() << 32, 0
    toks, ids, held, n = [], [], [], 0

    def done():
        return base + seq, np.concatenate(toks), np.array([len(t) for t in toks]), pa.array(ids, pa.int64()), np.array(held, bool)

    for b in batches:
        for i, h, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
            t = word_hashes(text.as_py())
            if n and n + len(t) > size:
                yield done()
                seq, toks, ids, held, n = seq + 1, [], [], [], 0
            toks.append(t)
            ids.append(i.as_py())
            held.append(h.as_py())
            n += len(t)
    if n:
        yield done()


def pair_order(s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the pairs by context, positions in it where a new pair begins, each pair's number):
    pairs are told apart by the upper half of the context's hash and 32 bits of the pair's."""
    g = (s & np.uint64(0xFFFFFFFF00000000)) | (pair(s, w.astype(np.uint64)) >> np.uint64(32))
    order = np.argsort(g)
    g = g[order]
    new = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    of = np.empty(len(g), np.int64)
    of[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), of


def gains(n: np.ndarray, prob: np.ndarray, of: np.ndarray, total: np.ndarray, once: np.ndarray, once_here: np.ndarray) -> np.ndarray:
    """What each context's successors gain; a pair seen once is predicted by the parent alone."""
    k, c2 = once + 1.0, (total - once).astype(float)
    below = np.log(np.maximum(c2 - 1 + k, 1))
    two = n >= 2
    n, prob, at = n[two].astype(float), prob[two].astype(float), of[two]
    each = np.where(n > 2, n * (np.log((n - 1) / prob + k[at]) - below[at]), 2 * (np.log(k[at] + 1) - below[at]))
    return np.bincount(at, each, len(total)) + once_here * (np.log(k) - below)


class Model:
    """What all blocks need to know: sizes, thresholds, and the very frequent contexts by length."""

    def __init__(self, least: int, ranges: int):
        self.least, self.ranges = least, ranges
        self.n = self.v = self.texts = 0
        self.hot: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @property
    def often(self) -> float:
        """A context that occurs more often would fill a good part of a range: at most 4 for each range do."""
        return max(self.n / (4 * self.ranges), 2.0 * self.least)


class Block:
    """A block of texts and what its exchanges have told so far."""

    def __init__(self, model: Model, rows: list[tuple[int, int, int, bytes]]):
        """rows: (level, kind, range, payload) of the block itself and of its answers."""
        rows = sorted(rows, key=lambda r: r[:3])
        self.model = model
        word, lens, ids, no_id, held, place = unpack(rows[0][3])
        self.lens, self.ids, self.no_id, self.held = lens.astype(np.int64), ids, no_id, held
        got: dict[tuple[int, int], list[list[np.ndarray]]] = {}
        for level, kind, _, payload in rows[1:]:
            got.setdefault((level, kind), []).append(unpack(payload))
        self.got = {k: [np.concatenate(x) for x in zip(*v, strict=True)] for k, v in got.items()}
        known, count = self.got[0, WHOLE]
        self.w, self.count = known[place][word], count[place][word].astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.train = np.repeat(held == 0, self.lens)
        self.at = np.arange(len(word)) - np.repeat(self.starts, self.lens)
        self.prev = np.concatenate(([START], self.w[:-1]))
        self.prev[self.starts] = START
        self.base = (self.count + 0.5) / (model.n + 0.5 * (model.v + 1))
        # contexts of length 1
        self.prob, self.level = self.base.copy(), 1
        self.s = mix(self.prev.astype(np.uint64), 20)
        self.times = np.concatenate(([0], self.count[:-1]))
        self.times[self.starts] = model.texts

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
        """(kind, positions, keys, pair order) of the candidates: whole contexts, then shards."""
        active = self.times >= self.model.least
        heavy = self.times > self.model.often
        for kind, mask in ((WHOLE, active & ~heavy), (SHARDS, active & heavy)):
            pos = np.flatnonzero(mask)
            if not len(pos):
                continue
            key = self.s[pos]
            if kind == SHARDS:
                shards = np.ceil(self.times[pos] / self.model.often).astype(np.uint64)
                key = pair(key, mix(self.w[pos].astype(np.uint64), 21) % np.maximum(shards, 1))
            yield kind, pos, key, pair_order(key, self.w[pos])

    def ask(self, block: int) -> Iterator[tuple]:
        """Rows of (keys, words, training counts, the parent's probabilities[, contexts])."""
        for kind, pos, key, (order, first, of) in self.pairs():
            i = order[first]
            n = np.bincount(of, self.train[pos], len(i)).astype(np.int64)
            p = range_of(key[i], self.model.ranges)
            edges = runs_of(p)
            for lo, hi in zip(edges, np.append(edges[1:], len(p)), strict=True):
                j = i[lo:hi]
                arrays = [key[j], small(self.w[pos[j]]), small(n[lo:hi]), np.rint(-PARTS_OF_NAT * np.log(self.prob[pos[j]])).astype(np.uint16)]
                if kind == SHARDS:
                    arrays.append(self.s[pos[j]])
                yield int(p[lo]), block, self.level, kind, pack(*arrays, ascending=1), 0, 0

    def learn(self) -> None:
        """Takes this length's answers in and goes on to the next."""
        count = np.zeros(len(self.w), np.int64)
        for kind, pos, key, (order, first, of) in self.pairs():
            if kind == WHOLE:
                c, k, d = self.got[self.level, kind]
                run = np.zeros(len(first), np.int64)
                run[runs_of(key[order[first]])[1:]] = 1
                at = np.cumsum(run)[of]
                k, d = k[at], d[at]
            else:
                (c,) = self.got[self.level, kind]
                states, hot_k, hot_d = self.model.hot[self.level]
                at = np.searchsorted(states, self.s[pos])
                k, d = hot_k[at], hot_d[at]
            c = c[of].astype(np.int64)
            count[pos] = c
            kept = k > 0
            at = pos[kept]
            own = np.where(c >= 2, c, 0)[kept]
            self.prob[at] = own / d[kept] + k[kept] / d[kept] * self.prob[at]
        self.level += 1
        self.times = np.concatenate(([0], count[:-1]))
        self.times[self.starts] = 0
        self.s = pair(np.concatenate((self.s[:1], self.s[:-1])), self.prev.astype(np.uint64))

    def scores(self) -> pa.Table:
        lens, starts = self.lens, self.starts
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table({
            "doc_id": pa.array(self.ids, mask=self.no_id.astype(bool)), "held_out": self.held.astype(bool), "n_tokens": lens,
            "n_known": add((self.count > 0).astype(np.int64)), "train_tokens": np.full(len(lens), self.model.n, np.int64),
            "base_score": add(np.log10(self.base)), "score": add(np.log10(self.prob)),
        })


def _rows_of(t: pa.Table) -> list[tuple[int, int, int, bytes]]:
    return [(level, kind, p, x.as_py()) for level, kind, p, x in zip(t["level"].to_pylist(), t["kind"].to_pylist(), t["p"].to_pylist(), t["payload"], strict=True)]


def read_blocks(rows: DataFrame, ranges: int) -> DataFrame:
    """Blocks (level -1, a: training texts) and, for each, its words by range with training counts."""

    def run(batches):
        for block, tokens, lens, ids, held in blocks(batches):
            words, word, n = np.unique(tokens, return_inverse=True, return_counts=True)
            by_count = np.argsort(-n, kind="stable")  # frequent words have small numbers, which pack well
            number = np.empty(len(words), np.int64)
            number[by_count] = np.arange(len(words))
            body = pack(small(number[word]), small(lens), np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()).astype(np.uint8), held.astype(np.uint8), small(by_count))
            trained = np.bincount(word, np.repeat(~held, lens), len(words)).astype(np.int64)
            yield as_batch([(-1, block, -1, WHOLE, body, int((~held).sum()), 0)])
            yield as_batch([(p, block, 0, WHOLE, x, 0, 0) for p, _, x in split_sorted(block, words, ranges, small(trained))])

    return rows.mapInArrow(lean(run), ROWS)


def number_words(asked: DataFrame, ranges: int) -> DataFrame:
    """Answers (level 0) with each word's number, small for frequent words, and training count; and
    a row for each range with its training tokens and distinct training words."""

    def work(t: pa.Table) -> pa.Table:
        p = t["p"][0].as_py()
        parts = [unpack(x.as_py()) for x in t["payload"]]
        keys, count, _ = summed(np.concatenate([a[0] for a in parts]), np.concatenate([a[1].astype(np.int64) for a in parts]))
        number = np.empty(len(keys), np.int64)
        number[np.argsort(-count, kind="stable")] = 1 + p + ranges * np.arange(len(keys))
        out = [(p, -1, 0, FOUND, None, int(count.sum()), int((count > 0).sum()))]
        for block, (asked_keys, _) in zip(t["block"].to_pylist(), parts, strict=True):
            at = np.searchsorted(keys, asked_keys)
            out.append((p, block, 0, WHOLE, pack(small(number[at]), small(count[at])), 0, 0))
        return pa.Table.from_batches([as_batch(out)])

    return asked.groupBy("p").applyInArrow(work, ROWS)


def count_contexts(asked: DataFrame, least: int, limit: float, ranges: int) -> DataFrame:
    """Answers to ``Block.ask``: counts of the pairs and, for runs of a context, weight k (0: not
    retained) and D; rows with the number of retained contexts and their gain; what shards have found."""

    def work(t: pa.Table) -> pa.Table:
        p, level = t["p"][0].as_py(), t["level"][0].as_py()
        kinds, blocks_, out = t["kind"].to_pylist(), t["block"].to_pylist(), []
        for kind in (WHOLE, SHARDS):
            mine = [i for i, k in enumerate(kinds) if k == kind]
            if not mine:
                continue
            parts = [unpack(t["payload"][i].as_py()) for i in mine]
            s, w, n = (np.concatenate([a[j].astype(k) for a in parts]) for j, k in ((0, np.uint64), (1, np.uint64), (2, np.int64)))
            prob = np.exp(np.concatenate([a[3] for a in parts]) / -float(PARTS_OF_NAT))
            order, first, of = pair_order(s, w)
            whole = np.bincount(of, n, len(first)).astype(np.int64)
            i = order[first]
            # contexts whose hashes agree in the upper half lie mixed: number them exactly
            state, number = np.unique(s[i], return_inverse=True)
            total = np.bincount(number, whole, len(state)).astype(np.int64)
            once = np.bincount(number, whole == 1, len(state)).astype(np.int64)
            if kind == WHOLE:
                gain = gains(whole, prob[i], number, total, once, once)
                good = (total >= least) & (gain > limit)
                k, d = np.where(good, once + 1, 0), total + 1  # D = (total - once) + (once + 1)
                out.append((p, -1, level, FOUND, None, int(good.sum()), int(gain[good].sum())))
            else:
                real = np.concatenate([a[4] for a in parts])[i]
                of_state = np.zeros(len(state), np.uint64)
                of_state[number] = real
                two = whole >= 2
                out.append((p, -1, level, PARTS, pack(of_state, total, once, small(whole[two]), prob[i][two], small(number[two])), 0, 0))
            lo = 0
            for at, a in zip(mine, parts, strict=True):
                mine_of = of[lo : lo + len(a[0])]
                lo += len(a[0])
                arrays = [small(whole[mine_of])]
                if kind == WHOLE:
                    heads = number[mine_of[runs_of(a[0])]]
                    arrays += [small(k[heads]), small(d[heads])]
                out.append((p, blocks_[at], level, kind, pack(*arrays), 0, 0))
        return pa.Table.from_batches([as_batch(out)])

    return asked.groupBy("p").applyInArrow(work, ROWS)


def hot_contexts(found: DataFrame, limit: float, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """((contexts ascending, k or 0, D), the gain of the retained) of the contexts that were cut into
    shards.  Their number, checked against ``most``, is a fixed multiple of the number of ranges."""
    parts = found.where(F.col("kind") == PARTS).select("payload")

    def sums(batches):
        for b in batches:
            for x in b.column(0):
                s, total, once, *_ = unpack(x.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(total), pa.array(once)], names=["s", "t", "o"])

    got = parts.mapInArrow(sums, "s long, t long, o long").groupBy("s").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).limit(most + 1).toArrow()
    if len(got) > most:
        raise RuntimeError("more very frequent contexts than there can be")
    if not len(got):
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)), 0.0
    s, total, once = got["s"].to_numpy().view(np.uint64), got["t"].to_numpy(), got["o"].to_numpy()
    order = np.argsort(s)
    s, total, once = s[order], total[order], once[order]
    known = found.sparkSession.sparkContext.broadcast((s, total, once))

    def gained(batches):
        states, totals, onces = known.value
        for b in batches:
            for x in b.column(0):
                mine, _, once_here, n, prob, of = unpack(x.as_py())
                at = np.searchsorted(states, mine)
                g = gains(n, prob, of.astype(np.int64), totals[at], onces[at], once_here)
                yield pa.RecordBatch.from_arrays([pa.array(mine.view(np.int64)), pa.array(g)], names=["s", "g"])

    gain = parts.mapInArrow(gained, "s long, g double").groupBy("s").agg(F.sum("g").alias("g")).toArrow()
    of = np.zeros(len(s))
    of[np.searchsorted(s, gain["s"].to_numpy().view(np.uint64))] = gain["g"].to_numpy()
    good = of > limit
    return (s, np.where(good, once + 1, 0), total + 1), float(of[good].sum())


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int | None = None, least: int = 16, worth: float = WORTH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from the rows that ``held_out`` (not null) doesn't mark.  ``base_score`` is the
    log10 probability under the root alone, ``score`` under the tree.  Contexts grow
    to the first length whose retained ones gain no more than ``worth`` nats for each training token
    (0: until none is retained), or to ``depth`` if that is given.  A null or empty text is its
    end alone; repeated rows count and are scored each; with nothing to learn from, every word has
    the root's smoothed probability of an empty count.  An empty table gives no rows.  Other columns
    are not read.
    """
    rows = docs.select(col(id_col).cast("long").alias("id"), held_out.alias("held"), col(text_col).cast("string").alias("text"))
    ranges = ranges_for(rows, "text")
    model = Model(least, ranges)
    read = staged(read_blocks(rows, ranges), "blocks", by="level")
    body, asked = read.where("level = -1"), read.where("level = 0")
    answers = [staged(number_words(asked, ranges), "words")]
    n, v = answers[0].where(F.col("kind") == FOUND).agg(F.sum("a"), F.sum("b")).first()
    model.n, model.v = int(n or 0), int(v or 0)
    model.texts = int(body.agg(F.sum("a")).first()[0] or 0)
    drop_staged(read, "/level=0")
    limit = float(np.log(max(model.n, 2)))

    def with_answers() -> DataFrame:
        known = reduce(DataFrame.union, [a.where(F.col("kind") <= SHARDS) for a in answers])
        return body.select(*NAMES).union(known.select(*NAMES)).groupBy("block")

    def block_at(t: pa.Table, level: int) -> Block:
        b = Block(model, _rows_of(t))
        while b.level < level:
            b.learn()
        return b

    def asking(level: int):
        def ask(t: pa.Table) -> pa.Table:
            out = pa.Table.from_batches([as_batch(list(block_at(t, level).ask(t["block"][0].as_py())))])
            let_go()
            return out

        return ask

    level = 1
    while model.n and (depth is None or level <= depth):
        found = staged(count_contexts(with_answers().applyInArrow(asking(level), ROWS), least, limit, ranges), f"contexts{level}")
        gain = found.where(F.col("kind") == FOUND).agg(F.sum("b")).first()[0] or 0
        model.hot[level], hot_gain = hot_contexts(found, limit, 4 * ranges)
        answers.append(found)
        level += 1
        if gain + hot_gain <= worth * model.n:
            break

    def score(t: pa.Table) -> pa.Table:
        return block_at(t, level).scores()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_answers().applyInArrow(score, schema)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those whose crc32(doc_id as text) mod 5 is not 1:
    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Nulls, empty texts, repeated rows and empty tables as in ``score_texts``."""
    return score_texts(documents(spark, sf_dir), remainder(F.col("doc_id"), 5) == 1)
