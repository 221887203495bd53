"""Language ID by rank-order profiles of character n-grams.

A text's letters are lower-cased, everything else becomes one space, and its 1- to 3-grams (none
across words) are ranked by count.  A language's profile is the ranking of its training texts'
n-grams.  The out-of-place distance is the sum over the text's most frequent n-grams of how far
their rank is from the profile's, ``depth`` for those that the profile lacks; the language of
least distance wins, ties going to the lesser name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, documents, fresh, remainder

#: N-grams in a profile and of a text.
DEPTH = 300
#: Characters that are worked on at once.
CHUNK = 1 << 20

_table: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point of the basic plane -> the 16-bit code of its lower case, 0 for what is no letter."""
    if not _table:
        t = np.zeros(1 << 16, np.uint16)
        for c in range(1 << 16):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
        _table.append(t)
    return _table[0]


def letters(text: str) -> np.ndarray:
    """Codes of a text's letters, 0 between, before and after words; letters beyond the basic
    plane share one code."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letter_table()[np.minimum(points, 0xFFFF)]
    for at in np.flatnonzero(points > 0xFFFF):
        codes[at] = 0xFFFF if chr(points[at]).isalpha() else 0
    codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
    return codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]


def grams(codes: np.ndarray) -> np.ndarray:
    """The codes of all 1-, 2- and 3-grams: 16 bits a letter, sizes apart in the top bits."""
    one = codes[codes != 0] | np.uint64(1 << 48)
    two = (codes[:-1] << np.uint64(16)) | codes[1:] | np.uint64(2 << 48)
    inner = codes[1:-1] != 0
    three = ((codes[:-2] << np.uint64(32)) | (codes[1:-1] << np.uint64(16)) | codes[2:])[inner] | np.uint64(3 << 48)
    return np.concatenate((one, two, three))


def counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and counts."""
    g = np.sort(g)
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    return g[first], np.diff(np.append(first, len(g)))


def ranked(values: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The most frequent, by count, then code."""
    if len(values) > 4 * depth:  # ties with the last count stay in
        least = np.partition(counts, -depth)[-depth]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))[:depth]]


class Profiles:
    def __init__(self, ranks: dict[str, list[int]], depth: int = DEPTH):
        self.names, self.depth = sorted(ranks), depth
        self.all = np.unique(np.array([g for r in ranks.values() for g in r], np.uint64))
        self.rank = np.full((len(self.names), len(self.all) + 1), -1)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.all, np.array(ranks[name], np.uint64))] = np.arange(len(ranks[name]))

    def distances(self, text: str) -> np.ndarray | None:
        """A distance in 0..1 for each language; None for a text without letters."""
        codes = letters(text)
        if len(codes) < 2:
            return None
        top = ranked(*counted_text(codes), self.depth)
        at = np.minimum(np.searchsorted(self.all, top), len(self.all) - 1) if len(self.all) else np.zeros(len(top), int)
        known = self.all[at] == top if len(self.all) else np.zeros(len(top), bool)
        there = np.where(known, self.rank[:, at], -1)
        off = np.where(there >= 0, np.minimum(np.abs(there - np.arange(len(top))), self.depth), self.depth)
        return off.sum(1) / (self.depth * len(top))

    def predict(self, text: str | None) -> tuple[str, float]:
        d = self.distances(text or "") if self.names else None
        if d is None:
            return "und", 0.0
        best = int(d.argmin())
        rest = np.delete(d, best)
        second = rest.min() if len(rest) else 1.0
        return self.names[best], float(1 - d[best] / second) if second > 0 else 0.0


def gram_chunks(codes: np.ndarray) -> Iterator[np.ndarray]:
    """``grams(codes)`` in parts of bounded size: each starts where the last one ended, and an
    n-gram belongs to the part that it starts in."""
    if len(codes) <= CHUNK:
        yield grams(codes)
        return
    for lo in range(0, len(codes), CHUNK):
        c0 = codes[lo : lo + CHUNK]
        c1, c2 = codes[lo + 1 : lo + CHUNK + 1], codes[lo + 2 : lo + CHUNK + 2]
        yield c0[c0 != 0] | np.uint64(1 << 48)
        yield (c0[: len(c1)] << np.uint64(16)) | c1 | np.uint64(2 << 48)
        inner = c1[: len(c2)] != 0
        yield ((c0[: len(c2)] << np.uint64(32)) | (c1[: len(c2)] << np.uint64(16)) | c2)[inner] | np.uint64(3 << 48)


def counted_text(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``counted(grams(codes))`` in bounded memory."""
    values = counts = None
    for part in gram_chunks(codes):
        v, c = counted(part)
        values, counts = (v, c) if values is None else _merged(np.concatenate((values, v)), np.concatenate((counts, c)))
    return values, counts


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, gram, n`` over all rows with a text and a language, summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        wait: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}

        def fold(lang: str) -> None:
            v, c = counted(np.concatenate(wait.pop(lang)))
            if lang in have:
                v, c = _merged(np.concatenate((have[lang][0], v)), np.concatenate((have[lang][1], c)))
            have[lang] = v, c
            held[lang] = 0

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                codes, lang = letters(text.as_py()), lang.as_py()
                for part in gram_chunks(codes):
                    wait.setdefault(lang, []).append(part)
                    held[lang] = held.get(lang, 0) + len(part)
                    if held[lang] > CHUNK:
                        fold(lang)
        for lang in list(wait):
            fold(lang)
        for lang, (v, c) in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(v.astype(np.int64)), pa.array(c)], names=["lang", "gram", "n"])

    rows = docs.select(col(text_col).alias("text"), col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    parts = rows.mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH) -> Profiles:
    """The profiles of all languages of ``docs``: ``depth`` n-grams for each are brought to the
    driver, so the number of languages (not of documents) bounds the model."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(docs, text_col, lang_col).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= depth)
    ranks: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        ranks.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranks, depth)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``: one minus the least distance over the next.

    A null text and a text without letters get ``und`` and 0, as does every text if no language
    was learned.  Rows stay one to one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    rows = docs.select(*[col(c) for c in keep], col(text_col).alias(fresh(docs.select(*keep), "id_text")[0]))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def op5_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, learned from rows whose crc32(doc_id as text) mod
    4 is not 2; ``und`` where the text is null or has no letter.  No documents give no rows."""
    docs = documents(spark, sf_dir)
    profiles = learn(docs.where(remainder(F.col("doc_id"), 4) != 2))
    out = identify(docs, profiles)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
