"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is cut into pieces by the vocabulary's pattern; pieces are independent, so texts are the
free concatenation of their encodings.  Within a piece the encoding is a tree reduction: both
halves are encoded recursively, and neighbours are joined by re-encoding a window of bytes round
the boundary.  The window grows, by one token, two, four and so on, on the side that isn't settled, until its first
and its last token stand firm against the tokens outside: a token sequence is the encoding of its
bytes exactly when every two neighbours are the encoding of theirs (until some merge crosses a
boundary between tokens, each token's own merges go on as they would alone; the first crossing
merge would happen in that pair as well).  So tokens outside a firm window provably stay.

Decoding concatenates the tokens' bytes up a tree.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, documents, lean

#: Unicode White_Space, which \s means in the pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Below this code point the letters and numbers are listed for the standard library's matcher.
FAST_BELOW = 0x250


def _ranges(prop: str) -> str:
    """The characters below FAST_BELOW with a Unicode property, as the inside of a class."""
    match = regex.compile(prop).match
    return "".join(f"\\u{c:04x}" for c in range(FAST_BELOW) if match(chr(c)))


class Splitter:
    """Cuts a text into the matches of a pattern; ``findall`` is exact for any text."""

    def __init__(self, pattern: str):
        explicit = pattern.replace("[^\\s", f"[^{WHITE}").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]")
        self.general = regex.compile(explicit).findall
        letters, numbers = _ranges(r"\p{L}"), _ranges(r"\p{N}")
        inside = explicit.replace("[^" + WHITE + r"\p{L}\p{N}]", f"[^{WHITE}{letters}{numbers}]")
        self.fast = re.compile(inside.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")).findall
        self.odd = re.compile(f"[^\\x00-\\u{FAST_BELOW - 1:04x}]").search

    def __call__(self, text: str) -> list[str]:
        return self.general(text) if self.odd(text) else self.fast(text)


class MonoidBPE:
    """ranks: bytes of each token -> id; every single byte is a token."""

    #: Segments up to so many bytes are the leaves.
    LEAF = 6
    #: Entries of a memo before its older half is let go.
    MEMO = 80_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, Splitter(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self._firm: dict[int, bool] = {}
        self._segments: dict[bytes, tuple[int, ...]] = {}
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def merge(self, b: bytes) -> tuple[int, ...]:
        """The merges of a segment, lowest rank first, leftmost first."""
        if len(b) > 64:
            return self._merge_long(b)
        parts = [b[i : i + 1] for i in range(len(b))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _merge_long(self, b: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list: n log n for a window that had to grow long."""
        get, n = self.ranks.get, len(b)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if not gone[i] else n
            if j >= n or get(b[i : end[j]]) != r:
                continue  # stale: a side has changed since
            end[i], after[i], gone[j] = end[j], after[j], 1
            if after[i] < n:
                before[after[i]] = i
                if (x := get(b[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := get(b[h : end[i]])) is not None:
                heapq.heappush(heap, (x, h))
        return tuple([self.ranks[b[i : end[i]]] for i in range(n) if not gone[i]])

    def firm(self, left: int, right: int) -> bool:
        """Are two tokens side by side the encoding of their bytes?"""
        key = left * len(self.bytes_of) + right
        known = self._firm.get(key)
        if known is None:
            if len(self._firm) > 4 * self.MEMO:
                self._firm.clear()
            a, b = self.bytes_of[left], self.bytes_of[right]
            known = self._firm[key] = self.merge(a + b) == (left, right)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left or right
        if self.firm(left[-1], right[0]):
            return left + right
        i, j, step = len(left) - 1, 1, 1
        while True:
            window = self.segment(b"".join([self.bytes_of[t] for t in left[i:] + right[:j]]))
            grow_left = i > 0 and not self.firm(left[i - 1], window[0])
            grow_right = j < len(right) and not self.firm(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:i] + window + right[j:]
            i, j, step = max(0, i - step * grow_left), min(len(right), j + step * grow_right), 2 * step

    def segment(self, b: bytes) -> tuple[int, ...]:
        """A window's own encoding, by its merges; windows are mostly a few tokens long."""
        if len(b) > 64:
            return self.merge(b)
        out = self._segments.get(b)
        if out is None:
            if len(self._segments) > self.MEMO:
                self._segments.clear()
            out = self._segments[b] = self.merge(b)
        return out

    def encode_bytes(self, b: bytes) -> tuple[int, ...]:
        """The tree: leaves are short segments, inner nodes join their halves."""
        if len(b) <= self.LEAF:
            return self.segment(b) if b else ()
        half = len(b) // 2
        return self.join(self.encode_bytes(b[:half]), self.encode_bytes(b[half:]))

    def piece(self, text: str) -> bytes:
        """The ids of one match of the pattern, packed as little-endian 32-bit numbers."""
        packed = self._old.get(text)
        if packed is None:
            b = text.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            ids = (whole,) if whole is not None else self.encode_bytes(b)
            packed = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(text) <= 64:
            if len(self._new) >= self.MEMO:
                self._old, self._new = self._new, {}
            self._new[text] = packed
        return packed

    def encode(self, text: str) -> bytes:
        get = self._new.get
        return b"".join([get(p) or self.piece(p) for p in self.split(text)])

    def decode(self, packed: bytes) -> bytes:
        """Concatenates up a tree: runs of tokens are the leaves."""
        ids = memoryview(packed).cast("I") if packed else ()
        of = self.bytes_of

        def up(lo: int, hi: int) -> bytes:
            if hi - lo <= 4096:
                return b"".join([of[i] for i in ids[lo:hi]])
            mid = (lo + hi) // 2
            return up(lo, mid) + up(mid, hi)

        return up(0, len(ids))


_made: dict[tuple[str, str], MonoidBPE] = {}


def tokenizer(path: str, pattern: str) -> MonoidBPE:
    """One for each file and pattern in a process; the file lies on every machine, as libraries do."""
    if (path, pattern) not in _made:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made[path, pattern] = MonoidBPE(ranks, pattern)
    return _made[path, pattern]


def _vocabulary(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


#: Bytes of results in a batch on its way back to the JVM: long texts leave in small batches.
HELD = 4 << 20


def _add_binary(df: DataFrame, keep: list[str], source: str, outs: list[str], work: Callable[[], Callable]) -> DataFrame:
    """``keep`` and binary columns ``outs``, which the function made by ``work`` gives for ``source``."""
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(out, T.BinaryType(), True) for out in outs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for batch in batches:
            start, held, got = 0, 0, []

            def done(batch=batch):
                kept = [batch.column(i).slice(start, len(got)) for i in range(len(keep))]
                return pa.RecordBatch.from_arrays([*kept, *[pa.array(x, pa.binary()) for x in zip(*got, strict=True)]], names=[*keep, *outs])

            for x in batch.column(len(keep)):
                got.append(f(x.as_py()))
                held += sum(map(len, got[-1]))
                if held > HELD:
                    yield done()
                    start, held, got = start + len(got), 0, []
            if got:
                yield done()

    return df.select(*[col(c) for c in keep], col(source).alias(outs[0])).mapInArrow(lean(run), schema)


def encode_texts(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids", decoded: str | None = None,
                 vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``keep`` columns and ``out``: each whole text's token ids as little-endian 32-bit numbers;
    with ``decoded``, also a column of that name with the bytes that the ids decode to.

    A null text counts as empty and has no ids; rows stay one to one, repeated rows included; an
    empty table gives an empty table.  Columns that aren't in ``keep`` are not read.  Encoding and
    decoding run in one Python worker, which holds one vocabulary.
    """
    name = vocabulary

    def work():
        bpe = tokenizer(*_vocabulary(name))

        def both(text: str | None) -> tuple[bytes, ...]:
            ids = bpe.encode(text or "")
            return (ids, bpe.decode(ids)) if decoded else (ids,)

        return both

    return _add_binary(df, list(keep), text_col, [out, decoded] if decoded else [out], work)


def decode_ids(df: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded",
               vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``keep`` columns and ``out``: the bytes that packed ids stand for (null ids: none)."""
    name = vocabulary

    def work():
        bpe = tokenizer(*_vocabulary(name))
        return lambda ids: (bpe.decode(ids or b""),)

    return _add_binary(df, list(keep), ids_col, [out], work)


def encoded_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, digested from the ids and the
    decoded bytes; nulls, empty and repeated rows as in ``encode_texts``."""
    both = encode_texts(docs, decoded="decoded")
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded bytes as digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    A null text counts as empty; repeated rows each have their row; an empty table gives none."""
    return encoded_documents(documents(spark, sf_dir))
