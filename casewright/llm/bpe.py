"""Byte-level BPE by longest matches and backtracking.

The vocabulary is a trie over bytes, each mapped to the Latin-1 character of its value. A
sequence of tokens is what the merges would give if and only if every two adjacent tokens are
compatible: merging their joint bytes leaves the border between them. So the encoder takes the
longest match, steps down to a shorter one when it does not go with the token before, and
backtracks when none does; a position that was given up is never tried again, which keeps the
work linear.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import slices

#: Pieces remembered by a worker, and their longest length: about 100 MB at the most.
MEMO, MEMO_CHARS = 300_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one vocabulary ``{token bytes: rank}``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.trie.add_word(t.decode("latin-1"), r)
        self.trie.make_automaton()
        self.whole = {t: r for t, r in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.goes: dict[tuple[int, int], bool] = {}
        self.down: dict[int, int] = {}
        self.memo: dict[str, bytes] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self.halves:
            parts = self._merge(self.bytes_of[token], token)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _merge(self, text: bytes, below: int) -> list[bytes]:
        """Merges by rank, those under ``below`` only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] >= below:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes keeps the border between the two tokens.

        Undo merges of the inner halves from the latest back; a merge across the border that
        comes before both of the merges that it competes with would have happened first.
        """
        key = (left, right)
        known = self.goes.get(key)
        if known is not None:
            return known
        a, b, limit, out = left, right, 1 << 62, True
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < limit and self.split(joined) == (a, b):
                out = False
                break
            # of the two, the later merge is undone; of equal ranks the right one, as merges run left to right
            halves_a, halves_b = self.split(a), self.split(b)
            if halves_a and (a > b or not halves_b):
                limit, a = a, halves_a[1]
            elif halves_b:
                limit, b = b + 1, halves_b[0]
            else:
                break
        if len(self.goes) > 2_000_000:
            self.goes.clear()
        self.goes[key] = out
        return out

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        got = self.down.get(token)
        if got is None:
            t, got = self.bytes_of[token], -1
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in self.ranks:
                    got = self.ranks[t[:n]]
                    break
            self.down[token] = got
        return got

    def _longest(self, text: str, at: int) -> int:
        return next(self.trie.iter_long(text, at))[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, end = piece.decode("latin-1"), len(piece)
        length = self.bytes_of
        out: list[int] = []
        at, dead, token = 0, set(), self._longest(text, 0)
        while at < end:
            last = out[-1] if out else -1
            while True:
                stop = at + len(length[token])
                if stop not in dead and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = stop
                    token = self._longest(text, at) if at < end else -1
                    break
                token = self.shorter(token)
                if token < 0:
                    dead.add(at)
                    out.pop()
                    at -= len(length[last])
                    token = self.shorter(last)
                    while token < 0:
                        dead.add(at)
                        last = out.pop()
                        at -= len(length[last])
                        token = self.shorter(last)
                    last = out[-1] if out else -1
        return out

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        memo, parts = self.memo, []
        for piece in self.pattern.findall(text):
            got = memo.get(piece)
            if got is None:
                got = np.array(self.encode_piece(piece.encode("utf-8")), "<u4").tobytes()
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = got
            parts.append(got)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process; the vocabulary file is on every machine."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``, a row per input row.

    Each text, of any length, is encoded whole and decoded again from its ids. Null counts as
    empty: no ids. Nothing is shuffled, and repeated rows stay repeated. An empty table gives an empty result; other columns, whatever their
    names, are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in slices(batches, "text"):
            n, sha, back, ids = [], [], [], []
            for text in b.column(1).to_pylist():
                got = own.ids((text or b"").decode("utf-8", "replace"))
                n.append(len(got) // 4)
                sha.append(hashlib.sha256(got).hexdigest())
                back.append(hashlib.sha256(own.decode(got)).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(got, "<u4").astype(np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded binary``; null ids count as none."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            out = [own.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded binary")
