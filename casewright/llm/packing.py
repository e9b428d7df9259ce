"""Cost-balanced packing of token ids into sequences of a fixed size.

A piece of n tokens costs ``linear * n + quadratic * n * n``, the work of its layers and of
its attention. Pieces go in descending order, each to the sequence of least cost that still has
room for the whole of it; a piece that fits nowhere whole is cut to the largest room
left. The last sequence of a chunk is split into powers of two, which need no padding.

Every task packs what it reads, in chunks of bounded size: nothing is shuffled, and memory
does not grow with the table.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, LINEAR, QUADRATIC = 1024, 1.0, 1.0 / 1024
#: Tokens packed together.
CHUNK = 1 << 22


def pack(lengths: list[int], size: int = SIZE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` for documents of these token counts.

    Every token lies in one piece, and every sequence is full: all have ``size``
    tokens but the last few, whose lengths are different powers of two.
    """
    total = sum(lengths)
    rooms = [size] * (total // size) + [1 << k for k in range(size.bit_length() - 1, -1, -1) if (total % size) >> k & 1]
    used, cost = [0] * len(rooms), [0.0] * len(rooms)
    out, items, filled = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            out.append((doc, start, size, filled, 0))
            filled += 1
        if n % size:
            items.append((-(n % size), doc, n - n % size))
    heapq.heapify(items)
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
    least = np.full(size + 1, np.inf)
    for seq in range(filled, len(rooms)):
        by_room[rooms[seq]].append((0.0, seq))
        least[rooms[seq]] = 0.0
    while items:
        n, doc, start = heapq.heappop(items)
        n = -n
        room = n + int(np.argmin(least[n:]))
        if least[room] == np.inf:  # it fits nowhere whole
            room = int(np.flatnonzero(least < np.inf)[-1])
            heapq.heappush(items, (room - n, doc, start + room))
            n = room
        _, seq = heapq.heappop(by_room[room])
        least[room] = by_room[room][0][0] if by_room[room] else np.inf
        out.append((doc, start, n, seq, used[seq]))
        used[seq] += n
        cost[seq] += linear * n + quadratic * n * n
        if room > n:
            heapq.heappush(by_room[room - n], (cost[seq], seq))
            least[room - n] = by_room[room - n][0][0]
    return out


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Tokens:
    """Ids of whole texts by a tokenizer file.

    A byte-level BPE whose ids follow the order of its merges, cut by ``pattern``, gives the same ids by
    rank; that engine spends a fifth of the CPU time, and reads the vocabulary of
    this file. Any other tokenizer, and a text that spells a special token, is left to the tokenizer itself.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.own.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.ranks = self._by_rank(json.load(f), pattern)

    def _by_rank(self, spec: dict, pattern: str):
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        order = [model["vocab"].get("".join(p), -1) for p in pairs]
        if not plain or order != sorted(set(order)) or order[:1] == [-1]:
            return None
        byte = _bytes_of()
        vocab = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        if len(vocab) != 256 + len(pairs):
            return None
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is None or any(s in text for s in self.special):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ranks.encode_to_numpy(text, disallowed_special=())


_TOKENS: dict[tuple[str, str], Tokens] = {}


def tokens(path: str, pattern: str) -> Tokens:
    if (path, pattern) not in _TOKENS:
        _TOKENS[path, pattern] = Tokens(path, pattern)
    return _TOKENS[path, pattern]


def pack_documents(
    docs: DataFrame, path: str, pattern: str, end_id: int = 0, size: int = SIZE, linear: float = LINEAR, quadratic: float = QUADRATIC, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is the ids of its whole text (null: none) and ``end_id``. ``start`` counts its
    tokens before the piece, ``offset`` those before it in the sequence, without gaps. With
    ``with_ids`` the ids follow. Repeated rows are packed as often as they occur; an empty
    table gives no piece; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType

    def chunk(ids: list, texts: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        made = sorted(pack([len(t) for t in texts], size, linear, quadratic), key=lambda p: (p[3], p[4]))
        part = [texts[d][s : s + n] for d, s, n, _, _ in made]
        cols = [
            pa.array([ids[p[0]] for p in made], id_type),
            pa.array([p[1] for p in made], pa.int64()),
            pa.array([p[2] for p in made], pa.int64()),
            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in part], pa.int64()),
            pa.array([len(texts[p[0]]) for p in made], pa.int64()),
            pa.array([first + p[3] for p in made], pa.int64()),
            pa.array([p[4] for p in made], pa.int64()),
        ]
        if with_ids:
            cols.append(pa.array([x.astype(np.int32) for x in part], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=names), first + max((p[3] for p in made), default=-1) + 1

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    end = np.uint32(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = tokens(path, pattern), TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                got = np.append(own.ids((text.as_py() or b"").decode("utf-8", "replace")), end)
                ids.append(doc)
                texts.append(got)
                held += len(got)
                if held >= CHUNK:
                    out, first = chunk(ids, texts, first)
                    yield out
                    ids, texts, held = [], [], 0
        if ids:
            yield chunk(ids, texts, first)[0]

    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
