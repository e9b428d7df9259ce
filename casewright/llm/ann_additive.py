"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one word from each of several full-dimensional codebooks,
found by beam search over the residuals, and the squared norm of that sum is stored with the code. A
query makes one table of dot products a codebook, so the distance to a coded vector is a few table
look-ups and the stored norm. The best of that order are measured again on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import hash_sample, keep

#: Codebooks, words of each, beam, vectors the codebooks are fitted to, and rounds of their refit.
BOOKS, WORDS, BEAM, SAMPLE, REFITS = 24, 256, 4, 8192, 1
#: Candidates measured exactly for each query; coded vectors and queries that meet in one task.
SHORTLIST, GROUP, QUERIES = 240, 65_536, 2048
_ROWS = 512


def _means(x: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 5) -> np.ndarray:
    """Centres of ``words`` clusters; an empty one starts again at a random row."""
    c = x[rng.permutation(len(x))[:words]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(near, minlength=words)
        c = np.stack([np.bincount(near, weights=x[:, d], minlength=words) for d in range(x.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
        lost = np.flatnonzero(n == 0)
        c[lost] = x[rng.integers(0, len(x), len(lost))]
        c = c.astype(np.float32)
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``(n, books)`` by beam search, and the squared norms of the sums they stand for."""
    x = x.astype(np.float32)
    count, words, dim = books.shape
    codes, norms = np.empty((len(x), count), np.uint8), np.empty(len(x), np.float32)
    sizes = (books * books).sum(axis=2)
    for at in range(0, len(x), _ROWS):
        part = x[at : at + _ROWS]
        n = len(part)
        rest, cost, path = part[:, None, :], np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.uint8)
        for m in range(count):
            width = rest.shape[1]
            to = (cost[:, :, None] + sizes[m] - 2 * (rest.reshape(-1, dim) @ books[m].T).reshape(n, width, words)).reshape(n, -1)
            k = min(beam if m < count - 1 else 1, to.shape[1])
            best = np.argpartition(to, k - 1, axis=1)[:, :k]
            cost = np.take_along_axis(to, best, axis=1)
            parent, word = best // words, best % words
            rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - books[m][word]
            path = np.concatenate([np.take_along_axis(path, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        codes[at : at + n] = path[:, 0]
        norms[at : at + n] = ((part - rest[:, 0]) ** 2).sum(axis=1)
    return codes, norms


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, refits: int = REFITS, seed: int = 3) -> np.ndarray:
    """Codebooks ``(books, words, dim)``: clusters of residuals, then least squares of each book given the others."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    words = max(1, min(words, len(x) // 4))
    out, rest = [], x.copy()
    for _ in range(books):
        c = _means(rest, words, rng)
        rest -= c[np.argmin((c * c).sum(1) - 2 * (rest @ c.T), axis=1)]
        out.append(c)
    found = np.stack(out)
    for _ in range(refits):
        codes, _ = encode(x, found, 1)
        off = x - sum(found[m][codes[:, m]] for m in range(books))
        for m in range(books):
            mine = off + found[m][codes[:, m]]
            n = np.bincount(codes[:, m], minlength=words)
            new = np.stack([np.bincount(codes[:, m], weights=mine[:, d], minlength=words) for d in range(x.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
            found[m] = np.where(n[:, None] > 0, new, found[m])  # a word that no vector uses stays where it is
            off = mine - found[m][codes[:, m]]
    return found


def lookup_scores(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Squared distances to the coded vectors, less the squared norm of the query."""
    out = np.broadcast_to(norms, (len(queries), len(norms))).astype(np.float32)
    for m in range(len(books)):
        out -= 2 * np.take((queries @ books[m].T).astype(np.float32), codes[:, m], axis=1)
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """In single precision; components beyond it, and so near-infinite ones, are cut to what codes can be made of."""
    return np.clip(x, -1e15, 1e15).astype(np.float32)


def _least(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` least scores of each row; of equal ones the first."""
    n = scores.shape[1]
    bits = np.ascontiguousarray(scores, np.float32).view(np.int32).astype(np.int64)
    bits ^= (bits >> 63) & 0x7FFFFFFF
    keys = (bits << 24) | np.arange(n)
    if k < n:
        keys = np.partition(keys, k - 1, axis=1)[:, :k]
    return keys & ((1 << 24) - 1)


def usable(vector: Column, dim: int | None = None) -> Column:
    """Neither null nor zero, and every component a finite number."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))) & F.exists(vector, lambda v: v != 0)
    return F.coalesce(fine & (F.size(vector) == dim) if dim is not None else fine, F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 10, shortlist: int = SHORTLIST, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, nearest first.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go
    to the smaller id. A row with the query's own id is no candidate; with fewer candidates all are
    returned. Rows with a null id, or a vector that is null, zero, of another length than most, or holds a
    null or non-finite component take no part. Rows that repeat an id are candidates
    each; of queries that do, one is asked. An empty table gives an empty result. ``is_query`` is evaluated on ``vectors``,
    whose other columns are ignored. Codes are made in single precision, distances measured on the column as it is.
    """
    every = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    some = sorted(hash_sample(every, "vec_id", sample).select("v").limit(2 * sample).collect())
    schema = "query_id long, vec_id long, rough float"
    if not some:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = np.bincount([len(r.v) for r in some])
    dim = int(np.argmax(sizes))
    every = every.where(F.size("v") == dim)
    books = fit(_small(np.array([r.v for r in some if len(r.v) == dim])))
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # of fixed size: BOOKS * WORDS vectors

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _small(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            codes, norms = encode(x, shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=["vec_id", "code", "norm"])

    index = keep(every.select(F.col("vec_id").cast("long"), "v").mapInArrow(code, "vec_id long, code binary, norm float"), "index")
    asking = keep(every.where("asks").select(F.col("vec_id").cast("long"), "v"), "queries")
    # a group of codes meets a group of queries: both of bounded size, whatever the table's
    code_groups, query_groups = -(-max(1, index.count()) // GROUP), -(-max(1, asking.count()) // QUERIES)
    left = index.withColumns({"g": F.pmod(F.xxhash64("vec_id", "code"), F.lit(code_groups)), "q": F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1)))})
    right = asking.withColumns({"q": F.pmod(F.xxhash64("vec_id"), F.lit(query_groups)).cast("int"), "g": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(code_groups - 1).cast("long")))})

    def meet(coded: pa.Table, queries: pa.Table) -> pa.Table:
        coded, queries = coded.sort_by("vec_id"), queries.sort_by("vec_id")
        ids, asked = coded["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        if len(ids) and len(asked):
            codes = np.frombuffer(b"".join(coded["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            norms = coded["norm"].to_numpy()
            x = _small(np.array(queries["v"].to_pylist()))
            step = max(1, min(256, (1 << 24) // len(ids)))
            for at in range(0, len(asked), step):
                s = lookup_scores(x[at : at + step], shared.value, codes, norms)
                best = _least(s, min(len(ids), shortlist + 1))
                out[0].append(np.repeat(asked[at : at + step], best.shape[1]))
                out[1].append(ids[best].ravel())
                out[2].append(np.take_along_axis(s, best, axis=1).ravel())
        kinds = [np.int64, np.int64, np.float32]
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, t) for c, v, t in zip(("query_id", "vec_id", "rough"), out, kinds)})

    met = left.groupBy("g", "q").cogroup(right.groupBy("g", "q")).applyInArrow(meet, schema).where("query_id <> vec_id")
    by_query = Window.partitionBy("query_id")
    short = met.withColumn("n", F.row_number().over(by_query.orderBy("rough", "vec_id"))).where(F.col("n") <= shortlist).select("query_id", "vec_id").distinct()
    original = every.select(F.col("vec_id").cast("long"), "v")
    pairs = short.join(original, "vec_id").join(asking.select(F.col("vec_id").alias("query_id"), F.col("v").alias("w")).dropDuplicates(["query_id"]), "query_id")
    square = F.zip_with("v", "w", lambda a, b: (a - b) * (a - b))
    scored = pairs.select("query_id", "vec_id", F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, d: s + d)).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(by_query.orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
