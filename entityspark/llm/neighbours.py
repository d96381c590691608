"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one full-dimensional word from each of M codebooks. The codebooks are fitted on
a bounded sample as residual k-means and refined by least squares; encoding keeps a beam of the best partial sums. The
index holds M bytes and the length of the rest, what the approximation lacks, for each distinct vector. A query's inner
products with all code words make a lookup table, and sums of M entries score the whole index. The best by that score are
scored exactly; every row whose bound, its score plus the product of the query's length and the rest's, reaches the worst
of the best k + 1 of these is then scored exactly too, so no neighbour is lost, whatever the codes are worth.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, packed, partitions, table

#: Codebooks, their words, beam width, and vectors in the sample on which the codebooks are fitted.
BOOKS, WORDS, BEAM, SAMPLE = 8, 256, 8, 16_384
#: Rows that are encoded at a time.
ROWS = 1024
#: Share of index rows within the bound beyond which one product with all rows is cheaper than picking them.
DENSE = 1 / 16
#: Index rows and queries that meet at a time, and the candidates whose exact scores set a query's bound there.
INDEX_BLOCK, QUERY_BLOCK, CANDIDATES = 65_536, 8192, 128


@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dimensions
    products: np.ndarray  # inner products of all words with each other

    @classmethod
    def of(cls, words: np.ndarray) -> Codebooks:
        flat = words.reshape(-1, words.shape[2])
        return cls(words, (flat @ flat.T).reshape(words.shape[0], words.shape[1], words.shape[0], words.shape[1]))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes by beam search, of some rows at a time."""
        return np.concatenate([self._encode(x[at : at + ROWS], beam) for at in range(0, len(x), ROWS)])

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        """The squared error of a partial sum grows by |c|^2 - 2 x.c + 2 sum of c.c' with the words chosen before."""
        n, books, k = len(x), len(self.words), self.words.shape[1]
        codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for m in range(books):
            norm = self.products[m, np.arange(k), m, np.arange(k)]
            step = cost[:, :, None] + (norm[None, :] - 2 * x @ self.words[m].T)[:, None, :]
            for b in range(m):
                step += 2 * self.products[b][codes[:, :, b], m]
            flat = step.reshape(n, -1)
            w = min(beam, flat.shape[1])
            best = np.argpartition(flat, w - 1, 1)[:, :w]
            from_, word = best // k, best % k
            codes = np.concatenate([np.take_along_axis(codes, from_[:, :, None], 1), word[:, :, None]], 2)
            cost = np.take_along_axis(flat, best, 1)
        return np.take_along_axis(codes, cost.argmin(1)[:, None, None], 1)[:, 0].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        near = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, rounds: int = 2, seed: int = 11) -> Codebooks:
    x = x.astype(np.float32)
    rng = np.random.default_rng(seed)
    left, out = x.copy(), []
    for _ in range(books):
        c = _kmeans(left, words, rng).astype(np.float32)
        out.append(c)
        left -= c[((c**2).sum(1)[None, :] - 2 * left @ c.T).argmin(1)]
    fitted = Codebooks.of(np.stack(out))
    for _ in range(rounds):  # all words at once: least squares of the sample on its codes, kept close to the words so far
        codes = fitted.encode(x, beam).astype(np.int64) + np.arange(books)[None, :] * words
        a = np.zeros((books * words, books * words), np.float64)
        for m in range(books):
            for b in range(books):
                np.add.at(a, (codes[:, m], codes[:, b]), 1.0)
        right = np.zeros((books * words, x.shape[1]))
        for m in range(books):
            np.add.at(right, codes[:, m], x)
        old = fitted.words.reshape(books * words, -1)
        new = np.linalg.solve(a + np.eye(len(a)), right + old)
        fitted = Codebooks.of(new.reshape(fitted.words.shape).astype(np.float32))
    return fitted


def reaching(q: np.ndarray, x: np.ndarray, codes: np.ndarray, rest: np.ndarray, books: Codebooks, k: int, candidates: int) -> list[np.ndarray]:
    """For each query, the rows of x that may be among its k best by inner product: all of them and their ties.

    codes has a row for each book, and rest[i] is at least the distance of x[i] from its approximation.
    """
    lut = np.einsum("qd,mwd->mqw", q.astype(np.float32), books.words)
    guess = lut[0][:, codes[0]]
    for i in range(1, len(codes)):
        guess += lut[i][:, codes[i]]
    k, c = min(k, len(x)), min(max(candidates, k), len(x))
    first = np.argpartition(-guess, c - 1, 1)[:, :c]
    length = np.sqrt((q**2).sum(1))
    # What rounding may cost: in single precision the sum of the tables' entries, in double the products.
    loose = 1e-5 * length * np.sqrt((books.words.astype(np.float64) ** 2).sum(2).max(1)).sum()
    close = 1e-12 * length * np.sqrt((x**2).sum(1).max())
    floor = np.array([np.partition(x[f] @ v, c - k)[c - k] for f, v in zip(first, q)]) - close
    within = guess + length[:, None] * rest[None, :] + loose[:, None] >= floor[:, None]
    whole = q @ x.T if within.mean() > DENSE else None
    out = []
    for i, v in enumerate(q):
        at = np.flatnonzero(within[i])
        exact = x[at] @ v if whole is None else whole[i, at]
        out.append(at[exact >= np.partition(exact, len(at) - k)[len(at) - k] - close[i]])
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: none null, zero, or with null or non-finite components."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type = np.float32) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    books: int = BOOKS,
    words: int = WORDS,
    beam: int = BEAM,
    sample: int = SAMPLE,
    candidates: int = CANDIDATES,
    index_block: int = INDEX_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors, other than the query's own id, with the largest inner
    product, largest first, ties to the smaller id; score is exact, in double precision. `candidates` sets only where a
    query's bound starts, not what is found.

    Null, zero and non-finite vectors, null ids and vectors of another length than most take no part on either side.
    Equal vectors are indexed once, with their k + 1 smallest ids, so that repeated rows of any number are all found
    in order; a row repeated with its id counts once, and an id with several vectors has them all: as a query they share
    one list of k. Fewer rows than k give all. Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vector_col).distinct()
    top = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = top["n"]
    kinds = [np.float32 if dict(df.dtypes)[vector_col] == "array<float>" else np.float64 for df in (vectors, queries)]
    good = good.where(F.size("v") == width).withColumn("key", F.xxhash64("v"))
    # The window's limit applies before the shuffle too, so a vector's copies don't gather in one task.
    first = good.withColumn("at", F.row_number().over(Window.partitionBy("key", "v").orderBy("id"))).where(F.col("at") <= k + 1)
    index = materialize(first.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    n = index.count()
    asked = materialize(usable(queries, id_col, vector_col).where(F.size("v") == width).distinct().select(F.xxhash64("id", "v").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("query")), "queries")
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    some = index.orderBy(F.xxhash64("key", F.lit(1))).limit(sample).select("v").toArrow()
    x = _matrix(some["v"], width)
    fitted = fit_codebooks(x, books, min(words, len(x)), beam)
    shared = spark.sparkContext.broadcast(fitted)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books_ = shared.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                full = _matrix(part.column(1), width, np.float64)
                codes = books_.encode(full.astype(np.float32), beam)
                rest = np.sqrt(((full - books_.decode(codes)) ** 2).sum(1)) * (1 + 1e-6)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest), part.column(1)], ["key", "block", "code", "rest", "v"])

    # The index goes to as many places as there are blocks of queries: no more of them than their size asks for, and than
    # keep all tasks busy.
    blocks = max(1, -(-n // index_block))
    rows = max(1, -(-n_asked // query_block), min(-(-n_asked // 256), -(-partitions(spark) // blocks)))
    coded = index.select("key", "v", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(blocks)).alias("block")).mapInArrow(encode, f"key long, block long, code binary, rest double, v {dict(index.dtypes)['v']}")
    index_rows = packed(coded, "block", {"key": "long", "code": "binary", "rest": "double", "v": "array"})
    asked_in = asked.withColumn("query_block", F.pmod(F.xxhash64("q", F.lit(4)), F.lit(rows)))
    query_rows = packed(asked_in, "query_block", {"q": "long", "query": "array<float>"})
    # Each block of the index meets each block of the stated queries once.
    pairs = index_rows.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)).cast("array<long>"))).repartition(max(partitions(spark), min(rows * blocks, 4 * partitions(spark))), "query_block", "block").join(query_rows, "query_block")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books_ = shared.value
        m = len(books_.words)
        for b in batches:
            for row in range(b.num_rows):
                keys, codes, rest, x, ids, q = (np.frombuffer(b.column(i)[row].as_buffer(), t) for i, t in enumerate((np.int64, np.uint8, np.float64, kinds[0], np.int64, kinds[1])))
                codes, x, q = np.ascontiguousarray(codes.reshape(-1, m).T), *(v.reshape(-1, width).astype(np.float64) for v in (x, q))
                for at in range(0, len(ids), 32):
                    some = q[at : at + 32]
                    best = reaching(some, x, codes, rest, books_, k + 1, candidates)
                    guess = np.concatenate([np.add.accumulate(x[f] * v, 1)[:, -1] for f, v in zip(best, some)])  # in the order of the last score
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 32], list(map(len, best)))), pa.array(keys[np.concatenate(best)]), pa.array(guess)], ["q", "key", "guess"])

    found = pairs.select("keys", "codes", "rests", "vs", "qs", "querys").mapInArrow(search, "q long, key long, guess double")
    if blocks > 1:  # rank, not row_number: ties all stay, as their least ids decide
        best = Window.partitionBy("q").orderBy(F.desc("guess"))
        found = found.withColumn("at", F.rank().over(best)).where(F.col("at") <= k + 1)
    both = found.join(index, "key").join(asked, "q")
    score = F.aggregate(F.zip_with("query", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    ranked = both.select("q", "query_id", "ids", score.alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.element_at("ids", 1))
    ranked = ranked.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    each = ranked.select("query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    """nearest to each row whose vec_id is divisible by 20 among all; its docstring defines every case."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH good AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), lambda a, b: a + b) AS score
  FROM good q JOIN good c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
