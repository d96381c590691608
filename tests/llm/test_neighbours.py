"""Recall against brute force, ties, copies and unusable vectors."""

import duckdb
import numpy as np
import pyarrow as pa

from entityspark.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>, score double, key int"


def brute(rows, k=20):
    good = sorted({(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)})
    out = {}
    for q, v in good:
        if q % 20 == 0:
            s = out.setdefault(q, [])
            for i, w in good:
                if i != q:
                    total = 0.0
                    for a, b in zip(v, w):
                        total += a * b
                    s.append((-total, i))
    return {q: sorted(s)[:k] for q, s in out.items()}


def test_small(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(100)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None, *[1.0] * 7]), (None, [1.0] * 8), (20, rows[20][1]), (1080, [1.0, float("inf"), *[1.0] * 6])]
    df = spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows], SCHEMA)
    for options in ({"words": 64}, {"words": 64, "index_block": 50, "query_block": 3}):
        got = nn.nearest(df, df.where("vec_id % 20 = 0"), candidates=400, **options).collect()
        by = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            by.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert by == brute(rows)
    empty = df.where("vec_id < 0")
    assert nn.nearest(empty, empty).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert [(r["query_id"], r["rank"]) for r in nn.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1), (0, 2)]


def test_an_id_with_several_vectors(spark):
    """Such a query has one list over the pairs of all its vectors, as the SQL has it."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 3.0]), (20, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.5]), (3, [0.5, 2.0]), (3, [4.0, 4.0]), (40, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows], SCHEMA)
    for k in (2, 4, 20):
        got = {}
        for r in nn.nearest(df, df.where("vec_id % 20 = 0"), k=k, words=4).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert got == brute(rows, k)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    sql = {}
    for q, rank, i, score in sorted(con.execute("SELECT query_id, rank, vec_id, score FROM (" + nn.ORACLE + ")").fetchall()):
        sql.setdefault(q, []).append((-score, i))
    assert sql == brute(rows)


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in df.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids.tolist()])
    got = {}
    for r in nn.nearest(df, df.where("vec_id % 20 = 0"), candidates=40).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for q, found in got.items():
        s = m @ x[q]
        want = [i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:20]
        hit, total = hit + len(found.intersection(want)), total + 20
    assert total == 20 * (ids % 20 == 0).sum() and hit / total >= 0.9


def test_norms_of_codes():
    x = np.random.default_rng(1).normal(size=(500, 16)).astype(np.float32)
    books = nn.fit_codebooks(x, books=4, words=32)
    wide, narrow = (((books.decode(books.encode(x, beam)) - x) ** 2).sum() for beam in (8, 1))
    assert wide <= narrow < (x**2).sum()


def test_nothing_lost_outside_the_sample(spark):
    """20,000 isotropic vectors, of which the codebooks are fitted on 1,000: the codes are poor, the result is whole."""
    x = np.random.default_rng(8).normal(size=(20_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in nn.nearest(df, df.where("vec_id % 400 = 0"), words=64, sample=1000, index_block=7000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    full = x.astype(np.float64)
    assert len(got) == 50
    for q, found in got.items():
        s = full @ full[q]
        s[q] = -np.inf
        assert found == set(np.argsort(-s)[:20].tolist())


def test_recall_of_the_defaults(spark):
    """50,000 vectors, clustered and scattered, with the defaults: measured against brute force, none is lost."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(200, 32))
    x = np.concatenate([centres[rng.integers(0, 200, 30_000)] + 0.2 * rng.normal(size=(30_000, 32)), rng.normal(size=(20_000, 32))]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 32).cast(pa.list_(pa.float32()))}))
    got = {}
    for r in nn.nearest(df, df.where("vec_id % 500 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    full, hit = x.astype(np.float64), 0
    for q, found in got.items():
        s = full @ full[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 100 and hit / 2000 >= 0.9 and hit == 2000
