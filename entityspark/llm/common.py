"""Helpers that the corpus operators share: tables, scratch tables, span digests, ranks, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
_scratch: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a local one only for a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpus-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    root = f"{root.rstrip('/')}/corpus-{spark.sparkContext.applicationId}"
    if root not in _scratch:
        _scratch[root] = spark
        atexit.register(_remove, root)
    return root


def _remove(root: str) -> None:
    """Best effort at exit: the session may be gone by then."""
    sc = _scratch.pop(root)._sc
    if sc is not None and sc._jsc is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Cut the lineage of df by a Parquet table in the shared folder; a lost executor costs no recomputation.

    file_rows: the most rows of a file, where rows are so wide that a reader's batch of thousands is too many.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, tie): each row of docs as one struct, which keeps its columns apart from any helper's, its id and a hash
    of its text; `row.*` gives the columns back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"))


def hot_join(rows: DataFrame, facts: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """rows joined with the one row of facts of their key, however unevenly the keys are spread.

    facts says in `count` how many of rows have the key. Keys with more than one in `share` of all rows are `share` at
    most, whatever the table's size, so their facts are broadcast; the others are joined by a shuffle.
    """
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = facts.where(F.col(count) * share > total)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(count) * share <= total), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def span_digest(df: DataFrame, id_col: str, spans: str, base: tuple[str, ...]) -> DataFrame:
    """Counts and digests of a column of spans array<struct<kind, start, end>> that is sorted by start, then kind."""
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.filter(spans, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return df.select(
        F.col(id_col).alias("doc_id"),
        *counts,
        F.sha2(text(F.filter(spans, lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"),
        text(F.col(spans)).alias("spans"),
    )


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its global rank (from 0) as `rank`, without a single-task sort: ranges, a rank in each, and range offsets.

    The driver gets one row for each range, not for each row.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kept = materialize(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")), name)
    sizes = sorted((r["__part"], r["n"]) for r in kept.groupBy("__part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "__part int, __start long")
    return kept.join(F.broadcast(starts), "__part").withColumn("rank", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def packed(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """One row for each key, whose columns are the bytes of its rows' fixed-width values; blocks bound a key's rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        done: list[tuple] = []

        def close(k: int) -> None:
            t = pa.Table.from_batches(held.pop(k))
            done.append((k, *(_bytes(t[c]) for c in columns)))

        for b in batches:
            keys = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    for old in [k for k in held if k != int(keys[s])]:
                        close(old)
                    held.setdefault(int(keys[s]), []).append(b.slice(s, e - s))
            while done:
                yield _rows([done.pop()])
        for k in list(held):
            close(k)
        while done:
            yield _rows([done.pop()])

    def _bytes(c: pa.ChunkedArray) -> bytes:
        if pa.types.is_binary(c.type):
            return b"".join(c.to_pylist())
        if pa.types.is_list(c.type):
            return c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32 if pa.types.is_float32(c.type.value_type) else np.float64).tobytes()
        return c.to_numpy().tobytes()

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i + 1] for r in rows], pa.binary()) for i in range(len(columns)))], [key, *(f"{c}s" for c in columns)])

    sorted_ = df.select(F.col(key).cast("long").alias(key), *columns).repartition(partitions(df.sparkSession), key).sortWithinPartitions(key, next(iter(columns)))
    return sorted_.mapInArrow(run, f"{key} long, " + ", ".join(f"{c}s binary" for c in columns))


#: Edges up to which a hub with all of them is no burden for a task.
FEW_EDGES = 500_000


def components(edges: DataFrame, name: str, rounds: int = 40, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of edges (a, b) as (node, comp), comp being the least node.

    Alternating large-star and small-star steps; each round is a written table, and the driver sees one count a round.
    Of more than `few` edges, those of hubs are joined by broadcast of the hubs, which are few: see hot_join.
    """
    spark = edges.sparkSession
    width = max(8, min(64, partitions(spark)))
    e = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")

    def star(e: DataFrame, large: bool, many: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        if many:
            low = materialize(low, f"{name}-stars")
        joined = hot_join(both, low, "u", "n") if many else both.join(low, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    last = mark(e)
    for k in range(rounds):
        many = last[0] > few
        e = star(star(e, True, many), False, many)
        e = materialize(e if many else e.coalesce(width), f"{name}-{k + 1}")
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v"), F.col("v")).distinct())
