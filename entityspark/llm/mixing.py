"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / size of the source. Its whole part is
taken; the fractional parts are paired, and words move between the two of a pair at random, without bias, until one
of them is whole. Each bucket of a source leaves one fractional document at most; those residuals meet in the next
level of a tree, so that a source's words stay what they are expected to be, up to one document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, global_rank, materialize, partitions, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3.0
#: Documents in a bucket on average over the corpus, and buckets whose residuals meet in one of the next level.
BUCKET, FAN_IN = 1024, 64
#: Source tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 100_000
_M64 = (1 << 64) - 1


def sizes_of(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), F.xxhash64(F.col(text_col)).alias("tie"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> tuple[DataFrame, int]:
    """(source, source_size, target) and its number of rows.

    Sources in code point order, null last, take the weights in turn. With a level v, a source gets v * weight or
    max_repeat times its size, whichever is less; v rises until the targets sum to all words, which is what giving
    the excess of the full sources to the others again and again comes to. Each round is an aggregate of one row.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = global_rank(src, [F.col("source").asc_nulls_last()], "sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    s = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(max_repeat)))
    n, total = s.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    left, heavy = float(total), sum(weights)
    full, level = F.lit(False), 0.0
    while n:
        full = F.col("most") < F.lit(level) * F.col("weight")
        given, heavy = s.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        left = total - given
        if not heavy or left / heavy <= level:
            break
        level = left / heavy
    target = F.when(full, F.col("most")).otherwise(F.lit(left) * F.col("weight") / F.lit(heavy or 1.0))
    return s.select("source", "source_size", target.alias("target")), n


def _draw(a: int, b: int) -> float:
    """Uniform in [0, 1) from two 64-bit keys, the same on every run."""
    z = ((a ^ (b << 1 & _M64) ^ 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9) & _M64
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & _M64
    return ((z ^ z >> 31) >> 11) / (1 << 53)


def _pivot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source, bucket, key, size, copies, p) sorted by source and bucket: settles all but one of each bucket.

    Settled rows come out with p null. It holds one row besides the batch, however large the bucket.
    """
    names = ["doc_id", "tie", "source", "bucket", "key", "size", "copies", "p"]
    group, held = None, None
    schema = None
    for b in batches:
        schema = b.schema
        out = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            row = list(row)
            if (row[2], row[3]) != group:
                if held is not None:
                    out.append(held)
                group, held = (row[2], row[3]), None
            if held is None:
                held = row
                continue
            pi, si, pj, sj = held[7], held[5], row[7], row[5]
            up, down = min((1 - pi) * si, pj * sj), min(pi * si, (1 - pj) * sj)
            if _draw(held[4], row[4]) * (up + down) < down:  # words go to the held row
                ends = (pi + up / si if up < (1 - pi) * si else 1.0, pj - up / sj if up < pj * sj else 0.0)
            else:
                ends = (pi - down / si if down < pi * si else 0.0, pj + down / sj if down < (1 - pj) * sj else 1.0)
            pair, held = (held, row), None
            for r, p in zip(pair, ends):
                if p < 1e-12 or p > 1 - 1e-12 or held is not None:
                    r[6], r[7] = r[6] + int(p > 0.5), None
                    out.append(r)
                else:
                    r[7] = p
                    held = r
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, schema.field(k).type) for x, k in zip(zip(*out), names)], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], schema.field(k).type) for x, k in zip(held, names)], names)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, bucket: int = BUCKET, fan_in: int = FAN_IN
) -> DataFrame:
    """(doc_id, tie, size, source_size, target, copies) for every row of docs; tie is a hash of the text.

    A null text has size 0; a null source is a source of its own, last in order; repeated rows are rounded one by
    one; size-0 documents carry no words, and take the whole part of the expected copies. An empty table gives no
    rows; other columns are ignored. The draws hang on ids and texts alone, so that any partitioning agrees.
    """
    sizes = materialize(sizes_of(docs, id_col, source_col, text_col), "sizes")
    aims, n_sources = targets(sizes, weights, max_repeat)
    n = sizes.count()
    buckets = max(1, -(-n // bucket))
    if n_sources <= BROADCAST_SOURCES:
        aims = F.broadcast(aims)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(F.lit(0.0))
    units = (
        sizes.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("rate", rate)
        .withColumn("key", F.xxhash64("doc_id", "tie"))
        .withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(17)), F.lit(buckets)))
        .withColumn("copies", F.floor("rate").cast("long"))
        .withColumn("p", F.col("rate") - F.floor("rate"))
    )
    open_ = (F.col("p") > 1e-12) & (F.col("p") < 1 - 1e-12) & (F.col("size") > 0)
    keep = ["doc_id", "tie", "source", "bucket", "key", "size", "copies", "p"]
    kind = ", ".join(f"{k} {t}" for k, t in units.select(*keep).dtypes)
    settled = units.where(~open_).select(*keep[:-2], (F.col("copies") + (F.col("p") > 0.5).cast("long")).alias("copies"))
    parts, level, rest = [settled], 0, units.where(open_).select(*keep)
    while True:
        # Large documents first: what is left at the end then tends to be small.
        dealt = rest.repartition(partitions(docs.sparkSession), "source", "bucket").sortWithinPartitions("source", "bucket", F.desc("size"), "key", "doc_id")
        after = materialize(dealt.mapInArrow(_pivot, kind), f"rounded-{level}")
        parts.append(after.where(F.col("p").isNull()).select(*keep[:-1]))
        rest = after.where(F.col("p").isNotNull()).withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("long"))
        if buckets == 1:
            break
        buckets, level = -(-buckets // fan_in), level + 1
    chance = F.pmod(F.xxhash64("key", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    parts.append(rest.select(*keep[:-2], (F.col("copies") + (chance < F.col("p")).cast("long")).alias("copies")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "tie", "size", "source_size", "target", "copies")


def take_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with all their columns, whatever their names, each as often as the mix takes it.

    Rows repeated with one id and text share their copies, and those are copies of one of them; null ids are told apart
    by their texts; null and empty texts, of size 0, stay as often as the whole part of their source's rate; an empty
    table gives no rows; options are those of mix_sources.
    """
    mix = mix_sources(docs, id_col, source_col, text_col, **options)
    mix = mix.groupBy(F.col("doc_id").alias("mix_id"), F.col("tie").alias("mix_tie")).agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    both = boxed(docs, id_col, text_col).join(mix, F.col("id").eqNullSafe(F.col("mix_id")) & (F.col("tie") == F.col("mix_tie")))
    one, many = both.where(F.col("rows") == 1), both.where(F.col("rows") > 1).dropDuplicates(["id", "tie"])
    return one.unionByName(many).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """mix_sources of all documents, whose docstring defines every case."""
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
