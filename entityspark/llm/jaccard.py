"""N-gram Jaccard join: MinHash banding, with pairs verified on full shingle sets.

Documents with equal shingle sets form a class, and only classes are compared. Bands of a class's signature go to
buckets; a bucket's classes are compared there in blocks of bounded size, first by signature, and what comes out is a
spanning forest of likely pairs, not all pairs. Each tree's classes then meet once with their full sets, again in
blocks, where every pair is verified; a class gets its links as a sum, and a forest of the true links gives the
groups. So rows stay in proportion to classes even where a group has thousands of members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, components, hot_join, materialize, partitions, table
from .shingles import N, MinHash, choose_bands, shingle_set

THRESHOLD = 0.8
RECALL = 0.9995
#: Signatures that agree on less than this part of the hash functions aren't compared further: with 100 functions a
#: pair of similarity 0.8 agrees on less than 0.6 of them with a chance of 1e-6.
LIKELY = 0.6
#: Classes in a block, and so at most twice as many in a task's comparison.
BLOCK = 512
#: Bits of the filter that picks the texts to read again: 4 MB at most.
FILTER_BITS = 25
_SHINGLES = 250_000


def _batches(texts: Iterable[str | None], n: int) -> Iterator[list[np.ndarray]]:
    """Shingle sets in lists of about _SHINGLES shingles."""
    out, size = [], 0
    for t in texts:
        out.append(shingle_set(t, n))
        size += len(out[-1])
        if size >= _SHINGLES:
            yield out
            out, size = [], 0
    if out:
        yield out


def _digest(s: np.ndarray) -> int:
    """A signed 64-bit key of a shingle set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64))


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N) -> DataFrame:
    """(doc_id, tie, set_key, n_shingles, signature) from (doc_id, text, tie); key and signature null without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(bands * rows)
        for b in batches:
            at = 0
            for sets in _batches((t.as_py() for t in b.column(1)), n):
                full = [s for s in sets if len(s)]
                sig = iter(hasher.signatures(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(sets)),
                        b.column(2).slice(at, len(sets)),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array(list(map(len, sets)), pa.int32()),
                        pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "tie", "set_key", "n_shingles", "signature"],
                )
                at += len(sets)

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, tie long, set_key long, n_shingles int, signature binary")


class Forest:
    """Union-find over the rows of one comparison."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def edges(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """The pairs that join two trees."""
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                yield i, j


def _blocked(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """rows with columns i, j: the pair of blocks of its key in which a row is compared, and `side`, its own block.

    A key of up to `block` rows has the one pair (0, 0). A larger one has k blocks, and its rows go to k pairs each.
    """
    count = materialize(rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1"), "block-counts")
    many = F.ceil(F.col("__n") / F.lit(block)).cast("int")
    x = hot_join(rows, count, key, "__n").withColumn("side", F.pmod(F.xxhash64(member, F.lit(5)), many).cast("int"))
    x = x.withColumn("__o", F.explode(F.sequence(F.lit(0), many - 1)))
    return x.withColumn("i", F.least("side", "__o")).withColumn("j", F.greatest("side", "__o")).drop("__n", "__o")


def _grouped(df: DataFrame, keys: list[str], work: Callable, schema: str, columns: list[str]) -> DataFrame:
    """work(table of the rows of one key) for each key; one key's rows are held at a time, which blocks bound."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from work(pa.Table.from_batches(held))

        for b in batches:
            if not b.num_rows:
                continue
            k = [b.column(keys.index(x)).to_numpy(zero_copy_only=False) for x in keys]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
            bounds = [0, *cuts.tolist(), b.num_rows]
            for s, e in zip(bounds, bounds[1:]):
                key = tuple(x[s] for x in k)
                if key != last:
                    yield from done()
                    held, last = [], key
                held.append(b.slice(s, e - s))
        yield from done()

    dealt = df.select(*columns).repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, "member")
    return dealt.mapInArrow(run, schema)


def _pairs_of(side: np.ndarray, i: int, j: int, m: np.ndarray) -> np.ndarray:
    """The cells of the square m that this pair of blocks owns: i < j as rows of the one and columns of the other."""
    if i == j:
        return np.triu(m, 1)
    return m & ((side == i)[:, None] & (side == j)[None, :])


def _likely(size: int, likely: float) -> Callable:
    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, member = t["side"].to_numpy(), t["member"].to_numpy()
        sig = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint32).reshape(len(member), size)
        same = np.zeros((len(member), len(member)), np.int16)
        for k in range(size):
            same += sig[:, k][:, None] == sig[:, k][None, :]
        a, b = np.nonzero(_pairs_of(side, t["i"][0].as_py(), t["j"][0].as_py(), same >= likely * size))
        if edges := list(Forest(len(member)).edges(a, b)):
            e = member[np.array(edges)]
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return work


def _verified(threshold: float) -> Callable:
    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, member, weight = t["side"].to_numpy(), t["member"].to_numpy(), t["docs"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
        sizes = np.array(list(map(len, sets)), np.int64)
        both = _common(sets)
        union = sizes[:, None] + sizes[None, :] - both
        link = _pairs_of(side, t["i"][0].as_py(), t["j"][0].as_py(), both >= threshold * union - 1e-9)
        a, b = np.nonzero(link)
        if not len(a):
            return
        links = link @ weight + link.T @ weight
        edges = member[np.array(list(Forest(len(member)).edges(a, b)))]
        some = np.flatnonzero(links)
        out = [(member[some], None, links[some]), (edges[:, 0], edges[:, 1], None)]
        for x, y, n in out:
            null = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x), null if y is None else pa.array(y), null if n is None else pa.array(n)], ["a", "b", "links"])

    return work


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the postings of shingles that two sets or more have."""
    n = len(sets)
    values, ids = np.concatenate(sets), np.repeat(np.arange(n), list(map(len, sets)))
    order = np.argsort(values, kind="stable")
    values, ids = values[order], ids[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    code, count = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(values)))
    keep = count[code] > 1
    column = np.cumsum(count > 1) - 1
    code, ids = column[code[keep]], ids[keep]
    total = np.zeros((n, n), np.float32)
    width = 1 << 12
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        inside = (code >= at) & (code < at + width)
        dense = np.zeros((n, width), np.float32)
        dense[ids[inside], code[inside] - at] = 1
        total += dense @ dense.T
    return total.astype(np.int64)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, likely: float = LIKELY, block: int = BLOCK
) -> DataFrame:
    """(doc_id, tie, class_id, copy_id, n_copies, n_links) for each row of docs.

    copy_id: the least doc_id with the same set of shingles (runs of n words, in lower case); class_id: the least
    doc_id of the group that links of Jaccard similarity `threshold` or more connect; n_links: other rows so linked to
    this one, copies included; n_copies: rows of its copy class; tie: a hash of the text, to tell rows of one id apart.

    Documents without words, null texts included, link to nothing: their class is their own id and n_links is 0.
    Texts shorter than n words have one shingle. Repeated rows are copies of each other. Null ids take part; as a
    representative a null id gives way to any other. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    sig = materialize(signatures(base.select("doc_id", "text", "tie"), bands, rows, n), "signatures")
    classes = materialize(
        sig.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tie")).alias("rep"), F.count("*").alias("docs"), F.min("signature").alias("signature")), "classes"
    )

    # Buckets that hold two classes or more.
    cut = lambda k: F.substring("signature", 4 * rows * k + 1, 4 * rows)
    banded = classes.select(F.col("set_key").alias("member"), F.posexplode(F.array(*[cut(k) for k in range(bands)])).alias("band", "part")).select(F.xxhash64("band", "part").alias("bucket"), "member")
    dealt = materialize(_blocked(banded, "bucket", "member", block), "buckets")
    withsig = dealt.join(classes.select(F.col("set_key").alias("member"), "signature"), "member")
    likely_edges = _grouped(withsig, ["bucket", "i", "j"], _likely(bands * rows, likely), "a long, b long", ["bucket", "i", "j", "side", "member", "signature"])
    trees = materialize(components(likely_edges, "likely"), "trees")

    # The full sets of the classes in trees: their representatives' texts are read again, picked by a filter of fixed size.
    chosen = trees.join(classes.select(F.col("set_key").alias("node"), "docs", "rep"), "node")
    place = lambda doc_id, tie: F.pmod(F.xxhash64(doc_id, tie, F.lit(3)), F.lit(1 << FILTER_BITS)) + 1  # noqa: E731  bitmaps count from 1
    bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for r in chosen.select(place(F.col("rep.doc_id"), F.col("rep.tie")).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = shared.value
        for b in batches:
            at = b.column(1).to_numpy() - 1
            found = np.flatnonzero(has[at >> 3] >> (at & 7) & 1)
            for group in (found[k : k + 256] for k in range(0, len(found), 256)):
                s = [x for x in (shingle_set(b.column(0)[k].as_py(), n) for k in group.tolist()) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())], ["set_key", "shingles"])

    full = base.select("text", place("doc_id", "tie").alias("at")).mapInArrow(sets, "set_key long, shingles binary")
    full = materialize(full.join(chosen.select(F.col("node").alias("set_key"), "comp", "docs"), "set_key").dropDuplicates(["set_key"]).withColumnRenamed("set_key", "member"), "sets")
    where = _blocked(full.select("comp", "member"), "comp", "member", block)
    verify = where.join(full.select("member", "docs", "shingles"), "member")
    links = materialize(_grouped(verify, ["comp", "i", "j"], _verified(threshold), "a long, b long, links long", ["comp", "i", "j", "side", "member", "docs", "shingles"]), "links")

    near = links.where("b is null").groupBy(F.col("a").alias("set_key")).agg(F.sum("links").alias("near"))
    groups = components(links.where("b is not null").select("a", "b"), "groups")
    named = groups.join(classes.select(F.col("set_key").alias("node"), "rep"), "node")
    least = named.groupBy("comp").agg(F.min("rep").alias("first"))
    of = named.select("node", "comp").join(least, "comp").select(F.col("node").alias("set_key"), "first")
    info = classes.join(near, "set_key", "left").join(of, "set_key", "left").select("set_key", "rep", "docs", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("first", "rep").alias("first"))
    info = materialize(info, "infos")
    rows_ = sig.select("doc_id", "tie", "set_key")
    in_class = hot_join(rows_.where("set_key is not null"), info, "set_key", "docs").select(
        "doc_id",
        "tie",
        F.col("first.doc_id").alias("class_id"),
        F.col("rep.doc_id").alias("copy_id"),
        F.col("docs").alias("n_copies"),
        (F.col("docs") - 1 + F.col("near")).cast("long").alias("n_links"),
        ((F.col("first.tie") == F.col("tie")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))).alias("is_first"),
    )
    own = F.col("doc_id")
    alone = rows_.where("set_key is null").select("doc_id", "tie", own.alias("class_id"), own.alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("is_first"))
    return in_class.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns whatever their names, without all but the first document of each near-duplicate
    group.

    Documents without words, null texts included, all stay; of rows repeated with the same id and text one stays; null
    ids give way to others; an empty table gives no rows; options are those of near_duplicates.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    first = found.where("is_first").groupBy(F.col("doc_id").alias("first_id"), F.col("tie").alias("first_tie")).agg(F.count("*").alias("rows"), F.max("n_links").alias("links"))
    both = boxed(docs, id_col, text_col).join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
    own = (F.col("rows") == 1) | (F.col("links") == 0)
    return both.where(own).unionByName(both.where(~own).dropDuplicates(["id", "tie"])).select("row.*")


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents, whose docstring defines every case."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_copies", "n_links")
