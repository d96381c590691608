"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask keeps some positions of a window of words and ignores the others, so that a window still hashes alike after a
word at an ignored position was replaced. Seeds of training texts join the seeds of benchmark items; around each hit,
the two texts are laid over each other and the best stretch of agreement, with a penalty for each replaced word,
decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, table

#: 1 keeps a word, 0 ignores it. The first finds texts with every fourth word replaced, the second every third.
MASKS = ("1110111", "11011011")
PENALTY = 1.5
#: Words that must agree: this many, or for short items this part of them, five at least.
WORDS, PART, LEAST = 12, 0.6, 5
#: Items of fewer words say too little inside a text: they match texts that have their words alone.
SHORT_ITEM = 3
#: Items of up to so many words have seeds of their own: all their words, and all but one where one may differ.
OWN_SEEDS = 8
#: Benchmark seeds of up to so many rows (24 bytes each) and item words are broadcast; more are joined by a shuffle.
BROADCAST_SEEDS, BROADCAST_WORDS = 1_000_000, 2_000_000


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(h: Column, masks: list[str]) -> Column:
    """array<struct<pos, seed>> of all windows of the word hashes h under each mask; h should be a plain column."""

    def under(mask: str) -> Column:
        kept = [i for i, c in enumerate(mask) if c == "1"]
        at = F.sequence(F.lit(0), F.size(h) - len(mask))
        one = lambda p: F.struct(p.alias("pos"), F.xxhash64(F.lit(mask), *[F.get(h, p + i) for i in kept]).alias("seed"))
        return F.when(F.size(h) >= len(mask), F.transform(at, one)).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>"))

    return F.concat(*[under(m) for m in masks])


def own_masks(n: int) -> list[str]:
    """The masks of items of n words: all words, and from the length on at which one may differ, all but each one."""
    return ["1" * n, *("1" * i + "0" + "1" * (n - 1 - i) for i in range(n) if n > LEAST)]


def _overlap(doc: Column, item: Column, shift: Column) -> Column:
    """The best stretch with item word k over doc word k + shift: struct<score, matched, first>, first in the item."""
    low = F.greatest(F.lit(0), -shift)
    n = F.least(F.size(item), F.size(doc) - shift) - low
    same = F.zip_with(F.slice(doc, low + shift + 1, n), F.slice(item, low + 1, n), lambda a, b: a == b)
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("cur", "best")], *[F.lit(0).alias(x) for x in ("m", "from", "at", "matched", "first")])

    def step(acc: Column, eq: Column) -> Column:
        fresh = acc["cur"] <= 0
        cur = F.when(fresh, F.lit(0.0)).otherwise(acc["cur"]) + F.when(eq, F.lit(1.0)).otherwise(F.lit(-PENALTY))
        m = F.when(fresh, F.lit(0)).otherwise(acc["m"]) + F.when(eq, F.lit(1)).otherwise(F.lit(0))
        start = F.when(fresh, acc["at"]).otherwise(acc["from"])
        better = cur > acc["best"]
        pick = lambda new, old: F.when(better, new).otherwise(acc[old])
        return F.struct(cur.alias("cur"), pick(cur, "best").alias("best"), m.alias("m"), start.alias("from"), (acc["at"] + 1).alias("at"), pick(m, "matched").alias("matched"), pick(start, "first").alias("first"))

    return F.aggregate(same, zero, step, lambda acc: F.struct(acc["best"].alias("score"), acc["matched"].alias("matched"), (acc["first"] + low).alias("first")))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS,
    words: int = WORDS,
    part: float = PART,
    short_item: int = SHORT_ITEM,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """(doc_id, tie, item_id, matched, item_words, doc_start, score): pairs of a document and a benchmark item it holds.

    matched words of the item agree in the best stretch, which starts at word doc_start of the text; a pair counts
    from min(words, part of the item) agreeing words on, five at least. Words are runs of letters and digits, in lower
    case. Items of up to OWN_SEEDS words are found whole, or with any one word replaced if the best stretch then has enough; those
    under short_item words only as all the words of a text. Items without words match nothing. A null text counts
    as empty and has no pairs; repeated rows give one pair; null ids take part; empty tables give no rows; whole
    texts of any length are searched; other columns are ignored. tie is a hash of the text.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text_col)).alias("t")).where(F.size("t") >= 1)
    items = materialize(items.select(F.xxhash64("item_id", "t").alias("item"), "item_id", "t").dropDuplicates(["item"]), "items")
    # A few lengths at most; a length that no item has costs nothing.
    short = sorted(r[0] for r in items.where(F.size("t") <= max(OWN_SEEDS, min(map(len, masks)) - 1)).select(F.size("t")).distinct().collect())
    whole = [n for n in short if n < short_item]
    inside = [m for n in short if n >= short_item for m in own_masks(n)]
    own = [F.when(F.size("t") == n, seeds(F.col("t"), [*(own_masks(n) if n >= short_item else ["1" * n]), *masks])) for n in short]
    marked = items.select("item", F.explode(F.coalesce(*own, seeds(F.col("t"), list(masks)))).alias("s")).select(F.col("s.seed").alias("seed"), "item", F.col("s.pos").alias("item_pos"))
    marked = materialize(marked, "item-seeds")
    n_words = items.agg(F.coalesce(F.sum(F.size("t")), F.lit(0))).first()[0]
    need = F.least(F.lit(words), F.greatest(F.ceil(F.size("t") * F.lit(part)).cast("int"), F.least(F.size("t"), F.lit(LEAST))))

    hashed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), word_hashes(F.col(text_col)).alias("h"))
    found_in = seeds(F.col("h"), [*masks, *inside])
    if whole:
        found_in = F.concat(found_in, *[F.when(F.size("h") == n, seeds(F.col("h"), ["1" * n])).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>")) for n in whole])
    placed = hashed.select("doc_id", "tie", "h", F.explode(found_in).alias("s"))
    if marked.count() <= broadcast_seeds and n_words <= BROADCAST_WORDS:
        # One pass over the texts: a text's words are still at hand where a seed hits.
        hit = placed.join(F.broadcast(marked), F.col("s.seed") == F.col("seed")).select("doc_id", "tie", "h", "item", (F.col("s.pos") - F.col("item_pos")).alias("shift"))
        laid = hit.join(F.broadcast(items), "item")
    else:
        hit = placed.select("doc_id", "tie", F.col("s.seed").alias("seed"), F.col("s.pos").alias("pos")).join(marked, "seed")
        hit = hit.select("doc_id", "tie", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
        again = hashed.withColumnsRenamed({"doc_id": "__id", "tie": "__tie"}).dropDuplicates(["__id", "__tie"])
        laid = hit.join(items, "item").join(again, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")))
    found = laid.select("doc_id", "tie", "item_id", F.size("t").alias("item_words"), need.alias("need"), "shift", _overlap(F.col("h"), F.col("t"), F.col("shift")).alias("o"))
    best = found.where(F.col("o.matched") >= F.col("need")).groupBy("doc_id", "tie", "item_id").agg(F.max(F.struct("o.score", "o.matched", (F.col("o.first") + F.col("shift")).alias("doc_start"), "item_words")).alias("b"))
    return best.select("doc_id", "tie", "item_id", F.col("b.matched").alias("matched"), F.col("b.item_words").alias("item_words"), F.col("b.doc_start").alias("doc_start"), F.col("b.score").alias("score"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns whatever their names, that hold no benchmark item.

    Null and empty texts stay; rows repeated with one id and text go or stay together; null ids are told apart by their
    texts; empty tables of documents give no rows, and of items all rows; options are those of find_leaks.
    """
    bad = materialize(find_leaks(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("bad_id"), F.col("tie").alias("bad_tie")).distinct(), "leaks")
    return boxed(docs, id_col, text_col).join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("tie") == F.col("bad_tie")), "left_anti").select("row.*")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """find_leaks of all documents and benchmark items, whose docstring defines every case."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tie")
