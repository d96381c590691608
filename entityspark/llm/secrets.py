"""Secret scans: base credential patterns, and Shannon entropy in a sliding window over candidate strings.

Only DataFrame functions run here. A window's entropy is log2(W) - S / W with S the sum of c * log2(c) over the
counts of its characters; moving the window by one changes two counts, so S is kept up by increments.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import span_digest, table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")
# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SPANS = "array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class EntropyClass:
    """Candidates whose characters all lie in `alphabet`: windows of `window` characters with `bits` or more count."""

    alphabet: str
    window: int
    bits: float


#: Tried in this order: a candidate belongs to the first class that has all its characters and a window it fills.
CLASSES = (
    EntropyClass("0123456789abcdef", 20, 3.0),
    EntropyClass("0123456789ABCDEF", 20, 3.0),
    EntropyClass("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 3.9),
    EntropyClass("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.8),
)
#: Candidates: whole runs of 20 or more with a digit and a letter. The lookbehind keeps long runs linear.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
#: A document without a match of this holds no span of any kind.
GATE = rf"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{{16}}|{CANDIDATE}"
#: A candidate that matches one of these as a whole isn't reported by its entropy: UUIDs, paths.
ALLOW = (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^/?([a-z]+/){2,}[a-z0-9_-]{0,19}$")
#: Placeholders and alphabets are part of no candidate, in either case; what stands beside them still is.
ALLOW_WORDS = ("example", "placeholder", "changeme", "xxxx", "0123456789", "abcdefghijkl")


def _found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s: string, start: long>>, in code points."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    both = F.arrays_zip(pieces.alias("p"), hits.alias("h"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:string,start:long>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["at"] + F.length(x["p"])
        more = F.when(x["h"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(x["h"].alias("s"), here.alias("start")))))
        return F.struct((here + F.coalesce(F.length(x["h"]), F.lit(0))).alias("at"), more.alias("out"))

    return F.aggregate(both, start, step, lambda acc: acc["out"])


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["s"])).alias("end")))


def _dense(found: Column, cls: EntropyClass) -> Column:
    """Stretches of one candidate covered by windows with enough entropy, as spans."""
    w, n = cls.window, len(cls.alphabet)
    c_log = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(w + 2)])
    codes = F.transform(F.split(found["s"], ""), lambda ch: F.position(ch, F.lit(cls.alphabet)) - 1)
    zero = F.struct(
        F.array_repeat(F.lit(0), n).alias("count"),
        F.lit(0.0).alias("s"),
        F.lit(-1).cast("long").alias("a"),
        F.lit(-1).cast("long").alias("b"),
        F.array().cast(SPANS).alias("out"),
    )
    span = lambda a, b: F.array(F.struct(F.lit("entropy").alias("kind"), (found["start"] + a).alias("start"), (found["start"] + b).alias("end")))

    def step(acc: Column, x: Column) -> Column:
        new, old, i = x["new"], x["old"], x["i"]
        added = F.get(acc["count"], new)
        s1 = acc["s"] + F.get(c_log, added + 1) - F.get(c_log, added)
        left = F.get(acc["count"], old) + F.when(old == new, 1).otherwise(0)
        s2 = F.when(old < 0, s1).otherwise(s1 + F.get(c_log, left - 1) - F.get(c_log, left))
        count = F.transform(acc["count"], lambda c, j: c + F.when(j == new, 1).otherwise(0) - F.when(j == old, 1).otherwise(0))
        end, begin = (i + 1).cast("long"), (i + 1 - w).cast("long")
        hit = (begin >= 0) & (F.lit(math.log2(w)) - s2 / F.lit(float(w)) >= F.lit(cls.bits))
        apart = hit & (begin > acc["b"])
        return F.struct(
            count.alias("count"),
            s2.alias("s"),
            F.when(apart, begin).otherwise(acc["a"]).alias("a"),
            F.when(hit, end).otherwise(acc["b"]).alias("b"),
            F.when(apart & (acc["b"] >= 0), F.concat(acc["out"], span(acc["a"], acc["b"]))).otherwise(acc["out"]).alias("out"),
        )

    # The outer transform binds the codes once; naming the expression in the inner lambda would redo it for each character.
    moves = F.flatten(F.transform(F.array(codes), lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("new"), F.coalesce(F.get(cs, i - w), F.lit(-1)).alias("old"), i.alias("i")))))
    return F.aggregate(moves, zero, step, lambda acc: F.when(acc["b"] >= 0, F.concat(acc["out"], span(acc["a"], acc["b"]))).otherwise(acc["out"]))


def _entropy(text: Column, classes: tuple[EntropyClass, ...], allow: tuple[str, ...], words: tuple[str, ...]) -> Column:
    for w in words:
        text = F.regexp_replace(text, f"(?i){w}", " " * len(w))
    found = F.filter(_found(text, CANDIDATE), lambda m: ~F.greatest(F.lit(False), F.lit(False), *[m["s"].rlike(p) for p in allow]))

    def one(m: Column) -> Column:
        out = F.array().cast(SPANS)
        for cls in reversed(classes):
            inside = "^[" + "".join("\\" + c if c in "+/_-" else c for c in cls.alphabet) + "]*$"
            out = F.when((F.length(m["s"]) >= cls.window) & m["s"].rlike(inside), _dense(m, cls)).otherwise(out)
        return out

    return F.flatten(F.transform(found, one))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, words: tuple[str, ...] = ALLOW_WORDS) -> DataFrame:
    """(id_col, spans): spans array<struct<kind, start, end>> in code points, end exclusive, by start and then kind.

    Kinds assign, access and hex are the base patterns; kind entropy adds stretches of high entropy that no base
    span contains; candidates that match `allow`, and `words` inside them, are left out. A null text counts as empty and has no spans; an empty table gives no rows; repeated rows each
    give theirs; texts of any length are scanned whole; other columns of docs are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(_found(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["s"], ASSIGN, 2)) >= 12)
    access = F.filter(_found(text, ACCESS), lambda m: F.length(m["s"]) >= 18)
    # A run of 16 or more is a whole run: shorter ones can't match, so this equals filtering the matches of HEX.
    runs = _found(text, HEX.replace("+", "{16,}"))
    base = F.concat(_spans(assign, "assign"), _spans(access, "access"), _spans(runs, "hex"))
    gated = lambda x: F.when(text.rlike(GATE), x).otherwise(F.array().cast(SPANS))
    out = docs.select(F.col(id_col).alias("id"), gated(base).alias("base"), gated(_entropy(text, classes, allow, words)).alias("more"))
    new = F.filter("more", lambda e: ~F.exists("base", lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"])))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(F.concat("base", new), lambda s: F.struct(s["start"], F.array_position(kinds, s["kind"]).alias("r"), s["kind"], s["end"]))
    return out.select(F.col("id").alias(id_col), F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("spans"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """scan_secrets of all documents, whose docstring defines every case."""
    return span_digest(scan_secrets(table(spark, sf_dir, "documents")), "doc_id", "spans", BASE)
