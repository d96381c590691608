"""Co-training: what the views exchange, odd rows, and held-out accuracy on real rows."""

import math
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from entityspark.llm import quality as q


def test_exchange_helps():
    """The page view knows nothing at first; the text view's pseudo-labels teach it."""
    rng = np.random.default_rng(4)
    good, bad = ["fine clear prose reads well here"] * 1, ["$$$ ### %%% buy now buy now"] * 1

    def doc(y, source):
        w = (good if y else bad)[0].split()
        return (" ".join(rng.permutation(w)), "en", source, None)

    labelled = [doc(i % 2, "x") for i in range(40)]
    y = np.arange(40) % 2
    pool = [doc(i % 2, "clean" if i % 2 else "dirty") for i in range(400)]
    alone, taught = q.co_train(labelled, y, []), q.co_train(labelled, y, pool)
    page = lambda m, s: float(m.page.raw([q.PageView().row("en", s, 10)])[0])
    assert page(taught, "clean") - page(taught, "dirty") > page(alone, "clean") - page(alone, "dirty") + 0.5


def test_cases(spark):
    docs = [(i, "good words in a row here" if i % 2 else "### $$$ %%%", "en", "s", 5, "x") for i in range(1, 60)]
    docs += [(100, None, None, None, None, "x"), (101, "", "en", "s", -1, "x"), (102, "w " * 50_000, "en", "s", 5, "x"), (1, docs[0][1], "en", "s", 5, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 50)], "doc_id long, quality int")
    model = q.fit_quality(df, labels)
    rows = q.score_quality(df, model).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert all((by[i] > 0.5) == (i % 2 == 1) for i in range(1, 60))
    assert q.score_quality(df.limit(0), model).count() == 0
    assert q.score_quality(df, q.fit_quality(df, labels.limit(0))).count() == len(docs)


def plain_score(model, text, lang, source, n_chars):
    """The score by loops over words, from the fitted weights."""
    text = text or ""
    slot = lambda x, bits: xxhash.xxh32_intdigest(x) % 2**bits
    counts = {}
    for word in text.split():
        shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", word)))
        for at in (slot("w" + word.lower(), q.BITS), slot("s" + re.sub(r"(.)\1+", r"\1", shape), q.BITS)):
            counts[at] = counts.get(at, 0) + 1
    length = math.sqrt(sum(math.log(1 + c) ** 2 for c in counts.values())) or 1.0
    z = sum(model.text.w[at] * math.log(1 + c) / length for at, c in counts.items())
    words, lines, n = text.split(), text.split("\n"), len(text)
    each = {w: words.count(w) for w in set(words)}
    letters = sum(c.isalpha() for c in text)
    layout = [math.log(1 + len(words)) / 10, math.log(1 + len(lines)) / 10, len(set(lines)) / len(lines)]
    layout += [len(each) / len(words), max(each.values()) / len(words)] if words else [0.0, 0.0]
    layout += [letters / n if n else 0.0, sum("A" <= c <= "Z" for c in text) / letters if letters else 0.0]
    layout += [sum(not (c.isalnum() or c == "_" or c.isspace()) for c in text) / n, sum("0" <= c <= "9" for c in text) / n] if n else [0.0, 0.0]
    layout += [min(2, n / len(words) / 8), min(1, text.count("|") / len(words) * 2)] if words else [0.0, 0.0]
    layout.append(min(1, max(map(len, lines)) / 1000))
    z += sum(model.text.w[2**q.BITS + i] * x for i, x in enumerate(layout))
    known = n_chars is not None and n_chars >= 0
    facts = [f"l{lang}", f"s{source}", f"n{len(bin(n_chars)) - 2 if n_chars else 0}" if known else "nNone"]
    names = [*facts, f"{facts[0]} {facts[1]}", f"{facts[0]} {facts[2]}", f"{facts[1]} {facts[2]}"]
    page = model.page.w[0] + model.page.w[1] * (math.log(1 + n_chars) / 10 if known else 0.0) + 0.3 * sum(model.page.w[2 + slot(x, q.PAGE_BITS)] for x in names)
    logits = [model.text.scale * z + model.text.offset, model.page.scale * page + model.page.offset]
    total = model.joint[0] + model.joint[1] * logits[0] + model.joint[2] * logits[1]
    return [1 / (1 + math.exp(-x)) for x in (total, *logits)]


def test_scores_by_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(400)
    extra = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "İ ß 中 | x9 AAA-bbb", "en", None, -4)]
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    model = q.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r for r in q.score_quality(docs, model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = plain_score(model, *r[1:])
        g = got[r["doc_id"]]
        assert np.allclose([g["score"], g["text_score"], g["page_score"]], want, atol=1e-5), r["doc_id"]


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = q.op10_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "predicted").toPandas()
    assert (rows.quality == rows.predicted).mean() > 0.95
    assert rows[rows.quality == 1].predicted.mean() > 0.97


def test_every_document_teaches(spark):
    """Sources that the bounded sample of the unlabelled documents never holds are learnt all the same."""
    sampled = {r["id"] for r in spark.range(900).where("id < 60 or id >= 100").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(20).collect()}

    def doc(i):
        source = "x" if i < 60 or i in sampled else "clean" if i % 2 else "dirty"
        return (i, "fine clear prose reads well here" if i % 2 else "$$$ ### %%% buy now buy now", "en", source, 30)

    df = spark.createDataFrame([doc(i) for i in [*range(60), *range(100, 900)]], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = q.fit_quality(df, labels, n_unlabelled=20)
    weight = lambda s: float(model.page.raw([q.PageView().row("en", s, 10)])[0])
    assert weight("clean") - weight("dirty") > 0.05
