"""Toxicity by a linear-chain conditional random field over words.

Words get labels from labelled documents: in a toxic document, a word is toxic if it, or the beginning or end of it,
stands in far more toxic documents than clean ones; clean documents have clean words only. The field learns these
labels from hashed features of the word and the transitions between labels. Forward-backward gives each word's chance
of being toxic; a logistic function of their sum, maximum and density scores the document, and likely words give the
offending offsets.

With two labels the recursions run on odds: the forward odds follow f' = r * (f * t11 + t01) / (f * t10 + t00), so one
number for each word is kept, and the words of many documents advance together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import WORD, table

#: The field is fitted on at most so many labelled documents of each label, the first by a hash of their id.
SAMPLE = 2000
BITS = 18
SEGMENT = 64
#: Words of a chain that are stepped through one by one.
PART = 2048
#: A word counts as toxic in training if some part of it is so many times likelier in toxic documents, and so surely
#: that chance would give less than one such part among all.
RATIO = 10.0
#: Parameters of fit: chances below the first count as 0 in a document's sum and mean, and with fewer documents of a label
#: in a part of the sample than the second, the sample isn't parted.
FLOOR, FEW = 0.1, 40
_TOKENS, _WORDS = 400_000, 200_000


def features(word: str) -> list[int]:
    """Hashes of the word, its beginnings of 3 to 6 letters and its ends of 3 and 4, always 7 of them."""
    parts = ("=" + word, "^" + word[:3], "^" + word[:4], "^" + word[:5], "^" + word[:6], word[-3:] + "$", word[-4:] + "$")
    return [xxhash.xxh32_intdigest(p) & ((1 << BITS) - 1) for p in parts]


def words_of(text: str | None) -> list[str]:
    """Words as the pattern finds them in the text as it is, so that words and offsets agree, each in lower case."""
    return [w.lower() for w in WORD.findall(text or "")]


@dataclass
class Field:
    weights: np.ndarray  # of the features, label 1 against 0
    moves: np.ndarray  # 2 x 2, exp of the transition weights, from row to column
    doc: np.ndarray  # of the document's bias, log1p(sum), maximum, density
    floor: float = FLOOR

    def odds(self, word: str) -> float:
        return float(np.exp(np.clip(self.weights[features(word)].sum(), -30, 30)))


def marginals(r: np.ndarray, lengths: np.ndarray, moves: np.ndarray, full: bool = False, part: int = PART):
    """Each word's chance of label 1; r: the words' own odds, document after document. full: with the forward and
    backward odds.

    Chains advance together, longest first, so that a step touches those that are still running. An empty document has
    no entries. A document of more than `part` words runs as chains of that many: the recursion over a part is a
    fraction of two linear forms of what enters it, so the parts are composed side by side, what enters each follows
    from those before it, and the steps are in proportion to `part`, not to the longest document.
    """
    (t00, t01), (t10, t11) = moves
    ahead, back = np.array([[t11, t01], [t10, t00]]), np.array([[t11, t10], [t01, t00]])
    begins = np.cumsum(lengths) - lengths
    cuts = [np.arange(s, s + n, part) for s, n in zip(begins.tolist(), lengths.tolist()) if n > part]
    # A word's forward odds are its own times what the word before sends on; the backward ones are what the next sends.
    if not cuts:
        forward, backward = _run(r, begins, lengths, ahead, back, None, None)
    else:
        starts = np.sort(np.concatenate([begins[lengths <= part], *cuts]))
        sizes = np.diff(np.append(starts, lengths.sum()))
        starts, sizes = starts[sizes > 0], sizes[sizes > 0]
        first = np.isin(starts, begins[lengths > 0])
        last = np.append(first[1:], True)
        enter, leave = np.ones(len(starts)), np.ones(len(starts))
        some = np.flatnonzero(~(first & last))  # the parts of long documents
        go, come = _composed(r, starts[some], sizes[some], ahead, back)
        for i, k in enumerate(some.tolist()):
            if not first[k]:
                enter[k] = _fraction(ahead, _fraction(go[i - 1], enter[k - 1]))
        for i, k in reversed(list(enumerate(some.tolist()))):
            if not last[k]:
                leave[k] = _fraction(come[i + 1], leave[k + 1])
        forward, backward = _run(r, starts, sizes, ahead, back, enter, leave)
    p = forward * backward
    p /= 1 + p
    return (p, forward, backward) if full else p


def _fraction(m: np.ndarray, x: float) -> float:
    return float(np.clip((m[0, 0] * x + m[0, 1]) / (m[1, 0] * x + m[1, 1]), 1e-12, 1e12))


def _steps(sizes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Chains, the longest first, and the number of them that reach each step."""
    order = np.argsort(-sizes, kind="stable")
    lens = sizes[order]
    running = np.searchsorted(-lens, -np.arange(int(lens[0]) if len(lens) else 0), side="left")
    return order, running.tolist()


def _run(r: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ahead: np.ndarray, back: np.ndarray, enter: np.ndarray | None, leave: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of chains, given what enters them at both ends."""
    order, running = _steps(sizes)
    at0 = starts[order]
    forward, backward = np.empty_like(r), np.empty_like(r)
    f = np.ones(len(order)) if enter is None else enter[order]
    for t, k in enumerate(running):
        at, g = at0[:k] + t, f[:k]
        if t:
            g = (ahead[0, 0] * g + ahead[0, 1]) / (ahead[1, 0] * g + ahead[1, 1])
        f[:k] = np.clip(r[at] * g, 1e-12, 1e12)
        forward[at] = f[:k]
    b = np.ones(len(order)) if leave is None else leave[order]
    last = 0
    for t in range(len(running) - 1, -1, -1):
        k = running[t]
        at = at0[:k] + t
        if last:
            x = r[at[:last] + 1] * b[:last]
            b[:last] = np.clip((back[0, 0] * x + back[0, 1]) / (back[1, 0] * x + back[1, 1]), 1e-12, 1e12)
        backward[at] = b[:k]
        last = k
    return forward, backward


def _composed(r: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ahead: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chain the fraction that makes its last forward odds of what enters it, and the one that makes what it sends
    back to the word before it of what its last word gets. Each step multiplies from one side and is scaled to 1."""
    order, running = _steps(sizes)
    at0 = starts[order]
    go = np.tile(np.eye(2), (len(order), 1, 1))
    come = np.tile(np.eye(2), (len(order), 1, 1))
    for t, k in enumerate(running):
        own = r[at0[:k] + t]
        m = ahead @ go[:k] if t else go[:k]
        m[:, 0] *= own[:, None]
        go[:k] = m / m.max((1, 2), keepdims=True)
        w = come[:k] @ back
        w[:, :, 0] *= own[:, None]
        come[:k] = w / w.max((1, 2), keepdims=True)
    out, home = np.empty_like(go), np.empty_like(come)
    out[order], home[order] = go, come
    return out, home


def expected_moves(r: np.ndarray, forward: np.ndarray, backward: np.ndarray, begins: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected numbers of transitions, 2 x 2, from the pairwise marginals; begins: first words of chains."""
    inner = ~begins[1:]
    f, x = forward[:-1][inner], (r * backward)[1:][inner]
    cells = np.array([[moves[0, 0] + 0 * f, moves[0, 1] * x], [moves[1, 0] * f, moves[1, 1] * f * x]])
    return (cells / cells.sum((0, 1))).sum(2)


def document_features(p: np.ndarray, lengths: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    """Rows (1, log1p(sum), maximum, mean) of p for each document, zeros after the 1 for empty ones.

    Chances under floor count as 0 in the sum and mean: a long clean text has very many of them.
    """
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        total = np.add.reduceat(np.where(p >= floor, p, 0.0), starts)
        out[full, 1], out[full, 2], out[full, 3] = np.log1p(total), np.maximum.reduceat(p, starts), total / lengths[full]
    return out


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method; l2 on all weights keeps separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x / len(y) + l2 * np.eye(len(w)), x.T @ (q - y) / len(y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxic_words(docs: list[np.ndarray], table: np.ndarray, y: np.ndarray, ratio: float = RATIO) -> np.ndarray:
    """Which words (rows of table, their features) are toxic, by the documents, as word numbers, that hold a feature.

    Chance is bounded by exp(-n * KL(share in toxic documents, their share of all)), over the n documents that hold it.
    """
    counts = np.zeros((2, 1 << BITS))
    for words, label in zip(docs, y.tolist()):
        counts[label, np.unique(table[np.unique(words)])] += 1
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    n, q = counts.sum(0), n1 / (n0 + n1)
    share = np.clip(counts[1] / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    surprise = n * (share * np.log(share / q) + (1 - share) * np.log((1 - share) / (1 - q)))
    toxic = (counts[1] / n1 >= ratio * (counts[0] + 0.5) / n0) & (surprise >= np.log(max(2, (n > 0).sum())))
    return toxic[table].any(1)


def distinct_texts(docs: list[np.ndarray]) -> np.ndarray:
    """Places of the documents that are not near copies of one before: none shares the least hash of its runs of five
    words under either of two hashes."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for i, words in enumerate(docs):
        w = words.astype(np.uint64) + np.uint64(1)
        k = min(5, len(w))
        keys = []
        for seed, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            h = np.full(max(1, len(w) - k + 1), seed, np.uint64)
            for j in range(k):
                h = (h ^ w[j : len(w) - k + 1 + j]) * np.uint64(m)
                h ^= h >> np.uint64(31)
            keys.append((seed, int(h.min())))
        if not seen.intersection(keys):
            keep.append(i)
        seen.update(keys)
    return np.array(keep, int)


def fit(texts: Iterable[str | None], labels: Iterable[int], prior: float | None = None, steps: int = 80, rate: float = 0.15, l2: float = 1e-4, floor: float = FLOOR, few: int = FEW) -> Field:
    """Maximum conditional likelihood of the word labels by full gradient steps (Adam), then the document's logistic.

    The logistic learns from every third document, scored by a field that the others taught, and so sees chances of
    unseen texts; the field is then taught by all. With less than `few` documents of a label in either part, all do both.
    Chances under `floor` count as 0 in documents. prior: the part of toxic documents beyond the sample, if it isn't the
    sample's.
    """
    y = np.asarray(list(labels), int)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the score is the label, or 0
        odds = 4.0 if len(y) and y.max() else -4.0
        return Field(np.zeros(1 << BITS), np.ones((2, 2)), np.array([odds, 0, 0, 0]), floor)
    index: dict[str, int] = {}
    ids = []
    for t in texts:  # a text's words are numbers from here on; each distinct word is held once
        words = words_of(t)
        ids.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
    first = distinct_texts(ids)  # copies would lend their rare words weight
    ids, y = [ids[i] for i in first], y[first]
    table_ = np.empty((len(index), 7), np.int32)
    for i, w in enumerate(index):
        table_[i] = features(w)
    del index
    if y.min() == y.max():
        return fit([], y[:1])
    teach = np.arange(len(y)) % 3 != 2
    if min((y[part] == k).sum() for k in (0, 1) for part in (teach, ~teach)) < few:
        teach[:] = True
    check = ~teach if not teach.all() else teach
    w, m = _train([ids[i] for i in np.flatnonzero(teach)], table_, y[teach], steps, rate, l2)
    tested, y_tested = [ids[i] for i in np.flatnonzero(check)], y[check]
    flat, lengths = np.concatenate(tested), np.array(list(map(len, tested)))
    r = np.exp(np.clip(w[table_].sum(1), -30, 30))[flat]
    doc = logistic(document_features(marginals(r, lengths, m), lengths, floor), y_tested)
    if prior is not None and 0 < prior < 1:
        doc[0] += np.log(prior / (1 - prior)) - np.log(y_tested.mean() / (1 - y_tested.mean()))
    if not teach.all():
        w, m = _train(ids, table_, y, steps, rate, l2)
    return Field(w, m, doc, floor)


def _train(ids: list[np.ndarray], table_: np.ndarray, y: np.ndarray, steps: int, rate: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and exp of the transition weights."""
    bad = toxic_words(ids, table_, y)
    tags = [bad[words].astype(float) * label for words, label in zip(ids, y.tolist())]
    flat, goal = np.concatenate(ids), np.concatenate(tags)
    lengths = np.array(list(map(len, ids)))
    # Training alone cuts the chains into segments; all words of the sample take part.
    seg = np.concatenate([[SEGMENT] * (n // SEGMENT) + [n % SEGMENT] * (n % SEGMENT > 0) for n in lengths.tolist()] or [[]]).astype(int)
    begins = np.zeros(len(flat), bool)
    begins[np.cumsum(seg) - seg] = True
    w, move = np.zeros(1 << BITS), np.zeros((2, 2))
    move[0, 0] = 1.0
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (goal[:-1][~begins[1:]].astype(int), goal[1:][~begins[1:]].astype(int)), 1)
    scale = 1.0 / max(1.0, goal.sum())
    for k in range(1, steps + 1):
        r = np.exp(np.clip(w[table_].sum(1), -30, 30))[flat]
        m = np.exp(move)
        p, forward, backward = marginals(r, seg, m, full=True)
        by_word = np.bincount(flat, weights=p - goal, minlength=len(table_))
        g = np.bincount(table_.ravel(), weights=np.repeat(by_word, 7), minlength=len(w)) * scale + l2 * w
        expected = expected_moves(r, forward, backward, begins, m)
        gm = (expected - pairs) * scale + l2 * move
        for x, grad, i in ((w, g, 0), (move, gm, 2)):
            state[i] = 0.9 * state[i] + 0.1 * grad
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * grad**2
            x -= rate * (state[i] / (1 - 0.9**k)) / (np.sqrt(state[i + 1] / (1 - 0.99**k)) + 1e-8)
    m = np.exp(move - move.max())
    return w, m


class _Odds(dict):
    def __init__(self, field: Field):
        self.field = field

    def __missing__(self, word: str) -> float:
        if len(self) > _WORDS:
            self.clear()
        self[word] = o = self.field.odds(word.lower())
        return o


class Tagger:
    """Scores texts; it remembers the odds of words."""

    def __init__(self, field: Field):
        self.field, self.known = field, _Odds(field)

    def odds(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        r = [self.odds(WORD.findall(t or "")) for t in texts]
        lengths = np.array(list(map(len, r)), int)
        p = marginals(np.concatenate(r), lengths, self.field.moves)
        score = 1 / (1 + np.exp(-np.clip(document_features(p, lengths, self.field.floor) @ self.field.doc, -30, 30)))
        spans, start = [], 0
        for t, n in zip(texts, lengths.tolist()):
            spans.append(self.spans(t, p[start : start + n]) if n and p[start : start + n].max() >= 0.5 else [])
            start += n
        return score, spans

    def spans(self, text: str, p: np.ndarray) -> list[dict]:
        """Runs of words with a chance of 0.5 or more, in code points of the text."""
        out, before = [], -2
        spots = [m.span() for m in re.finditer(WORD, text)]
        for i in np.flatnonzero(p >= 0.5).tolist():
            if i == before + 1:
                out[-1]["end"], out[-1]["p"] = spots[i][1], max(out[-1]["p"], float(p[i]))
            else:
                out.append({"start": spots[i][0], "end": spots[i][1], "p": float(p[i])})
            before = i
        return out


def train_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learnt from: all but those whose crc32(id as text) mod 5 is 0."""
    return labels.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, floor: float = FLOOR, few: int = FEW) -> Field:
    """Fit on up to `sample` labelled documents of each label; ids labelled more than once count as toxic if once so.

    Rows of one id teach as one, by their least text, so the driver holds 2 * sample texts at most; null ids and labels
    teach nothing; without labels of both kinds the score is the label there is, or 0. floor and few are those of fit.
    """
    mine = train_rows(labels, id_col).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).alias("y"))
    pick = lambda y: mine.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    chosen = pick(1).union(pick(0))  # 2 * sample rows at most
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__id").groupBy("__id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["__id"], r["text"] or ""))
    n = {int(r["y"]): r["n"] for r in mine.groupBy("y").agg(F.count("*").alias("n")).collect() if r["y"] in (0, 1)}
    return fit([r["text"] for r in rows], [int(r["y"]) for r in rows], n.get(1, 0) / max(1, sum(n.values())), floor=floor, few=few)


def score_toxicity(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, score, spans) for every row, the field being of fixed size (2 MB).

    A null text counts as empty; texts without words have the score of no evidence; texts of any length are scored as
    one chain; repeated rows score alike; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in batches:
            at, texts, chars = 0, [], 0
            for i in range(b.num_rows):
                texts.append(b.column(2)[i].as_py())
                chars += len(texts[-1] or "")
                if chars >= 5 * _TOKENS or i == b.num_rows - 1:
                    score, spans = tagger.score(texts)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.array(score), pa.array(spans, kind)], ["doc_id", "tie", "score", "spans"])
                    at, texts, chars = i + 1, [], 0

    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, tie long, score double, spans array<struct<start:long,end:long,p:double>>")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs, all columns whatever their names, with a score under the threshold; scored in one pass, without
    a join.

    Null and empty texts have the score of no evidence; null ids and repeated rows are scored by their texts; a text of
    any length is scored whole; an empty table gives no rows; options are those of fit_toxicity.
    """
    field = fit_toxicity(docs, labels, id_col, text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(b.num_columns - 1)
            lengths = np.cumsum([len(t.as_py() or "") for t in texts])
            group = lengths // (5 * _TOKENS)
            keep = []
            for g in np.unique(group):
                score, _ = tagger.score([texts[int(i)].as_py() for i in np.flatnonzero(group == g)])
                keep.append(score < threshold)
            yield b.select(range(b.num_columns - 1)).filter(pa.array(np.concatenate(keep)))
        pa.default_memory_pool().release_unused()

    # The columns go by number meanwhile: Arrow functions take no names with dots.
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    kept = docs.select(*cols, F.col(text_col).cast("string").alias("text"))
    schema = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(docs.schema.fields)])
    return kept.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """score_toxicity of all documents by labels that may be learnt from; its docstring defines every case."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("offsets"),
    )
