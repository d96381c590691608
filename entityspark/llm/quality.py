"""Quality by co-training: a text view and a page view teach each other.

The text view sees the content: hashed words, the shapes of words and the layout (lines, repeats, kinds of characters).
The page view sees the document's metadata alone: language, source, length, and how these go together. Both start from
labelled documents. In each round a view labels the documents of which it is surest among all that are unlabelled, in the
labels' proportion, for the other view; then both are fitted again, on a bounded sample first and then corrected by
gradient sums over all documents taught. Platt scaling on labelled documents calibrates the views, and their joint log-odds
score every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, table
from .toxicity import logistic, train_rows

#: Labelled documents of each label, and unlabelled ones, on which the driver fits before all unlabelled ones correct it,
#: by a hash of their id.
LABELLED, UNLABELLED = 3000, 4000
ROUNDS, SHARE = 4, 0.1
#: Bins of log-odds, bins for each unit, values of a document's draw within a bin, pieces in which sums are added up.
BINS, FINE, DRAWS, PIECES = 4096, 64, 1 << 20, 8
BITS, LAYOUT, PAGE_BITS, PAGE_NUMBERS = 14, 12, 10, 2
_WORDS = 400_000
_SHAPE = str.maketrans({**{c: "a" for c in "bcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "BCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "123456789"}})
_RUN = re.compile(r"(.)\1+")


def _slot(text: str, bits: int) -> int:
    return xxhash.xxh32_intdigest(text) & ((1 << bits) - 1)


class TextView:
    """Rows of two hashes a distinct word, its form and its shape, with weights log(1 + count) scaled to length 1, and
    numbers of the layout."""

    size = (1 << BITS) + LAYOUT

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def slots(self, word: str) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > _WORDS:
                self.known.clear()
            shape = _RUN.sub(r"\1", word.translate(_SHAPE))
            got = self.known[word] = (_slot("w" + word.lower(), BITS), _slot("s" + shape, BITS))
        return got

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(text.split())
        total: Counter = Counter()
        for w, c in counts.items():
            a, b = self.slots(w)
            total[a] += c
            total[b] += c
        at = np.fromiter(total.keys(), int, len(total))
        x = np.log1p(np.fromiter(total.values(), float, len(total)))
        x /= np.sqrt((x**2).sum()) if len(x) else 1.0
        return np.concatenate([at, np.arange(1 << BITS, self.size)]), np.concatenate([x, self.layout(text, counts)])

    @staticmethod
    def layout(text: str, counts: Counter) -> list[float]:
        n, words = len(text), sum(counts.values())
        lines = text.split("\n")
        letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
        upper = len(re.findall(r"[A-Z]", text))
        marks = len(re.findall(r"[^\w\s]", text))
        return [
            math.log1p(words) / 10,
            math.log1p(len(lines)) / 10,
            len(set(lines)) / len(lines),
            len(counts) / words if words else 0.0,
            max(counts.values()) / words if words else 0.0,
            letters / n if n else 0.0,
            upper / letters if letters else 0.0,
            marks / n if n else 0.0,
            len(re.findall(r"[0-9]", text)) / n if n else 0.0,
            min(2.0, n / words / 8) if words else 0.0,
            min(1.0, text.count("|") / words * 2) if words else 0.0,
            min(1.0, max(map(len, lines)) / 1000),
        ]


class PageView:
    """Rows of metadata: 1, the length, and a hashed slot each for language, source, the length's power of two, and the
    pairs of these."""

    size = PAGE_NUMBERS + (1 << PAGE_BITS)

    def row(self, lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        known = n_chars is not None and n_chars >= 0
        facts = [f"l{lang}", f"s{source}", f"n{n_chars.bit_length() if known else None}"]
        pairs = [f"{a} {b}" for i, a in enumerate(facts) for b in facts[i + 1 :]]
        slots = [PAGE_NUMBERS + _slot(x, PAGE_BITS) for x in facts + pairs]
        return np.array([*range(PAGE_NUMBERS), *slots]), np.array([1.0, math.log1p(n_chars) / 10 if known else 0.0, *[0.3] * len(slots)])


@dataclass
class Rows:
    """Sparse rows of one view: the row of each entry, its slot and its value."""

    n: int
    ids: np.ndarray
    at: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        at, x = (np.concatenate([np.zeros(0, t), *[r[i] for r in rows]]) for i, t in ((0, int), (1, float)))
        return cls(len(rows), np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows]), at, x)

    def raw(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, weights=w[self.at] * self.x, minlength=self.n)

    def slopes(self, w: np.ndarray, y: np.ndarray, each: np.ndarray, size: int, curved: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The weighted sums of the loss's gradient and, if asked for, of the diagonal of its curvature."""
        p = 1 / (1 + np.exp(-np.clip(self.raw(w), -30, 30)))
        g = np.bincount(self.at, weights=((p - y) * each)[self.ids] * self.x, minlength=size)
        return g, np.bincount(self.at, weights=(p * (1 - p) * each)[self.ids] * self.x**2, minlength=size) if curved else g


@dataclass
class Rule:
    """What a view teaches in one round: the surest bins at both ends, and a share, by draw, of the bin at the edge."""

    w: np.ndarray
    low: tuple[int, float]
    high: tuple[int, float]

    @staticmethod
    def bins(z: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(z * FINE) + BINS // 2, 0, BINS - 1).astype(int)

    @staticmethod
    def edge(counts: np.ndarray, want: int) -> tuple[int, float]:
        """The first bins with `want` documents together, of those whose log-odds are beyond 1."""
        sure = BINS // 2 - FINE
        total = np.cumsum(counts[:sure])
        k = int(np.searchsorted(total, want, "right"))
        return (k, float((want - (total[k - 1] if k else 0)) / counts[k])) if k < sure else (sure, 0.0)

    @classmethod
    def of(cls, w: np.ndarray, counts: np.ndarray, low: int, high: int) -> Rule:
        return cls(w, cls.edge(counts, low), cls.edge(counts[::-1], high))

    def labels(self, rows: Rows, draw: np.ndarray) -> np.ndarray:
        b, u = self.bins(rows.raw(self.w)), draw / DRAWS
        one = lambda b, e: (b < e[0]) | ((b == e[0]) & (u < e[1]))
        return np.where(one(b, self.low), 0, np.where(one(BINS - 1 - b, self.high), 1, -1))


def taught(rules: list[Rule], teacher: Rows, draw: np.ndarray) -> np.ndarray:
    """Labels from the first rule that gives one, or -1."""
    y = np.full(len(draw), -1)
    for rule in rules:
        y = np.where(y < 0, rule.labels(teacher, draw), y)
    return y


def _tally(model: list[Linear], rules: list[list[Rule]], views: list[Rows], draw: np.ndarray) -> np.ndarray:
    """Of each view, its log-odds of the documents that it hasn't labelled yet, counted by bins."""
    return np.concatenate([np.bincount(Rule.bins(views[v].raw(model[v].w))[taught(rules[v], views[v], draw) < 0], minlength=BINS) for v in (0, 1)]).astype(float)


def _sums(model: list[Linear], rules: list[list[Rule]], views: list[Rows], draw: np.ndarray) -> np.ndarray:
    """Of each view and label: the gradient, the curvature and the number of the documents that it is taught."""
    out = []
    for v in (0, 1):
        y = taught(rules[1 - v], views[1 - v], draw)
        for label in (0, 1):
            each = (y == label).astype(float)
            out += [*views[v].slopes(model[v].w, np.full(len(y), label), each, len(model[v].w), True), [each.sum()]]
    return np.concatenate(out)


class Pool:
    """All unlabelled documents, as a table of packed rows; or those at hand."""

    def __init__(self, made: DataFrame | None, skip: set, sample: list[Rows], draw: np.ndarray):
        self.made, self.skip, self.sample, self.draw = made, skip, sample, draw

    def total(self, of, model: list[Linear], rules: list[list[Rule]]) -> np.ndarray:
        """The sum of of(model, rules, views, draw) over all documents; the driver gets one vector."""
        if self.made is None:
            return of(model, rules, self.sample, self.draw)
        spark = self.made.sparkSession
        shared = spark.sparkContext.broadcast((model, rules, self.skip))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, r, skip = shared.value
            total = None
            for b in batches:
                for i in range(b.num_rows):
                    ids, draw, views = unpack(b, i)
                    draw = np.where([d in skip for d in ids], -1, draw)
                    one = of(m, r, [_only(v, draw >= 0) for v in views], draw[draw >= 0])
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([x.tobytes() for x in np.array_split(total, PIECES)], pa.binary())], ["piece", "part"])

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for piece, part in zip(*(c.to_pylist() for c in b.columns)):
                    x = np.frombuffer(part)
                    total[piece] = total[piece] + x if piece in total else x
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "part"])

        sums = self.made.mapInArrow(run, "piece int, part binary").repartition(min(PIECES, partitions(spark)), "piece").sortWithinPartitions("piece", F.xxhash64("part")).mapInArrow(add, "piece int, part binary").collect()
        if not sums:
            return of(model, rules, self.sample, self.draw) * 0
        return np.concatenate([np.frombuffer(r["part"]) for r in sorted(sums, key=lambda r: r["piece"])])


def _only(rows: Rows, keep: np.ndarray) -> Rows:
    if keep.all():
        return rows
    mine = keep[rows.ids]
    return Rows(int(keep.sum()), (np.cumsum(keep) - 1)[rows.ids[mine]], rows.at[mine], rows.x[mine])


@dataclass
class Linear:
    """Sparse logistic regression: weights, and Platt's scale and offset."""

    w: np.ndarray
    scale: float = 1.0
    offset: float = 0.0

    @classmethod
    def fit(cls, rows: Rows, y: np.ndarray, each: np.ndarray, size: int, start: np.ndarray | None = None, pull: tuple | None = None, steps: int = 120, rate: float = 0.2, l2: float = 1e-4) -> Linear:
        """Full gradient steps (Adam) with a weight for each row; pull adds a gradient and a curvature around start."""
        w = np.zeros(size) if start is None else start.copy()
        m, v = np.zeros(size), np.zeros(size)
        for k in range(1, steps + 1):
            g = rows.slopes(w, y, each, size)[0] + l2 * w
            if pull is not None:
                g += pull[0] + pull[1] * (w - start)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
            w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return cls(w)

    def raw(self, rows: Rows | list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return rows.raw(self.w) if isinstance(rows, Rows) else np.array([self.w[a] @ x for a, x in rows])

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        self.offset, self.scale = logistic(np.stack([np.ones(len(y)), self.raw(rows)], 1), y)

    def logit(self, rows: Rows | list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return self.scale * self.raw(rows) + self.offset


@dataclass
class Model:
    text: Linear
    page: Linear
    prior: float
    joint: np.ndarray  # offset and the weight of each view's log-odds

    def score(self, text_rows: Rows, page_rows: Rows) -> np.ndarray:
        z = np.stack([np.ones(text_rows.n), self.text.logit(text_rows), self.page.logit(page_rows)], 1) @ self.joint
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Views:
    def __init__(self):
        self.text, self.page = TextView(), PageView()

    def rows(self, docs: Iterable[tuple]) -> tuple[list, list]:
        """The rows of both views for (text, lang, source, n_chars)."""
        a, b = [], []
        for text, lang, source, n_chars in docs:
            a.append(self.text.row(text or ""))
            b.append(self.page.row(lang, source, n_chars))
        return a, b


def co_train(labelled: list[tuple], y: np.ndarray, unlabelled: list[tuple], rounds: int = ROUNDS, share: float = SHARE, made: DataFrame | None = None, skip: set = frozenset(), l2: float = 1e-4) -> Model:
    """Fit from labelled (text, lang, source, n_chars) and labels; a fifth of them, every fifth, only calibrates.

    The unlabelled documents are all those of made, but for the ids in skip, and unlabelled is a sample of them that
    only shapes the steps; without made, they are all there are.
    """
    size = (TextView.size, PageView.size)
    if not len(y) or y.min() == y.max():
        z = 4.0 if len(y) and y.max() else -4.0
        return Model(Linear(np.zeros(size[0])), Linear(np.zeros(size[1])), 0.5, np.array([z, 0.0, 0.0]))
    views = Views()
    own, some = views.rows(labelled), views.rows(unlabelled)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    check = held if held.any() else ~held
    draw = np.arange(len(unlabelled)) * 2_654_435_761 % DRAWS
    pool = Pool(made, skip, [Rows.of(r) for r in some], draw)
    rules: list[list[Rule]] = [[], []]  # of each view: what it taught the other one
    prior = float(y.mean())
    known = y[~held]

    def fitted(v: int, n: float, start: np.ndarray | None = None, sums: list | None = None) -> Linear:
        """On the labelled documents and the sample's taught ones, each for its share of n; sums correct it to all."""
        lessons = taught(rules[1 - v], pool.sample[1 - v], draw)
        at = np.flatnonzero(lessons >= 0)
        rows = Rows.of([own[v][i] for i in np.flatnonzero(~held)] + [some[v][i] for i in at])
        goal = np.array([*known, *lessons[at]])
        each = np.array([1.0] * len(known) + [n / max(1, len(draw))] * len(at))
        counts = [max(1.0, each[goal == c].sum()) if sums is None else max(1.0, (known == c).sum() + sums[c][2][0]) for c in (0, 1)]
        each *= np.where(goal == 1, 0.5 / counts[1], 0.5 / counts[0])
        if sums is None:
            return Linear.fit(rows, goal, each, size[v], l2=l2)
        here = rows.slopes(start, goal, each, size[v], True)
        base = Rows.of([own[v][i] for i in np.flatnonzero(~held)]).slopes(start, known, each[: len(known)], size[v], True)
        full = [base[i] + sum(0.5 / counts[c] * sums[c][i] for c in (0, 1)) for i in (0, 1)]
        return Linear.fit(rows, goal, each, size[v], start, (full[0] - here[0], np.maximum(0, full[1] - here[1])), 40, 0.05, l2)

    model, n = [fitted(0, 0), fitted(1, 0)], None
    for _ in range(rounds if unlabelled or made is not None else 0):
        tally = pool.total(_tally, model, rules).reshape(2, BINS)
        n = tally[0].sum() if n is None else n
        for v in (0, 1):
            rules[v].append(Rule.of(model[v].w, tally[v], int(share * n * (1 - prior)), int(share * n * prior)))
        model = [fitted(0, n), fitted(1, n)]
        if made is not None:
            sums = iter(np.split(pool.total(_sums, model, rules), np.cumsum([k for v in (0, 1) for _ in (0, 1) for k in (size[v], size[v], 1)])))
            model = [fitted(v, n, model[v].w, [[next(sums) for _ in range(3)] for _ in (0, 1)]) for v in (0, 1)]
    for v in (0, 1):
        model[v].calibrate([own[v][i] for i in np.flatnonzero(check)], y[check])
    logits = [model[v].logit([own[v][i] for i in np.flatnonzero(check)]) for v in (0, 1)]
    joint = logistic(np.stack([np.ones(check.sum()), *logits], 1), y[check], l2=1e-2)
    return Model(model[0], model[1], prior, joint)


def _columns(docs: DataFrame, text_col: str, lang_col: str, source_col: str, n_chars_col: str) -> list[Column]:
    return [F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(n_chars_col).cast("long").alias("n_chars")]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", n_chars_col: str = "n_chars") -> DataFrame:
    """Both views of every row, 256 rows in one, and the rows' ids and draws; the draw of those never learnt from is -1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = Views()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = [pa.array([part.column(i).to_pylist()], pa.list_(part.column(i).type)) for i in (0, 1)]
                for rows in views.rows(zip(*(c.to_pylist() for c in part.columns[2:]))):
                    one = Rows.of(rows)
                    n = np.array([len(a) for a, _ in rows], np.int32)
                    out += [pa.array([x.tobytes()], pa.binary()) for x in (n, one.at.astype(np.uint16), one.x.astype(np.float32))]
                yield pa.RecordBatch.from_arrays(out, ["ids", "draws", "n0", "at0", "x0", "n1", "at1", "x1"])

    key = F.col(id_col)
    learnt = key.isNotNull() & (F.crc32(key.cast("string").cast("binary")) % 5 != 0)
    draw = F.when(learnt, F.pmod(F.xxhash64(key, F.lit(3)), F.lit(DRAWS))).otherwise(F.lit(-1)).cast("long")
    src = docs.select(key.alias("id"), draw.alias("draw"), *_columns(docs, text_col, lang_col, source_col, n_chars_col))
    return src.mapInArrow(run, f"ids array<{dict(src.dtypes)['id']}>, draws array<long>, n0 binary, at0 binary, x0 binary, n1 binary, at1 binary, x1 binary")


def unpack(b: pa.RecordBatch, i: int) -> tuple[list, np.ndarray, list[Rows]]:
    """Ids, draws and both views of one row of features."""
    views = []
    for c in (2, 5):
        n, at, x = (np.frombuffer(b.column(c + j)[i].as_buffer(), t) for j, t in enumerate((np.int32, np.uint16, np.float32)))
        views.append(Rows(len(n), np.repeat(np.arange(len(n)), n), at.astype(int), x.astype(float)))
    return b.column(0)[i].as_py(), np.array(b.column(1)[i].as_py(), int), views


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", n_chars_col: str = "n_chars", n_labelled: int = LABELLED, n_unlabelled: int = UNLABELLED, made: DataFrame | None = None
) -> Model:
    """Fit on up to n_labelled documents of each label and on all without one; ids labelled twice count by their least
    label. The driver holds n_unlabelled of the others, one row of each id; the rest take part by sums. Null ids and
    labels teach nothing; without labels of both kinds the score is the label there is, or 0. made is features(docs), if
    at hand."""
    mine = train_rows(labels, id_col).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("y"))
    pick = lambda y: mine.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(n_labelled)
    chosen = pick(1).union(pick(0))
    free = docs.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull()).orderBy(F.xxhash64("__id", F.lit(1)), "__id").limit(n_unlabelled).withColumn("y", F.lit(-1))
    ids = chosen.union(free.join(F.broadcast(chosen.select("__id")), "__id", "left_anti"))
    src = docs.select(F.col(id_col).alias("__id"), *_columns(docs, text_col, lang_col, source_col, n_chars_col))
    mine = src.join(F.broadcast(ids), "__id").where((F.col("y") >= 0) | (F.crc32(F.col("__id").cast("string").cast("binary")) % 5 != 0))
    rows = mine.groupBy("__id", "y").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).collect()
    rows.sort(key=lambda r: r["__id"])
    of = lambda r: tuple(r["r"])
    known = [r for r in rows if r["y"] >= 0]
    if made is None:
        made = materialize(features(docs, id_col, text_col, lang_col, source_col, n_chars_col), "features")
    return co_train([of(r) for r in known], np.array([r["y"] for r in known], int), [of(r) for r in rows if r["y"] < 0], made=made, skip={r["__id"] for r in known})


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", n_chars_col: str = "n_chars", made: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, text_score, page_score) for every row: the chances of label 1 by both views and by each.

    A null text counts as empty; null metadata has slots of its own, and a negative n_chars counts as null;
    whole texts are seen; repeated rows score alike; an empty table gives no rows; other columns are ignored. made is
    features(docs), if at hand.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    if made is None:
        made = features(docs, id_col, text_col, lang_col, source_col, n_chars_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i in range(b.num_rows):
                text, page = unpack(b, i)[2]
                out = m.score(text, page), chance(m.text.logit(text)), chance(m.page.logit(page))
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, *map(pa.array, out)], ["doc_id", "score", "text_score", "page_score"])

    return made.mapInArrow(run, f"doc_id {dict(docs.select(F.col(id_col)).dtypes)[id_col]}, score double, text_score double, page_score double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """score_quality of all documents by labels that may be learnt from; its docstring defines every case."""
    docs = table(spark, sf_dir, "documents")
    made = materialize(features(docs), "features")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), made=made), made=made)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "page_score")
