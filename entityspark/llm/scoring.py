"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

The texts are put into blocks once: the forms of their words, and for each word the number of its form. Every form is
counted over the whole corpus, in a table that grows with it. The commonest forms are the network's vocabulary, all others
share its hashed slots. The network sums an embedding of each neighbour, by its place, and predicts a word's class and
then the word, or its slot, within the class. Every partition trains it on all of its blocks from the same start, and the
results are averaged by words, with a shuffle and no driver-side gathering of documents; then each document gets the sum
of its words' conditional log-probabilities. Within its slot, a form beyond the vocabulary has the chance that its
occurrences elsewhere in the corpus give it, and the letters of forms that stand nowhere else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, packed, partitions, table

#: The network's size: classes and words in each, of which the last class is for hashed rare words; embedding size;
#: words on each side.
CLASSES, SIZE, DIM, SIDE = 32, 32, 24, 2
VOCABULARY = CLASSES * SIZE
BATCH, RATE = 8192, 0.15
#: The spelling's size: characters with a frequency of their own; all others share one.
CHARACTERS = 2048
#: Characters of the texts in a block, and blocks in a file; pieces of the model that are averaged apart.
BLOCK, FILE_BLOCKS, PIECES = 1 << 23, 8, 64
PAD = VOCABULARY


_RNG = np.random.default_rng(64)
_BYTES, _STEP = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64), 0x9E3779B97F4A7C15


def _strings(forms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, and where each begins and the last ends."""
    at = np.frombuffer(forms.buffers()[1], np.int32)[forms.offset : forms.offset + len(forms) + 1]
    data = np.frombuffer(forms.buffers()[2] or b"", np.uint8)
    return (data[at[0] : at[-1]], at - at[0]) if len(forms) else (data[:0], np.zeros(1, np.int32))


def form_keys(forms: pa.Array) -> np.ndarray:
    """A 64-bit key of each form, no form being empty: a polynomial of its bytes. Two forms of one key would be counted
    together, which a hundred million forms make less likely than one in a thousand."""
    if not len(forms):
        return np.zeros(0, np.int64)
    data, at = _strings(forms)
    sizes = np.diff(at)
    powers = np.cumprod(np.full(int(sizes.max()), _STEP, np.uint64))
    place = np.arange(len(data)) - np.repeat(at[:-1], sizes)
    key = np.add.reduceat(_BYTES[data] * powers[place], at[:-1])
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ key >> np.uint64(29)).view(np.int64)


class _Forms(dict):
    """The number of each word's form in a block; it looks each spelling up once."""

    def __init__(self):
        self.lower: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        self[word] = i = self.lower.setdefault(word.lower(), len(self.lower))
        return i


def encode_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK) -> DataFrame:
    """(block, ids, lengths, codes, forms, keys, counts, letters, letter_counts): one row for about block_chars characters
    of whole texts.

    Blocks are numbered by the partition that made them and their order in it.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(src.dtypes)["id"]
    names = ["block", "ids", "lengths", "codes", "forms", "keys", "counts", "letters", "letter_counts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, codes, known, size = [], [], _Forms(), 0

        def out() -> pa.RecordBatch:
            every, forms = np.concatenate(codes), pa.array(list(known.lower), pa.string())
            counts = np.bincount(every, minlength=len(forms))
            joined = "".join(known.lower)
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            of = np.repeat(counts, np.fromiter(map(len, known.lower), np.int64, len(forms)))
            letters, inverse = np.unique(points, return_inverse=True)
            row = [number, ids, np.array(list(map(len, codes)), np.int64).tobytes(), every.tobytes(), forms, form_keys(forms), counts, letters, np.bincount(inverse, weights=of, minlength=len(letters)).astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        types = None
        for b in batches:
            types = types or [pa.int64(), pa.list_(b.column(0).type), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                words = WORD.findall(text)
                ids.append(i)
                codes.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                size += len(text)
                if size >= block_chars:
                    yield out()
                    number, ids, codes, known, size = number + 1, [], [], _Forms(), 0
        if ids:
            yield out()

    return src.mapInArrow(run, f"block long, ids array<{kind}>, lengths binary, codes binary, forms array<string>, keys array<long>, counts array<long>, letters array<int>, letter_counts array<long>")


def form_places(blocks: DataFrame) -> DataFrame:
    """(key, block, at, n, first): each form of each block, with its number in the whole corpus; first marks one row of
    each form.

    A form has one row a block, however common it is, so no key is hot: a block has some 100,000 forms.
    """
    each = blocks.select("block", F.posexplode(F.arrays_zip("keys", "counts")).alias("at", "x")).select(F.col("x.keys").alias("key"), "block", "at", F.col("x.counts").alias("c"))
    w = Window.partitionBy("key")
    return each.select("key", "block", "at", F.sum("c").over(w).alias("n"), (F.min("block").over(w) == F.col("block")).alias("first"))


@dataclass
class Vocabulary:
    keys: np.ndarray  # of the vocabulary's forms, ascending
    places: np.ndarray  # their slots, the commonest form's first
    spelling: dict[str, float]  # log-probability of each character; "" for the end and for any other
    rare: int = 0  # words of the corpus beyond the vocabulary
    once: int = 0  # those of them that the corpus has once: what unseen forms weigh
    last: tuple[int, int] | None = None  # number and key of the vocabulary's last form, if there are others

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether keys are in the vocabulary, and where they would be."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)), at

    def slots(self, keys: np.ndarray) -> np.ndarray:
        hit, at = self.known(keys)
        hashed = VOCABULARY - SIZE + (keys.view(np.uint64) % np.uint64(SIZE)).astype(np.int64)
        return np.where(hit, self.places[at], hashed) if len(self.keys) else hashed

    def spelled(self, forms: pa.Array) -> np.ndarray:
        """The log-probability of the letters of each form."""
        if not len(forms):
            return np.zeros(0)
        other = self.spelling[""]
        table = np.full(0x110000, other)
        for c, p in self.spelling.items():
            if c:
                table[ord(c)] = p
        data, _ = _strings(forms)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        sizes = pc.utf8_length(forms).to_numpy(zero_copy_only=False)
        return np.add.reduceat(table[points], np.cumsum(sizes) - sizes) + other

    def within(self, forms: pa.Array, n: np.ndarray) -> np.ndarray:
        """The log-probabilities of rare forms within their slots, n being their numbers in the corpus.

        Their other occurrences count, and the letters weigh as much as the forms that occur once, as estimates of
        unseen forms do. Slots have an equal part of the rare forms on average.
        """
        weight = max(1, self.once)
        return np.log((n - 1 + weight * np.exp(self.spelled(forms))) / (max(0, self.rare - 1) + weight)) + np.log(SIZE)


def build_vocabulary(places: DataFrame, blocks: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the counts of its slots over all documents, from form_places."""
    counts = places.where("first").select("key", "n")
    top = counts.orderBy(F.desc("n"), "key").limit(VOCABULARY - SIZE).collect()
    last = (top[-1]["n"], top[-1]["key"]) if len(top) == VOCABULARY - SIZE else None
    total, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") == 1, 1))).first()
    each = blocks.select(F.explode(F.arrays_zip("letters", "letter_counts")).alias("x")).select(F.col("x.letters").alias("c"), F.col("x.letter_counts").alias("n"))
    letters = each.groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(CHARACTERS).collect()
    mass = sum(r["n"] for r in letters) + 2 * total + 2
    spelling = {chr(r["c"]): float(np.log(r["n"] / mass)) for r in letters} | {"": float(np.log((total + 1) / mass))}
    freq = np.ones(VOCABULARY)
    for i, r in enumerate(top):
        freq[i] += r["n"]
    rare = max(0, total - sum(r["n"] for r in top))
    freq[-SIZE:] += rare / SIZE
    keys = np.array([r["key"] for r in top], np.int64)
    order = np.argsort(keys)
    return Vocabulary(keys[order], order, spelling, rare, once - sum(r["n"] == 1 for r in top), last), freq


class Network:
    """Parameters in one flat vector, and the passes over it."""

    shapes = {"near": (2 * SIDE * (VOCABULARY + 1), DIM), "bias": (DIM,), "cls": (CLASSES, DIM), "cls_bias": (CLASSES,), "word": (CLASSES, SIZE, DIM), "word_bias": (CLASSES, SIZE)}
    length = sum(int(np.prod(s)) for s in shapes.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat.astype(np.float32), 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, freq: np.ndarray, seed: int = 5) -> Network:
        """Small random embeddings; the biases already give the words' frequencies."""
        net = cls(np.zeros(cls.length, np.float32))
        rng = np.random.default_rng(seed)
        for name in ("near", "cls", "word"):
            x = getattr(net, name)
            x[...] = rng.normal(0, 0.1, x.shape)
        f = freq.reshape(CLASSES, SIZE)
        net.cls_bias[...] = np.log(f.sum(1) / f.sum())
        net.word_bias[...] = np.log(f / f.sum(1, keepdims=True))
        return net

    def passes(self, around: np.ndarray, target: np.ndarray, grad: Network | None = None) -> np.ndarray:
        """Log-probabilities of targets given their neighbours' rows of `near`; adds the mean's gradient to grad.

        around has a row for each place. Words are put in the order of their classes, so that a class's are together.
        """
        n = len(target)
        c = target // SIZE
        order = np.argsort(c.astype(np.uint8), kind="stable")  # a radix sort
        around, target, c = around[:, order], target[order], c[order]
        rows = np.take(self.near, around[0], axis=0)
        for at in around[1:]:
            rows += np.take(self.near, at, axis=0)
        rows += self.bias
        h = np.tanh(np.ascontiguousarray(rows.T))  # from here on a column for each word
        out, e = _softmax(self.cls, self.cls_bias, h, c)
        if grad is not None:
            e /= n
            grad.cls += e @ h.T
            grad.cls_bias += e.sum(1)
            back = self.cls.T @ e
        cuts = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
        w = target - c * SIZE
        for k, (start, end) in enumerate(zip(cuts, cuts[1:])):
            if start == end:
                continue
            mine = h[:, start:end]
            p, e = _softmax(self.word[k], self.word_bias[k], mine, w[start:end])
            out[start:end] += p
            if grad is not None:
                e /= n
                grad.word[k] += e @ mine.T
                grad.word_bias[k] += e.sum(1)
                back[:, start:end] += self.word[k].T @ e
        if grad is not None:
            back *= 1 - h * h
            grad.bias += back.sum(1)
            for i, at in enumerate(around):  # each place has rows of its own
                low = i * (VOCABULARY + 1)
                total = np.zeros((DIM, VOCABULARY + 1), np.float32)
                at = at - low
                for j in range(DIM):
                    np.add.at(total[j], at, back[j])
                grad.near[low : low + VOCABULARY + 1] += total.T
        p = np.empty_like(out)
        p[order] = out
        return p


def _softmax(weights: np.ndarray, bias: np.ndarray, h: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-probability of each column's goal, and the probabilities, less 1 at the goal."""
    z = weights @ h
    z += bias[:, None]
    if (np.abs(weights).sum(1) + np.abs(bias)).max() > 60:  # h lies within -1 and 1; below this no exponential overflows
        z -= z.max(0)
    at = np.arange(len(goal))
    p = z[goal, at]
    np.exp(z, out=z)
    total = z.sum(0)
    z /= total
    z[goal, at] -= 1
    return p - np.log(total), z


def _numbers(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind)


class Windows:
    """Neighbours of the words of whole documents, with pads beyond a document's ends."""

    def __init__(self, target: np.ndarray, lengths: np.ndarray):
        self.at = np.arange(len(target)) + SIDE * np.repeat(np.arange(1, len(lengths) + 1), lengths)
        self.flat = np.full(len(target) + SIDE * (len(lengths) + 1), PAD, np.int64)
        self.flat[self.at] = target

    def __len__(self) -> int:
        return len(self.at)

    def some(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of `near` around each of some words, place by place; and the words."""
        at = self.at[start:end]
        offsets = [*range(-SIDE, 0), *range(1, SIDE + 1)]
        return np.stack([self.flat[at + o] + i * (VOCABULARY + 1) for i, o in enumerate(offsets)]), self.flat[at]


def train(blocks: DataFrame, vocabulary: Vocabulary, freq: np.ndarray, rate: float = RATE) -> Network:
    """One pass over all blocks: each partition steps on from the common start, and the results are averaged by the
    words seen. What is shuffled is one model (0.5 MB) a partition, and what reaches the driver one model.

    The model hangs on how the blocks lie in partitions: the same files, settings and code give it again, and another
    layout gives scores that differ a little.
    """
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, freq))
    cut = np.linspace(0, Network.length, PIECES + 1).astype(int).tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, f = shared.value
        net, seen = Network.start(f), 0
        grad, second = Network(np.zeros(Network.length)), np.full(Network.length, 1e-8, np.float32)
        for b in batches:
            for lengths, codes, keys in zip(*b.columns):
                windows = Windows(vocab.slots(keys.values.to_numpy())[_numbers(codes, np.int32)], _numbers(lengths, np.int64))
                for at in range(0, len(windows), BATCH):
                    grad.flat[...] = 0
                    net.passes(*windows.some(at, at + BATCH), grad)
                    second[...] += grad.flat**2
                    net.flat[...] -= rate * grad.flat / np.sqrt(second)
                seen += len(windows)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([seen] * PIECES, pa.int64()), pa.array([net.flat[s:e].tobytes() for s, e in zip(cut, cut[1:])], pa.binary())], ["piece", "seen", "part"])

    def mean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        weight: Counter = Counter()
        for b in batches:
            for piece, n, part in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(part, np.float32).astype(np.float64) * n
                total[piece] = total[piece] + x if piece in total else x
                weight[piece] += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(x / weight[p]).astype(np.float32).tobytes() for p, x in total.items()], pa.binary())], ["piece", "part"])

    parts = blocks.select("lengths", "codes", "keys").mapInArrow(run, "piece int, seen long, part binary")
    merged = materialize(parts, "models").repartition(partitions(spark), "piece").sortWithinPartitions("piece", "seen", F.xxhash64("part")).mapInArrow(mean, "piece int, part binary").collect()
    if not merged:
        return Network.start(freq)
    return Network(np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(merged, key=lambda r: r["piece"])]))


def score_blocks(blocks: DataFrame, places: DataFrame, vocabulary: Vocabulary, net: Network) -> DataFrame:
    """(doc_id, n_words, n_alone, log_prob, mean_log_prob) of every document of the blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast((vocabulary, net.flat))
    kind = dict(blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, flat = shared.value
        model = Network(flat)
        for b in batches:
            for ids, lengths, codes, forms, at, n in zip(*b.columns):
                lengths, codes = _numbers(lengths, np.int64), _numbers(codes, np.int32)
                keys = form_keys(forms.values)  # cheaper than to move them
                inside, alone = np.zeros(len(keys)), np.zeros(len(keys), bool)
                at, n = _numbers(at, np.int32), _numbers(n, np.int64)
                inside[at], alone[at] = vocab.within(forms.values.take(pa.array(at)), n), n == 1
                windows = Windows(vocab.slots(keys)[codes], lengths)
                p = np.concatenate([np.zeros(0), *[model.passes(*windows.some(s, s + 2 * BATCH)) for s in range(0, len(windows), 2 * BATCH)]]).astype(np.float64)
                ends = np.append(0, np.cumsum(lengths))
                total = np.diff(np.append(0.0, np.cumsum(p + inside[codes]))[ends])
                single = np.diff(np.append(0, np.cumsum(alone[codes]))[ends])
                per = pa.array([t / k if k else None for t, k in zip(total.tolist(), lengths.tolist())], pa.float64())
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(lengths), pa.array(single, pa.int64()), pa.array(total), per], ["doc_id", "n_words", "n_alone", "log_prob", "mean_log_prob"])

    rare = places.where(F.lit(False))
    if vocabulary.last is not None:
        n, key = vocabulary.last
        rare = places.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("key") > key)))
    numbers = packed(rare.select("block", "at", "n"), "block", {"at": "int", "n": "long"})
    both = blocks.select("block", "ids", "lengths", "codes", "forms").join(numbers, "block", "left").select("ids", "lengths", "codes", "forms", "ats", "ns")
    return both.mapInArrow(run, f"doc_id {kind}, n_words long, n_alone long, log_prob double, mean_log_prob double")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_alone, log_prob, mean_log_prob) of every row: the sum over all words of a whole text of their
    log-probability given both sides; n_alone of the words stand nowhere else in the corpus.

    A null or wordless text has 0 words, log_prob 0 and mean_log_prob null; null ids are kept; repeated rows score alike;
    an empty table gives no rows; a text of any length is one document of one block; other columns are ignored.
    """
    blocks = materialize(encode_blocks(docs, id_col, text_col, block_chars), "blocks", FILE_BLOCKS)
    places = materialize(form_places(blocks), "forms")
    vocabulary, freq = build_vocabulary(places, blocks)
    return score_blocks(blocks, places, vocabulary, train(blocks, vocabulary, freq))


def op3_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    """pseudo_likelihood of all documents, whose docstring defines every case."""
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
