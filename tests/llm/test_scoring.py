"""The window network: gradients by differences, probabilities that sum to one, text against shuffled text, and whole
scores against plain loops over the fitted model."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from entityspark.llm import scoring as s


def windows(docs):
    return s.Windows(np.concatenate([np.zeros(0, int), *docs]).astype(int), np.array(list(map(len, docs)))).some(0, 1 << 30)


def test_probabilities_and_gradient():
    net = s.Network.start(np.ones(s.VOCABULARY))
    around, _ = windows([np.array([3, 900])])
    every = np.arange(s.VOCABULARY)
    p = net.passes(np.repeat(around[:, :1], s.VOCABULARY, 1), every)
    assert abs(np.exp(p.astype(float)).sum() - 1) < 1e-4
    large = s.Network(net.flat * 400)
    assert abs(np.exp(large.passes(np.repeat(around[:, :1], s.VOCABULARY, 1), every).astype(float)).sum() - 1) < 1e-3
    rng = np.random.default_rng(0)
    around, target = windows([rng.integers(0, s.VOCABULARY, 50), np.zeros(0, int), rng.integers(0, s.VOCABULARY, 3)])
    grad = s.Network(np.zeros(s.Network.length))
    net.passes(around, target, grad)
    for name in ("near", "bias", "cls", "word", "cls_bias", "word_bias"):
        x, g = getattr(net, name), getattr(grad, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = x[at], 1e-2
        x[at] = old + h
        up = net.passes(around, target).astype(float).mean()
        x[at] = old - h
        down = net.passes(around, target).astype(float).mean()
        x[at] = old
        assert abs(-(up - down) / (2 * h) - g[at]) < 0.02 * abs(g[at]) + 1e-5, name


def test_windows():
    around, target = windows([np.array([1, 2, 3]), np.array([7])])
    v = s.VOCABULARY + 1
    assert target.tolist() == [1, 2, 3, 7]
    assert (around.T - np.arange(4) * v).tolist() == [[s.PAD, s.PAD, 2, 3], [s.PAD, 1, 3, s.PAD], [1, 2, s.PAD, s.PAD], [s.PAD] * 4]


def fitted(docs, block_chars):
    blocks = s.materialize(s.encode_blocks(docs, block_chars=block_chars), "blocks")
    places = s.materialize(s.form_places(blocks), "forms")
    vocabulary, freq = s.build_vocabulary(places, blocks)
    net = s.train(blocks, vocabulary, freq)
    return vocabulary, freq, net, s.score_blocks(blocks, places, vocabulary, net)


def plain(texts, vocabulary, net):
    """Sums by loops over words, from the counts of all texts and the parameters of the network."""
    words = [[w.lower() for w in re.findall(r"\w+", t or "")] for t in texts]
    count = Counter(w for ws in words for w in ws)
    key = {w: int(k) for w, k in zip(count, s.form_keys(pa.array(list(count), pa.string())))}
    assert len(set(key.values())) == len(count)
    order = sorted(count, key=lambda w: (-count[w], key[w]))
    ids = {w: i for i, w in enumerate(order[: s.VOCABULARY - s.SIZE])}
    rare = order[len(ids) :]
    n_rare, once = sum(count[w] for w in rare), sum(count[w] == 1 for w in rare)
    slot = lambda w: ids[w] if w in ids else s.VOCABULARY - s.SIZE + key[w] % s.SIZE
    flat = lambda x: np.asarray(x, float)
    out = []
    for ws in words:
        total = 0.0
        for i, w in enumerate(ws):
            h = flat(net.bias).copy()
            for place, j in enumerate((i - 2, i - 1, i + 1, i + 2)):
                h += flat(net.near)[place * (s.VOCABULARY + 1) + (slot(ws[j]) if 0 <= j < len(ws) else s.VOCABULARY)]
            h = np.tanh(h)
            c, k = divmod(slot(w), s.SIZE)
            for z, goal in ((flat(net.cls) @ h + flat(net.cls_bias), c), (flat(net.word)[c] @ h + flat(net.word_bias)[c], k)):
                total += z[goal] - math.log(np.exp(z).sum())
            if w not in ids:
                letters = math.exp(sum(vocabulary.spelling.get(x, vocabulary.spelling[""]) for x in w) + vocabulary.spelling[""])
                total += math.log((count[w] - 1 + max(1, once) * letters) / (n_rare - 1 + max(1, once))) + math.log(s.SIZE)
        out.append((len(ws), sum(w not in ids and count[w] == 1 for w in ws), total))
    return out


def test_plain_loops(spark):
    rng = random.Random(5)
    forms = ["".join(rng.choice("abcdeéİ") for _ in range(rng.randint(1, 5))) for _ in range(4000)]
    texts = [" ".join(rng.choice(forms[: rng.choice([20, 300, 4000])]) for _ in range(rng.choice([0, 1, 3, 40, 200]))) for _ in range(220)] + [None, "", "...", "only Once", "HER her Her"]
    texts += texts[:3]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, block int, forms string").repartition(3)
    vocabulary, freq, net, scored = fitted(df, 1500)
    rows = {r["doc_id"]: r for r in scored.collect()}
    assert len(rows) == len(texts) and vocabulary.last is not None
    want = plain(texts, vocabulary, net)
    assert abs(freq.sum() - s.VOCABULARY - sum(n for n, _, _ in want)) < 1e-6
    for i, (n, alone, total) in enumerate(want):
        assert (rows[i]["n_words"], rows[i]["n_alone"]) == (n, alone)
        assert abs(rows[i]["log_prob"] - total) < 1e-4 * max(1.0, abs(total))
        assert (rows[i]["mean_log_prob"] is None) == (n == 0)
    assert all(rows[i]["log_prob"] == rows[len(texts) - 3 + i]["log_prob"] or abs(rows[i]["log_prob"] - rows[len(texts) - 3 + i]["log_prob"]) < 1e-3 for i in range(3))


def test_order_matters(spark):
    rng = random.Random(3)
    cycle = "red green blue white black brown pink grey".split()
    line = lambda n: " ".join(cycle[i % 8] for i in range(n))
    docs = [(i, line(80)) for i in range(400)]
    mixed = docs[0][1].split()
    rng.shuffle(mixed)
    probe = [(1000, docs[0][1], 1.0), (1001, " ".join(mixed), 1.0), (1002, None, 1.0), (1003, "...", 1.0), (1005, "red green " * 30_000, 1.0), (None, "red", 1.0)]
    df = spark.createDataFrame([(*d, 1.0) for d in docs] + probe + probe[:1], "doc_id long, text string, log_prob double")
    rows = s.pseudo_likelihood(df).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) + 7 and by[None]["n_words"] == 1
    assert by[1000]["mean_log_prob"] > by[1001]["mean_log_prob"] + 1.0
    assert by[1002]["n_words"] == 0 and by[1002]["log_prob"] == 0 and by[1002]["mean_log_prob"] is None and by[1003]["n_words"] == 0
    assert by[1005]["n_words"] == 60_000
    assert s.pseudo_likelihood(df.limit(0)).count() == 0


def test_a_second_copy_tells(spark):
    """What the corpus holds elsewhere makes a document likelier: of two alike but for their words, the one with a copy."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = [" ".join(word() for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")
    by = {r["doc_id"]: r for r in s.pseudo_likelihood(df).collect()}
    copied, single = [by[i]["mean_log_prob"] for i in range(20)], [by[i]["mean_log_prob"] for i in range(20, 200)]
    assert min(copied) > max(single) and all(by[i]["n_alone"] < by[100]["n_alone"] for i in range(20))
