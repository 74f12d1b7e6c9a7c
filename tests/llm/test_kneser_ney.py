"""The distributed model against a plain recursive one, and edge cases of the classifier."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from wardspark.llm import kneser_ney as kn


class Plain:
    """Modified Kneser-Ney by its definition."""

    def __init__(self, texts, order):
        self.order = order
        self.c = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
        for k in range(order - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.total, self.mass = {}, {}, {}
        for k, c in self.c.items():
            n = Counter(c.values())
            if n[1] and n[2] and n[3] and n[4]:
                y = n[1] / (n[1] + 2 * n[2])
                d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
                self.d[k] = [min(max(x, 0.01), i - 0.01 * (i == 1)) for i, x in enumerate(d, 1)]
            else:
                self.d[k] = [0.5, 1.0, 1.5]
            self.total[k], self.mass[k] = Counter(), defaultdict(float)
            for g, x in c.items():
                self.total[k][g[:-1]] += x
                self.mass[k][g[:-1]] += self.d[k][min(x, 3) - 1]

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.c[1]) + 1)
        context, x = gram[:-1], self.c[k][gram]
        below = self.p(gram[1:])
        if not self.total[k][context]:
            return below
        own = (x - self.d[k][min(x, 3) - 1]) / self.total[k][context] if x else 0.0
        return own + self.mass[k][context] / self.total[k][context] * below


def _texts(seed, n, alphabet="abcdé "):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_scores_match_the_definition(spark):
    train, test = _texts(1, 40), [*_texts(2, 20), "", "ab", "zzzz unknown \x00 €", "abcdé" * 50]
    model = kn.train(spark.createDataFrame([(t,) for t in train], "text string"), 4)
    docs = spark.createDataFrame(list(enumerate(test)), "doc_id long, text string")
    plain = Plain(train, 4)
    for shard_bytes in (1 << 20, 4096):  # one shard, then several
        got = {r.doc_id: r for r in kn.score(docs, model, 4, shard_bytes).collect()}
        for i, t in enumerate(test):
            t = t.replace("\x00", "�")
            want = sum(math.log(plain.p(t[j - 3 : j + 1])) for j in range(3, len(t)))
            assert got[i].predicted == max(0, len(t) - 3)
            assert abs(got[i].logp - want) < 1e-3 * max(1, abs(want))


def test_probabilities_sum_to_one(spark):
    train = _texts(3, 30)
    model = {r.gram: r for r in kn.train(spark.createDataFrame([(t,) for t in train], "text string"), 3).collect()}
    ones = sum(math.exp(r.logp) for g, r in model.items() if len(g) == 1 and r.logp is not None)
    assert abs(ones + math.exp(model[""].logp) - 1) < 1e-9


def test_long_texts_are_scored_in_pieces(monkeypatch, spark):
    model = kn.train(spark.createDataFrame([(t,) for t in _texts(4, 30)], "text string"), 3)
    rows = model.where("gram <> ''").mapInArrow(kn._hashed, "key long, logp double, backoff double").toPandas()
    table = kn._Table(rows.key.to_numpy().view(np.uint64), np.nan_to_num(rows.logp.to_numpy("float32"), nan=kn.CONTEXT_ONLY), rows.backoff.to_numpy("float32"))
    text = "".join(_texts(5, 50))
    whole = kn.log_probabilities(kn.code_points(text), table, 3, -5.0)
    pieces = [kn.log_probabilities(kn.code_points(text[a : a + 100 + 2]), table, 3, -5.0) for a in range(0, len(text) - 2, 100)]
    assert np.allclose(whole, np.concatenate(pieces))


def test_classifier_edge_cases(spark):
    good = [(i, t + "abc", None if i % 7 == 0 else "xx", "extra") for i, t in enumerate(_texts(6, 60, "ab c"))]
    odd = [(100, None, "xx", ""), (101, "", "xx", ""), (102, "QQ%%#@!" * 20, "xx", ""), (103, "ab", "yy", ""), (None, "abc abc", "xx", ""), (1, "abcab", "xx", "")]
    docs = spark.createDataFrame([*good, *odd], "doc_id long, text string, lang string, n string")
    trusted = spark.range(60).select(F.col("id").alias("doc_id"))
    got = {r.doc_id: r for r in kn.classify(docs, trusted).collect()}
    assert set(got) == {*range(60), 100, 101, 102, 103}
    assert not got[100].kept and got[100].perplexity is None and not got[101].kept and got[103].kept
    assert not got[102].kept and got[102].perplexity > got[102].threshold
    assert kn.classify(docs.limit(0), trusted).count() == 0
    assert kn.classify(docs, trusted.limit(0)).where("perplexity is not null").count() == 0
