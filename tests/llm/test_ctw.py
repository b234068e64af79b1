import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginwise.llm import ctw

TRAIN = ["abracadabra abra", "Abra cadabra", "", "é è abracadabra", None]
TEST = ["abra", "zebra", "", None, "abracadabra é", "\x00\t x"]


def plain_kt(a, b):
    total = 0.0
    for k in range(a):
        total += math.log((k + 0.5) / (k + 1))
    for k in range(b):
        total += math.log((k + 0.5) / (a + k + 1))
    return total


class PlainTree:
    """The textbook recursion on dictionaries, a node per context and bit prefix."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for text in texts:
            for context, prefix, bit in self.bits(text):
                for d in range(depth + 1):
                    self.counts[context[:d], prefix][bit] += 1
        self.memo = {}

    def bits(self, text):
        data = b"\xff" * self.depth + ctw.lowered(text) + b"\xff"
        for at in range(self.depth, len(data)):
            context = bytes(reversed(data[at - self.depth : at]))
            for k in range(8):
                yield context, (k, data[at] >> (8 - k)), data[at] >> (7 - k) & 1

    def mixture(self, context, prefix):
        if (context, prefix) not in self.memo:
            own = plain_kt(*self.counts.get((context, prefix), (0, 0)))
            value = own
            if len(context) < self.depth:
                children = sum(
                    self.mixture(context + bytes([c]), prefix) for c in range(256) if (context + bytes([c]), prefix) in self.counts
                )
                value = math.log(0.5) + np.logaddexp(own, children)
            self.memo[context, prefix] = value
        return self.memo[context, prefix]

    def one(self, context, prefix, d=0):
        a, b = self.counts.get((context[:d], prefix), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        stop = math.exp(math.log(0.5) + plain_kt(a, b) - self.mixture(context[:d], prefix))
        return stop * own + (1 - stop) * self.one(context, prefix, d + 1)

    def score(self, text):
        total = 0.0
        for context, prefix, bit in self.bits(text):
            p = self.one(context, prefix)
            total += math.log10(p if bit else 1 - p)
        return total


@pytest.mark.parametrize("depth", [3, 5])
@pytest.mark.parametrize("cells", [10, 16_000_000])
def test_scores_against_the_textbook(spark, monkeypatch, depth, cells):
    monkeypatch.setattr(ctw, "TABLE_CELLS", cells)
    rows = [(k, t, True) for k, t in enumerate(TRAIN)] + [(100 + k, t, False) for k, t in enumerate(TEST)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, block boolean").repartition(3)
    found = {r["id"]: r for r in ctw.score(docs, F.col("block"), depth=depth).collect()}
    assert len(found) == len(rows)
    tree = PlainTree(TRAIN, depth)
    words = defaultdict(int)
    for t in TRAIN:
        for w in ctw.lowered(t).split():
            words[w] += 1
    n, v = sum(words.values()) + len(TRAIN), len(words) + 1
    for key, text, train in rows:
        row, own = found[key], ctw.lowered(text).split()
        assert row["score"] == pytest.approx(tree.score(text), rel=1e-9)
        base = sum(math.log10((words.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in own) + math.log10((len(TRAIN) + 0.5) / (n + 0.5 * (v + 1)))
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (not train, len(own) + 1, n)
        assert row["n_known"] == 1 + sum(w in words for w in own)


def test_values_of_all_bytes_sum_to_one():
    """The model is a distribution over the next byte, also behind contexts never seen."""
    tree = PlainTree(["abab", "abc"], 2)
    for context in (b"\xff\xff", b"ba", b"zz"):
        total = 0.0
        for byte in range(256):
            p = 1.0
            for k in range(8):
                one = tree.one(context, (k, byte >> (8 - k)))
                p *= one if byte >> (7 - k) & 1 else 1 - one
            total += p
        assert total == pytest.approx(1.0)


def test_log_kt():
    for a, b in [(0, 0), (1, 0), (0, 3), (7, 2), (40, 90)]:
        assert ctw.log_kt(np.array([float(a)]), np.array([float(b)]))[0] == pytest.approx(plain_kt(a, b), abs=1e-10)


def test_odd_documents(odd_docs, no_docs):
    assert ctw.score(odd_docs, F.col("doc_id") > 3).count() == 10
    untrained = ctw.score(odd_docs, F.lit(False)).collect()
    assert all(r["score"] == pytest.approx(-8 * math.log10(2) * (len(ctw.lowered(t["text"])) + 1)) for r, t in
               zip(sorted(untrained, key=lambda r: r["score"]), sorted(odd_docs.collect(), key=lambda r: -len(ctw.lowered(r["text"])))))
    assert ctw.score(no_docs, F.lit(True)).count() == 0
