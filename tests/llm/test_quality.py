import re

import pytest
from pyspark.sql import functions as F

from marginwise.llm import quality

NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit.update(p + k for p in places for k in range(5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit))


def rejected(n, chars, symbols, lines, dup, repeat):
    return (
        n < 10 or 100 * repeat > 20 * n or 10 * symbols > n or (dup >= 3 and 10 * dup > 3 * lines) or chars < 2 * n or chars > 15 * n
    )


def test_statistics_and_verdict(odd_docs):
    order = list(quality.RULES)
    rows = quality.judged(odd_docs, NAMES, order=order).collect()
    assert len(rows) == 10
    for row in rows:
        want = brute(row["text"])
        assert tuple(row[n] for n in NAMES) == want
        assert (row["rejected_by"] is not None) == rejected(*want)


@pytest.mark.parametrize("reverse", [False, True])
def test_cascade_agrees_in_any_order(odd_docs, reverse):
    order = list(reversed(quality.RULES)) if reverse else list(quality.RULES)
    found = quality.cascade(odd_docs, order=order)
    assert found.columns == [c for c in odd_docs.columns if c != "rejected_by"] + ["rejected_by"]
    for row in found.collect():
        assert (row["rejected_by"] is not None) == rejected(*brute(row["text"]))
    # A filter behind the cascade must not change or hang it.
    kept = found.where(F.col("rejected_by").isNull()).count()
    assert kept == sum(not rejected(*brute(r["text"])) for r in odd_docs.collect())


def test_measured_order_and_empty_table(odd_docs, no_docs):
    assert sorted(r.name for r in quality.rule_order(odd_docs)) == sorted(r.name for r in quality.RULES)
    assert quality.cascade(no_docs).count() == 0
