import re

import pytest
from pyspark.sql import functions as F

from marginwise.llm import decontaminate


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items):
    words, hit, names = words_of(text), set(), set()
    for item, item_text in items:
        own = words_of(item_text)
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i + 1, i + 1 + size))
                names.add(item)
    return len(words), sorted(hit), names


PASSAGE = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen ÉCOLE"
ITEMS = [(1, PASSAGE), (2, "short item"), (3, None), (4, "..."), (5, "one two; THREE four five six seven eight nine ten eleven twelve thirteen"), (6, "école fin")]
TEXTS = [
    (1, f"before {PASSAGE.lower()} after"),
    (2, "one-two three. four five six seven eight nine ten eleven twelve thirteen!"),
    (3, "a short item and SHORT ITEM item"),
    (4, None),
    (5, ""),
    (6, "nothing here"),
    (7, "ÉCOLE fin and école FIN"),
    (None, "short item"),
    (8, "short item " + "w " * 100),
    (8, "short item " + "w " * 100),
]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id int, text string")


@pytest.mark.parametrize("set_rows", [2, 1_000_000])
def test_hits(frames, set_rows):
    docs, items = frames
    found = {(r["id"]): r for r in decontaminate.hits(docs, items, set_rows=set_rows).collect()}
    assert len(found) == len(set(TEXTS))
    for key, text in TEXTS:
        n, hit, names = brute(text, ITEMS)
        row = found[key]
        assert (row["n_words"], row["positions"], set(row["items"])) == (n, hit, names)
        assert row["copies"] == TEXTS.count((key, text))


def test_report_and_removal(frames):
    docs, items = frames
    rows = decontaminate.report(docs, items).collect()
    assert len(rows) == len(TEXTS)
    bad = {r["id"] for r in rows if r["contaminated"]}
    assert bad == {k for k, t in TEXTS if brute(t, ITEMS)[1] and 20 * len(brute(t, ITEMS)[1]) >= brute(t, ITEMS)[0]}
    left = decontaminate.remove_documents(docs, items).collect()
    assert sorted((r["doc_id"] for r in left if r["doc_id"] is not None)) == [4, 5, 6, 8, 8]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut[3] == "a and item" and cut[6] == "nothing here" and cut[4] is None
    assert cut[8] == " w" * 100 + " "


def test_no_items_and_odd_documents(odd_docs, no_docs, frames):
    _, items = frames
    rows = decontaminate.report(odd_docs, items.limit(0)).collect()
    assert len(rows) == 10 and not any(r["contaminated"] for r in rows)
    assert decontaminate.remove_documents(odd_docs, items).columns == odd_docs.columns
    assert decontaminate.report(no_docs, items).count() == 0


def test_columns_with_clashing_names(frames):
    docs, items = frames
    extra = docs
    for k, c in enumerate(["_bad_at", "_bad_id", "_bad_hash", "_bad_parts", "_m0_at", "positions"]):
        extra = extra.withColumn(c, F.lit(k))
    for change in (decontaminate.remove_spans, decontaminate.remove_documents):
        found = change(extra, items)
        assert found.columns == extra.columns and {r["_bad_at"] for r in found.collect()} == {0}
        assert sorted(map(str, found.select("doc_id", "text").collect())) == sorted(map(str, change(docs, items).collect()))
