import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginwise.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, rate=50, spm_rate=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    word = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(word[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < spm_rate:
        return doc_id, n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return doc_id, n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def key(row):
    return tuple((v is None, v) for v in row)


def random_text(rng, words):
    letters = list("abcdefghij") + ["é", "中", "\U0001f600", " ", "<", "\\"]
    spaces = [" ", "  ", "\n", "\t\r", "\x0b \x0c"]
    parts = ["".join(rng.choice(letters, rng.integers(1, 30))) + rng.choice(spaces) for _ in range(words)]
    return rng.choice(["", " ", "\n\n"]) + "".join(parts) + rng.choice(["", "end", "\x0d"])


def ends_by_tokens(text):
    ends, at = [0], 0
    for t in TOKEN.findall(text):
        at += len(t.encode())
        ends.append(at)
    return ends


def check_document(text, chunks):
    data = text.encode()
    ends = fim.chunk_ends(data)
    assert b"".join(data[a:b] for a, b in zip([0, *ends], ends)) == data
    for a, b in zip([0, *ends], ends):
        data[a:b].decode()
        assert 0 < b - a <= fim.MOST + fim.LEAST
    doc = fim.Document(data, chunks)
    expected = ends_by_tokens(text)
    assert doc.tokens == len(expected) - 1
    assert [doc.end_of(k) for k in range(doc.tokens + 1)] == expected


def test_every_cut_of_long_texts():
    rng, chunks = np.random.default_rng(5), fim.Chunks()
    for words in (1, 3, 40, 700):
        for _ in range(6):
            check_document(random_text(rng, words), chunks)
    for text in ("x" * 30_000, " " * 30_000, "word " * 6_000, "é" * 9_000 + " ", "\n" + "ab" * 8_000 + "\t" * 9_000 + "c"):
        check_document(text, chunks)


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n é", max_size=60))
def test_every_cut_of_short_texts(text):
    check_document(text, fim.Chunks())


def test_chunks_follow_the_content():
    """A passage gives the same chunks at other places, and they are looked up instead of counted."""
    rng = np.random.default_rng(6)
    passage = random_text(rng, 3_000)
    chunks = fim.Chunks()
    fim.Document(passage.encode(), chunks)
    once = chunks.asked
    assert once > 20 and chunks.hits < once / 10
    for k in range(5):
        fim.Document((random_text(rng, 20 + k) + passage + random_text(rng, 9)).encode(), chunks)
    assert chunks.hits > 4.5 * once


def test_small_cache_changes_nothing():
    text = random_text(np.random.default_rng(7), 2_000) * 2
    small, large = fim.Chunks(limit=1), fim.Chunks()
    a, b = fim.Document(text.encode(), small), fim.Document(text.encode(), large)
    assert a.started == b.started and len(small.known) <= 2


def test_against_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [random_text(rng, int(rng.integers(0, 60))) for _ in range(300)]
    texts += ["", None, " ", "a", "<P> b c", "x <S>", "<", "<M", "a <P", ">S> b", "one two", "long " * 40_000, "y" * 200_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b c d"), (None, None), (5, texts[5]), (-7, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted([tuple(r)[:6] for r in found], key=key) == sorted([brute(*r) for r in rows], key=key)
    original = {(i, t or "") for i, t in rows}
    assert {(r["id"], r["back"]) for r in found} == original
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}


def test_markers_never_arise_across_parts(spark):
    texts = ["a < < < S> P> M>", "<P <S <M S> < < P", "<< <<P >P> <S", "< P><S ><M> "] * 30
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fim.fill_in_middle(docs, rate=100, spm_rate=50).select("id", fim.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(map(tuple, found.collect())) == rows


def test_odd_documents(spark, odd_docs, no_docs):
    found = [tuple(r) for r in fim.fill_in_middle(odd_docs).collect()]
    assert sorted(found, key=key) == sorted([brute(r["doc_id"], r["text"]) for r in odd_docs.collect()], key=key)
    clash = odd_docs.withColumn("h1", F.lit("x")).withColumn("id", F.lit(1)).withColumn("form", F.lit(2))
    assert sorted([tuple(r) for r in fim.fill_in_middle(clash).collect()], key=key) == sorted(found, key=key)
    assert fim.fill_in_middle(no_docs).count() == 0
