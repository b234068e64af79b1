"""The registered queries on the smallest tables, against DuckDB or a plain Python form."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from compare import difference, duck
from test_decontaminate import brute as brute_hits
from test_secrets import naive as naive_secrets
from test_simhash import naive_fingerprint
from test_warc import expected as expected_records

import __spark_entry__ as entry
from marginwise.llm import pieces, queries, simhash

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(spark, name):
    return entry.queries()[name](spark, SMALL).collect()


def test_operators_and_the_pipeline_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, len(numbers) + 1)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_against_duckdb(spark, name):
    assert difference(spark, duck(SMALL), queries.QUERIES[name], queries.ORACLES[name], SMALL) is None


def test_op1(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    found = {r["doc_id"]: r["n_tokens"] for r in rows_of(spark, "op1_token_counts")}
    assert found == {i: len(library.encode(t)) for i, t in docs}


def test_op2(spark, docs):
    names = ("assign", "access", "hex")
    found = {r["doc_id"]: r for r in rows_of(spark, "op2_secret_scans")}
    for i, text in docs:
        base = naive_secrets(text)
        row = found[i]
        listed = [f"{names[k]}:{s}:{e}" for s, k, e in base]
        assert [row[f"n_{n}"] for n in names] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert row["base_sha256"] == sha(",".join(listed)) and set(listed) <= set(row["spans"].split(",") if row["spans"] else [])


def test_op3(spark, docs):
    rows = rows_of(spark, "op3_lm_scoring")
    assert len(rows) == len(docs)
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    assert all(r["score"] < 0 for r in rows)


def test_op4(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in rows_of(spark, "op4_warc")]
    assert sorted(got, key=str) == expected_records(pages)


def test_op5(spark, docs):
    rows = rows_of(spark, "op5_fuzzy_line_dedup")
    lines = {(i, k): x for i, t in docs for k, x in enumerate(t.split("\n")) if x.strip()}
    assert {(r["doc_id"], r["line_no"]) for r in rows} == lines.keys()
    by_text, by_component = defaultdict(set), defaultdict(list)
    for r in rows:
        by_text[lines[r["doc_id"], r["line_no"]]].add(r["component"])
        by_component[r["component"]].append(r)
    assert all(len(c) == 1 for c in by_text.values())
    assert all(sum(r["kept"] for r in group) == 1 for group in by_component.values())


def test_op6_positions(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    found = {r["doc_id"]: r for r in rows_of(spark, "op6_benchmark_decontamination")}
    for i, text in docs[:60]:
        n, hit, names = brute_hits(text, items)
        assert (found[i]["n_words"], found[i]["n_hit"], found[i]["n_items"]) == (n, len(hit), len(names))


def test_op7(spark, docs):
    values = np.array([naive_fingerprint(t) for _, t in docs], dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    root = simhash.roots_of(a, b, len(values))
    least = {r: min(docs[k][0] for k in np.flatnonzero(root == r)) for r in set(root.tolist())}
    want = {(i, f"{int(v):016x}", least[int(r)]) for (i, _), v, r in zip(docs, values, root)}
    assert {tuple(r) for r in rows_of(spark, "op7_simhash_near_dedup")} == want


def test_op9(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    found = {r["doc_id"]: r for r in rows_of(spark, "op9_sentencepiece_encoding_and_decoding")}
    for i, text in docs:
        ids = library.encode(text)
        row = found[i]
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_op10(spark):
    import html

    found = {r["page_id"]: r["text"] for r in rows_of(spark, "op10_html_extraction")}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert found[r["page_id"]].split() == " ".join(b for b in blocks if b).split()
