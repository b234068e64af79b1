import numpy as np
import pytest
import sentencepiece

from marginwise.llm import pieces, tokens
from marginwise.session import scratch_table, stored

pytest.importorskip("public_tokenizers")


def expected(ids, separator=2):
    """(ordinal, begin, n_tokens, ended) by a plain loop."""
    found, begin = [], 0
    for at, token in enumerate(ids):
        if token == separator:
            found.append((len(found), begin, at - begin, True))
            begin = at + 1
    return found + ([(len(found), begin, len(ids) - begin, False)] if begin < len(ids) else [])


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(7)
    streams = {
        "a": rng.choice([2, 5, 6, 7], 100, p=[0.2, 0.3, 0.3, 0.2]), "b": np.array([5] * 40 + [2]), "c": np.array([2, 2, 2]),
        "d": np.array([9] * 25), "e": np.array([], int), "f": np.array([2]), "g": np.array([1, 2] * 9 + [3]),
    }
    for name, ids in streams.items():
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
    rows = tokens.scan(tokens.list_files(spark, str(tmp_path)), block_tokens=block).collect()
    for name, ids in streams.items():
        own = sorted((r["ordinal"], r["begin"], r["n_tokens"], r["ended"]) for r in rows if r["path"].endswith(f"/{name}"))
        assert own == expected(ids.tolist())


def test_written_files_come_back(spark, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    folder = scratch_table(spark, "tokens-test")
    written = stored(tokens.write_token_files(odd_docs, folder, pieces.default_model()), "manifest-test")
    found = {(r["path"].split("/")[-1], r["ordinal"]): r for r in tokens.scan(tokens.list_files(spark, folder)).collect()}
    rows = written.collect()
    assert len(rows) == len(found) == 10
    counts = sorted((str(r["id"]), found[r["path"].split("/")[-1], r["ordinal"]]["n_tokens"]) for r in rows)
    assert counts == sorted((str(r["doc_id"]), len(library.encode(r["text"] or ""))) for r in odd_docs.collect())
    assert all(r["ended"] for r in found.values())
    assert tokens.write_token_files(no_docs, folder, pieces.default_model()).count() == 0
