import random

import pytest
import sentencepiece

from marginwise.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "  ", "a", "a ", "  a  b ", "a\nb\t c", "▁", "a▁b", "▁▁a", "x▁ ▁ y", "é 漢字 😀", "\x00a", "<s> <unk> <0x41>", "a" * 3000, "ﬁ ſ"]


@pytest.fixture(scope="module")
def model():
    with open(pieces.default_model(), "rb") as file:
        return file.read()


def random_texts(letters, n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(n)]


def test_ids_equal_the_library(model):
    own, library = pieces.Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ODD + random_texts("ab ▁\n\té漢the0 <>s/", 500, 1)
    for text, (ids, begins, ends) in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text)
        assert begins[1:].tolist() == ends[:-1].tolist()
        if len(ids):
            assert begins[0] == 0 and ends[-1] == len(text.encode())
    assert [x.tolist() for x in own.ids(texts)] == [library.encode(t) for t in texts]


def test_cache_is_forgotten(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CHARS", 5)
    own, library = pieces.Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in ["some words here", "other words there", "some words here"]:
        assert own.ids([text])[0].tolist() == library.encode(text)


def test_whole_text_encoding(model):
    own, library = pieces.Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    own.by_word = False
    assert [x.tolist() for x in own.ids(ODD)] == [library.encode(t) for t in ODD]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normaliser_equals_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = next(dict(pieces.fields(v)) for k, v in pieces.fields(library.serialized_model_proto()) if k == 3)
    own = pieces.Normalizer(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
    for text in ["ﬁ  x ", "①２ A", "㌀ a　 d", "", "   ", *random_texts("ab \tﬁ①２ＡＢ㌀㍿½é́　​漢", 400, 2)]:
        data, source = own(text.encode())
        assert data.decode() == library.normalize(text)
        assert len(source) == len(data) + 1 and all(x <= y for x, y in zip(source, source[1:]))


def test_frame(odd_docs, no_docs, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    found = pieces.encode(odd_docs, pieces.default_model())
    assert found.columns == [c for c in odd_docs.columns if c != "ids"] + ["ids", "begins", "ends", "decoded"]
    for row in found.collect():
        ids = library.encode(row["text"] or "")
        assert row["ids"] == ids and row["decoded"] == library.decode(ids)
    assert pieces.encode(no_docs, pieces.default_model()).count() == 0
