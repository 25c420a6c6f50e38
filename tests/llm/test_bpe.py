import hashlib
import unicodedata
from array import array

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from txloom.llm import bpe

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
TEXTS = [
    "", " ", "The quick brown fox, it's 42!", "a  b\n \n  c\t", "ΑΣ Σ ς İstanbul ﬁ", "e\u0301 x\u0301", "\x1cx\x1d y\x85z\u3000w", "<|endoftext|>", "x<|endoftext|> y<|startoftext|>z",
    "日本語 ½ ² １２", "😀😀 ok", "don't we'll I'M", "a" * 5000, "ab" * 3000, "word " * 3000, "\u200b\ufeff", "it 's", "'s", "..." * 40, "a\nb\r\nc",
]


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    spec = bpe.read_spec(P.path(request.param))
    return Library.from_file(P.path(request.param)), bpe.Tokenizer(spec)


def same(library, own, texts):
    for text, ids in zip(texts, own.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == want, ascii(text)[:80]
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_equals_the_library(both):
    same(*both, TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdeinorst'’éßΣİ\u0301 \n\t\x1c\xa0²¾_.,!?😀日"), max_size=40), max_size=5))
def test_equals_the_library_on_odd_texts(both, texts):
    same(*both, texts)


def test_table_starts_anew_without_changing_results(both, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE", 20)
    monkeypatch.setattr(bpe, "STEPS", 50)
    library, own = both
    for i in range(10):
        same(library, own, [" ".join(f"w{i}x{j} plain{j}" for j in range(30))])


def test_operator(spark):
    spec = bpe.read_spec(P.path(NAMES[0]))
    library = Library.from_file(P.path(NAMES[0]))
    rows = [(1, None, "x"), (2, "", "x"), (2, "Repeated row", "x"), (2, "Repeated row", "x"), (None, "no id", "x"), (3, "long " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "decoded")
    got = bpe.encode(docs, spec).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t or "" for i, t, _ in rows if i == r["doc_id"]]
        assert bytes(r["ids"]) in [array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    again = bpe.decode(bpe.encode(docs, spec).drop("decoded"), spec).collect()
    assert sorted(r["decoded"] for r in again) == sorted(r["decoded"] for r in got)
    assert bpe.encode(docs.limit(0), spec).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "Hello <|endoftext|> wörld"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    library = Library.from_file(P.path(NAMES[0]))
    for r in bpe.op1_bpe(spark, str(tmp_path)).collect():
        ids = library.encode({1: "Hello <|endoftext|> wörld"}.get(r["doc_id"], ""), add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_code_point_is_that_of_the_library(both):
    """Letters, numbers, case and composition of all characters, whatever version of Unicode Python knows."""
    library, own = both
    points = [*range(0xD800), *range(0xE000, bpe.PLANES), *range(bpe.PLANES, 0x110000, 997)]
    texts = [" ".join(f"a{chr(k)}b {chr(k)}" for k in points[i : i + 40]) for i in range(0, len(points), 40)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_batch(texts)] == want


def test_chunks_are_composed_and_spelt_together(monkeypatch):
    """Chunks that are not ASCII share one call a batch; those with characters that Python does not know go by themselves."""
    name = P.path(NAMES[0])
    library, own = Library.from_file(name), bpe.Tokenizer(bpe.read_spec(name))
    calls = []

    class Counted:
        category = staticmethod(bpe.unicodedata.category)

        @staticmethod
        def normalize(form, text):
            calls.append(text)
            return unicodedata.normalize(form, text)

    monkeypatch.setattr(bpe, "unicodedata", Counted)
    texts = [" ".join(f"ÉÉ{chr(0x4E00 + k)}Σ's{k} ́x{k}́ É\x01{k}- a\x01b{k}" for k in range(i, i + 50)) for i in (0, 50)]
    same(library, own, texts)
    assert len(calls) == 1
    new = next(chr(k) for k in range(0x2FFFF, 0, -1) if bpe._unknown().match(chr(k)))
    same(library, own, [f"ñandú{new}Σ ÀΣ é{new} ÀB c'est’s", new])
