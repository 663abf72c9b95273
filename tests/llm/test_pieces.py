"""SentencePiece operator against an undivided search, the library's own best-path mode, and its round trip."""

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from thicket.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "Hello  world", "a" * 700, "the quick brown fox " * 60, "日本語のテキスト" * 40, "x\n\ny\n  z", "▁ literal ▁", "tab\tand\x00nul", "é" * 90 + " " * 70, None, "  lead and trail  ", "x\uffffy", "\uffff ▁\ufffe " * 40]


def encoded(spark, texts, **options):
    docs = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    return pieces.decode_documents(pieces.encode_documents(docs, MODEL, **options), MODEL).orderBy("doc_id").collect()


def test_chunks_change_nothing_and_round_trip(spark):
    whole, chunked = encoded(spark, TEXTS), encoded(spark, TEXTS, chunk_chars=64)
    assert [r.text for r in whole] == TEXTS == [r.decoded for r in whole]
    assert [list(r) for r in whole] == [list(r) for r in chunked]
    assert whole[0].ids == [] and whole[10].ids is None


def test_no_rows(spark):
    assert encoded(spark, []) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab the\n▁\ufffftionzé", max_size=150), st.integers(20, 40))
def test_chunk_functions_equal_one_search(text, size):
    words = pieces.vocabulary(MODEL)
    marked = pieces.marked(text)
    if not marked:
        return
    whole, _ = words.trace(marked, words.forward(marked, [0.0], len(marked))[1], len(marked))
    parts = [(marked[i : i + size], marked[i + size : i + size + 64]) for i in range(0, len(marked), size)]
    vector, entries = [0.0] + [pieces.LOW] * (words.longest - 1), []
    for body, ahead in parts:
        entries.append(vector)
        m = pieces._matrix(words, body, ahead)
        vector = [max(vector[s] + m[s * words.longest + t] for s in range(words.longest)) for t in range(words.longest)]
    state, out = 0, []
    for (body, ahead), entry in zip(reversed(parts), reversed(entries)):
        out.insert(0, pieces._part(words, body, ahead, entry, state))
        state = pieces._entered(words, body, ahead, entry)[state]
    assert [i for ids in out for i in ids] == whole
    assert words.encode(text) == np.array(whole, "<i4").tobytes()


def test_equals_library_best_path():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    library = sentencepiece.SentencePieceProcessor()
    library.LoadFromSerializedProto(proto.SerializeToString())
    words = pieces.vocabulary(MODEL)
    for text in ["The quick brown fox jumps", "Thntblere of then edtioner in inea", "international cooperation", "Größe und Länge"]:
        ids = [i for w in words.word.findall(pieces.marked(text)) for i in words.trace(w, words.forward(w, [0.0], len(w))[1], len(w))[0]]
        assert ids == library.encode(text)
