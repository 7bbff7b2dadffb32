import random

import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tempograin.llm import sentencepieces as sp


def texts():
    rng = random.Random(3)
    alphabet = " \n\tabcdefghijéß漢🙂aeiou   .,0123▁"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return [*out, *[" " * n for n in range(40)], *["a" * n for n in range(40)],
            *[" " * n + "the" + " " * m + "x" for n in range(12) for m in range(12)]]


def test_encoder_equals_the_library(small_documents):
    model = sp._read(sp.MODEL_PATH)
    ours, library = sp.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    every = [*texts(), *[t for _, t, _ in small_documents]]
    want = library.encode(every)
    assert [x.tolist() for x in ours.encode(every)] == want
    assert [ours.decode(x) for x in want] == [library.decode(x) for x in want]


def test_unigram_equals_the_library(small_documents):
    """The same pieces as a unigram model, with scores that add up exactly."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sp._read(sp.MODEL_PATH))
    proto.trainer_spec.model_type = sp.UNIGRAM
    rng = random.Random(1)
    for p in proto.pieces:
        if p.type == sp.NORMAL:
            p.score = -rng.randint(1 << 8, 1 << 14) / 1024
    model = proto.SerializeToString()
    ours, library = sp.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    every = [t for _, t, _ in small_documents if len(t) < 5000]
    assert [x.tolist() for x in ours.encode(every)] == library.encode(every)


def test_small_cache_gives_the_same(small_documents, monkeypatch):
    pieces = sp.Pieces(sp._read(sp.MODEL_PATH))
    every = [t for _, t, _ in small_documents]
    want = [x.tolist() for x in pieces.encode(every)]
    monkeypatch.setattr(sp, "CACHE_WORDS", 50)
    monkeypatch.setattr(sp, "CACHE_CHARS", 5)
    again = sp.Pieces(sp._read(sp.MODEL_PATH))
    assert [again.encode([t])[0].tolist() for t in every] == want


def test_round_trip_odd_and_empty(spark, odd, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL_PATH)
    rows = sp.encode_documents(odd, check=True).collect()
    want = [(r.doc_id, library.encode(r.text or "")) for r in odd.collect()]
    assert sorted([(r.doc_id, list(r.ids)) for r in rows], key=repr) == sorted(want, key=repr)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    back = sp.decode_documents(sp.encode_documents(odd)).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=repr) == sorted([(r.doc_id, r.text or "") for r in odd.collect()], key=repr)
    assert sp.encode_documents(nothing).count() == 0


def test_every_piece_is_looked_up_by_its_last_characters():
    pieces = sp.Pieces(sp._read(sp.MODEL_PATH))
    for piece in pieces.ids:
        sizes = pieces.sizes.get(piece[-3:], (2, 1))
        assert len(piece) in sizes and list(sizes) == sorted(sizes, reverse=True) and sizes[-1] == 1
