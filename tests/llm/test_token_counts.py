"""Token counts against the sentencepiece library and against merging by its definition."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tempograin.llm import token_counts

PATH = public_tokenizers.path(token_counts.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
COUNTS = token_counts.MergeCounts(open(PATH, "rb").read())


def library(text):
    return len(LIBRARY.encode(text or ""))


def by_definition(word):
    """Merge the best pair, leftmost first, by looking at all pairs each time."""
    parts = list(word)
    while True:
        found = [(COUNTS.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in COUNTS.ranks]
        if not found:
            return len(parts)
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_all_documents_as_the_library(small_documents):
    for doc_id, text, _ in small_documents:
        assert COUNTS.count(text) == library(text), doc_id


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab then  ▁\n\t\x00é漢🙂<s>/0x", max_size=80))
def test_any_text_as_the_library(text):
    assert COUNTS.count(text) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinorstTh▁", min_size=1, max_size=40))
def test_heap_merges_as_defined(word):
    assert COUNTS.merged(word) == by_definition(word)


@pytest.mark.parametrize("text", [
    "<s> </s> <unk> <0x0A>", " ", "     ", "\n\n", "a" * 5000, "ab" * 30_000, "漢字" * 4000, "word " * 30_000, "é" * 100 + " " * 300 + "x"])
def test_special_strings_and_long_runs(text):
    assert COUNTS.count(text) == library(text)


def test_slices_change_nothing(monkeypatch, small_documents):
    monkeypatch.setattr(token_counts, "SLICE_CHARS", 7)
    for _, text, _ in small_documents[:40]:
        assert COUNTS.count(text) == library(text)
        if text:
            assert "".join(COUNTS.slices(text)) == "▁" + text.replace(" ", "▁")


def test_forgetting_changes_nothing(monkeypatch, small_documents):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    fresh = token_counts.MergeCounts(open(PATH, "rb").read())
    assert all(fresh.count(t) == library(t) for _, t, _ in small_documents[:20]) and len(fresh) <= 5


def test_odd_rows(odd, nothing):
    got = token_counts.count_tokens(odd, PATH, limit=4)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r.doc_id, len((r.text or "").encode()), library(r.text), library(r.text) > 4) for r in odd.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(nothing, PATH).collect() == []


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        proto = token_counts.sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(open(PATH, "rb").read())
        proto.trainer_spec.model_type = 1
        token_counts.MergeCounts(proto.SerializeToString())
