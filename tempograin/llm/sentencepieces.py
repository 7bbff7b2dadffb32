"""SentencePiece encoding and decoding with shared prefixes.

A text is split into marked words (a run of word marks and what follows it), which no piece
crosses. The distinct words of a batch are sorted, which is the depth-first order of their
trie, and a forward pass runs along it: each node's result depends on its prefix alone, so
words that share a prefix share its results.

For unigram models the forward state of a prefix is the best score (Viterbi). For BPE
models, whose result is defined by merges, the best score would give other pieces than the
model does. Their forward state is the last piece of the prefix's encoding, which is unique:
the piece that ends there, is stable itself and next to the last piece before it.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tempograin.llm.common import query

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 600_000
CACHE_CHARS = 48  # longer words are not kept
SLICE_BYTES = 2 << 20


class Pieces:
    """The pieces of a model file, and the encoding of words with them."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        if train.model_type not in (UNIGRAM, BPE) or train.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with word marks in front are supported")
        self.unigram = train.model_type == UNIGRAM
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type in (NORMAL, USER_DEFINED)}
        self.longest = max(map(len, self.ids))
        # How long the pieces with the same last three characters are, longest first.
        sizes: dict[str, set[int]] = {}
        for piece in self.ids:
            sizes.setdefault(piece[-3:], {1, 2}).add(len(piece))
        self.sizes = {tail: sorted(found, reverse=True) for tail, found in sizes.items() if len(tail) == 3}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.unknown_score = min(self.scores.values()) - UNKNOWN_PENALTY
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that span words are not supported")
        # White space that no piece contains stands alone.
        alone = re.escape("".join(c for c in "\n\t\r" if not any(c in p for p in self.ids)))
        self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else "")).findall
        self.text = [p.piece.encode() for p in proto.pieces]
        for value, i in self.bytes.items():
            self.text[i] = bytes([value])
        self.is_control = {i for i, p in enumerate(proto.pieces) if p.type not in (NORMAL, USER_DEFINED, BYTE)}
        for i in self.is_control:
            self.text[i] = " ⁇ ".encode() if i == self.unknown else b""
        self.cache: dict[str, tuple[int, ...]] = {}
        self.stable: dict[str, bool] = {}
        self.joint: dict[tuple[str, str], bool] = {}

    def merged(self, word: str) -> list[str]:
        """BPE by its definition: merge the best neighbours, leftmost first, until none is left."""
        parts, scores = list(word), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _holds(self, before: str, piece: str) -> bool:
        """Whether the encoding of both texts together is the two pieces."""
        known = self.joint.get((before, piece))
        if known is None:
            known = self.joint[before, piece] = self.merged(before + piece) == [before, piece]
            if len(self.joint) > 2_000_000:
                self.joint.clear()
        return known

    def _stable(self, piece: str) -> bool:
        known = self.stable.get(piece)
        if known is None:
            known = self.stable[piece] = self.merged(piece) == [piece]
        return known

    def _last_piece(self, word: str, end: int, starts: list[int]) -> int:
        """Where the last piece of ``word[:end]`` starts, for a BPE model."""
        ids, stable, joint = self.ids, self.stable, self.joint
        for size in self.sizes.get(word[max(0, end - 3):end], (2, 1)):
            at = end - size
            if at < 0:
                continue
            piece = word[at:end]
            if size == 1 or (piece in ids and (stable.get(piece) or self._stable(piece))):
                before = word[starts[at]:at]
                if at == 0 or joint.get((before, piece)) or self._holds(before, piece):
                    return at
        raise AssertionError(f"no last piece for {word[:end]!r}")

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of distinct words, found along their trie."""
        out: dict[str, tuple[int, ...]] = {}
        starts, best, previous = [0], [0.0], ""
        for word in sorted(words):
            shared = len(previous)
            if not word.startswith(previous):
                shared, most = 0, min(len(word), len(previous))
                while shared < most and word[shared] == previous[shared]:
                    shared += 1
            del starts[shared + 1:], best[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                if self.unigram:
                    score, at = max((best[j] + self._score(word[j:end]), -j) for j in range(max(0, end - self.longest), end))
                    best.append(score)
                    starts.append(-at)
                else:
                    starts.append(self._last_piece(word, end, starts))
            ids, end = [], len(word)
            while end:
                piece = word[starts[end]:end]
                known = self.ids.get(piece)
                if known is None:
                    ids += reversed(self._ids(piece))
                else:
                    ids.append(known)
                end = starts[end]
            out[word] = tuple(reversed(ids))
            previous = word
        return out

    def _score(self, piece: str) -> float:
        score = self.scores.get(piece)
        return score if score is not None else self.unknown_score if len(piece) == 1 else float("-inf")

    def _ids(self, piece: str) -> tuple[int, ...]:
        known = self.ids.get(piece)
        if known is not None:
            return (known,)
        if self.bytes:
            return tuple(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
        return (self.unknown,)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.words(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = set().union(*split)
        fresh.difference_update(self.cache)
        found = self.encode_words(list(fresh))
        if len(self.cache) + len(found) > CACHE_WORDS:
            self.cache.clear()
            found |= self.encode_words([w for w in set().union(*split) if w not in found])
        self.cache.update(found)
        out = [np.fromiter(itertools.chain.from_iterable(map(self.cache.__getitem__, words)), np.int32) for words in split]
        for word in found:
            if len(word) > CACHE_CHARS:
                del self.cache[word]
        return out

    def decode(self, ids) -> str:
        """The text of ids: the inverse of :meth:`encode`, but for texts that hold the word mark itself."""
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_LOADED: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    """The pieces of a model, kept while the worker lives."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, check: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_pieces, ids), with ``round_trip`` if ``check``.

    ``round_trip`` says whether decoding gives the text again. Null and empty texts have no
    pieces; an empty text comes back as it is, a null text as null. Texts that contain the
    word mark itself come back with spaces in its place. Every row has a row, repeats and
    null ids included. Other columns are ignored. The model file is read by the driver.
    """
    model = _read(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        names = ["doc_id", "n_pieces", "ids", *["round_trip"] * check]
        for batch in batches:
            texts, at = batch.column(1), 0
            total = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                before = total[at - 1] if at else 0
                end = min(batch.num_rows, int(np.searchsorted(total, before + SLICE_BYTES)) + 1)
                part = texts.slice(at, end - at).to_pylist()
                ids = pieces.encode([t or "" for t in part])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                columns = [batch.column(0).slice(at, end - at), pa.array(np.diff(offsets).astype(np.int64)),
                           pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
                if check:
                    columns.append(pa.array([pieces.decode(x.tolist()) == (t or "") for x, t in zip(ids, part)]))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = end
    kind = "doc_id long, n_pieces long, ids array<int>" + ", round_trip boolean" * check
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def decode_documents(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, ids) as (doc_id, text); null ids give a null text."""
    model = _read(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if x is None else pieces.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


@query("op4_sentencepieces")
def op4(t):
    return encode_documents(t.documents, check=True)
