"""Token counts by byte-pair merging over a heap and a linked list.

A text is cut into words that no piece crosses. A word starts as its characters, each a node
of a linked list; a heap holds the adjacent pairs whose joined text is a piece, lowest rank
first and leftmost among equals. The best pair is popped and merged until none is left. The
count is the characters less the merges, plus the further bytes of characters that are no
piece. No identifier is looked up or emitted, and a word is merged once while a worker
remembers its count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from tempograin.llm.common import query

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
MARK = "▁"
# The model type and the piece types of the file format.
BPE = 2
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5
REMEMBERED = 1_000_000  # words a worker keeps
LONG_WORD = 48  # longer words are not kept
SLICE_CHARS = 1 << 20


class MergeCounts(dict):
    """The number of tokens of words, merged when first asked for."""

    def __init__(self, model: bytes):
        super().__init__()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and word marks in front are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("pieces that span words are not supported")
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: order[s] for p, s in scores.items()}
        self.joined = {p[i:i + 2] for p in scores for i in range(len(p) - 1)}
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def merged(self, word: str) -> int:
        """How many symbols are left of ``word`` when no pair can be merged."""
        n, rank_of = len(word), self.ranks.get
        end = list(range(1, n + 1))  # of the symbol that starts here, 0 if none does; also where the next starts
        before = list(range(-1, n))  # start of the symbol before
        heap = [rank << 32 | i for i in range(n - 1) if (rank := rank_of(word[i:i + 2])) is not None]
        heapify(heap)
        left = n
        while heap:
            top = heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = end[i]
            if not j or j == n:
                continue
            k = end[j]
            if rank_of(word[i:k]) != rank:  # one of the two has been merged since
                continue
            end[i], end[j] = k, 0
            before[k] = i
            left -= 1
            if k < n and (rank := rank_of(word[i:end[k]])) is not None:
                heappush(heap, rank << 32 | i)
            if i and (rank := rank_of(word[before[i]:k])) is not None:
                heappush(heap, rank << 32 | before[i])
        return left

    def parts(self, word: str) -> Iterator[str]:
        """``word`` cut where two characters stand side by side in no piece: no merge can cross."""
        at = 0
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in self.joined:
                yield word[at:i]
                at = i
        yield word[at:]

    def __missing__(self, word: str) -> int:
        long = len(word) > LONG_WORD
        count = sum(map(self.merged, self.parts(word))) if long else self.merged(word)
        for c in word:
            if c not in self.ranks:
                count += len(c.encode("utf-8", "surrogatepass")) - 1
        if not long:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = count
        return count

    def slices(self, text: str) -> Iterator[str]:
        """The marked text in slices of bounded size that end where a word ends."""
        marked = self.prefix + text.replace(" ", MARK)
        at, n = 0, len(marked)
        while n - at > SLICE_CHARS:
            end = marked.find(MARK, at + SLICE_CHARS)
            while end > 0 and marked[end - 1] == MARK:
                end = marked.find(MARK, end + 1)
            if end < 0:
                break
            yield marked[at:end]
            at = end
        yield marked[at:] if at else marked

    def count(self, text: str | None) -> int:
        """The tokens of a whole text; none for null and empty texts."""
        if not text:
            return 0
        each, words = self.__getitem__, self.words
        return sum(sum(map(each, words(part))) for part in self.slices(text))


_LOADED: dict[bytes, MergeCounts] = {}


def _counts(model: bytes) -> MergeCounts:
    """The counts of a model, kept while the worker lives."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = MergeCounts(model)
    return _LOADED[model]


def count_tokens(docs: DataFrame, model_path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    Null and empty texts have no bytes and no tokens. Repeated rows and rows with a null
    doc_id get a row each; other columns are ignored, whatever their names. Whole texts are
    counted: very long ones in slices of whole words, and a very long word in parts that no
    piece joins, so memory follows the longest run of characters that pieces do join. The
    model file is read by the driver.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(model)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = np.fromiter((counts.count(t.as_py()) for t in texts), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@query("op11_token_counts")
def op11(t):
    return count_tokens(t.documents, public_tokenizers.path(MODEL))
