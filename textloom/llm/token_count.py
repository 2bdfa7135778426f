"""Token counts by heap-and-linked-list byte-pair merging, without making ids.

A text is its dummy prefix and characters; spaces are U+2581. Pieces of the vocabulary hold that mark
only at their start or throughout, so no merge crosses from another character to a mark, and each run of
marks with the characters after it is merged by itself. In such a run the adjacent pair of the best score
(leftmost among equals) is popped from a heap and joined in a linked list, until none is in the
vocabulary. Count: initial symbols minus merges, where a character outside the vocabulary counts as its
UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batch, texts

MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


class MergeCounter(dict):
    """counter[run]: tokens of a run; kept, within a bound, for later calls."""

    def __init__(self, model_file: str, most: int = 800_000):
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        if odd := [p for p in self.rank if MARK in p[1:] and p.strip(MARK)]:
            raise ValueError(f"pieces with a mark inside: {odd[:3]}")
        self.most = most

    def symbols(self, char: str) -> int:
        return 1 if char in self.rank else len(char.encode())

    def merge(self, run: str) -> int:
        rank, n = self.rank, len(run)
        count = sum(map(self.symbols, run))
        if n == 1:
            return count
        held: list[str | None] = list(run)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[p], i, 2) for i in range(n - 1) if (p := run[i : i + 2]) in rank]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            left = held[i]
            if left is None or (j := after[i]) >= n or len(left) + len(held[j]) != size:
                continue
            count -= 1 if left in rank and held[j] in rank else self.loss(left) + self.loss(held[j]) - 1
            joined = held[i] = left + held[j]
            held[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(joined + held[k])) is not None:
                    heappush(heap, (r, i, size + len(held[k])))
            if (h := before[i]) >= 0 and (r := rank.get(held[h] + joined)) is not None:
                heappush(heap, (r, h, size + len(held[h])))
        return count

    def loss(self, symbol: str) -> int:
        return 1 if symbol in self.rank else sum(map(self.symbols, symbol))

    def __missing__(self, run: str) -> int:
        found = self.merge(run)
        if len(run) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[run] = found
        return found

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        if MARK * 2 in marked or marked[-1] == MARK or marked[0] == MARK:
            return sum(map(self.__getitem__, _RUN.findall(MARK + marked)))
        return sum(map(self.__getitem__, [MARK + w for w in marked.split(MARK)]))


_made: dict[str, MergeCounter] = {}


def counter(model_file: str) -> MergeCounter:
    if model_file not in _made:
        _made[model_file] = MergeCounter(model_file)
    return _made[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs, in one scan without a shuffle.

    Null and empty texts: 0 bytes, 0 tokens. Repeated rows and null ids come back as they are. An empty
    table gives an empty result. Texts of any length are counted whole. Extra columns are left out.
    """

    def run(batches):
        count = counter(model_file).count
        for b in batches:
            n = [count(t) for t in b.column(1).to_pylist()]
            yield batch(schema, b.column(0), pc.binary_length(b.column(1).cast(pa.large_binary())).cast(pa.int64()), n, [x > limit for x in n])

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
