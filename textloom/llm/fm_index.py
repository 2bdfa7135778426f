"""Benchmark decontamination by an FM-index for each shard of the training texts.

Words outside the tests' vocabulary are in no phrase. A shard's index holds its runs of vocabulary words
(those that can hold the shortest phrase), each after a separator of its own. From the suffix array come
the Burrows-Wheeler transform, as a wavelet matrix with ranks, and suffix positions sampled at every
`SAMPLE`-th place and at the start of each run. Phrases are sought backwards, all at once; occurrences are
located by LF steps to a sampled suffix; their spans are merged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, batch, blocks, materialize, pairs, texts

SAMPLE = 8
SPANS = "doc_id long, n_words long, n_items long, items array<string>, first array<long>, last array<long>"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class FMIndex:
    """Over symbols >= 0, where 0 separates runs: count() and locate() of phrases without 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.append(text.astype(np.int64), 0)
        self.n = n = len(text)
        zero = text == 0
        rank = np.where(zero, np.cumsum(zero) - 1, text + int(zero.sum()) - 1)
        h = 1
        while True:
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: max(0, n - h)] = rank[h:] + 1
            key = rank * (2 * n + sigma + 2) + ahead
            suffixes = np.argsort(key, kind="stable")
            new = np.empty(n, dtype=np.int64)
            new[suffixes] = np.concatenate([[0], np.cumsum(key[suffixes[1:]] != key[suffixes[:-1]])])
            rank, h = new, 2 * h
            if rank[suffixes[-1]] == n - 1:
                break
        self.bwt = text[suffixes - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        taken = (suffixes % SAMPLE == 0) | (self.bwt == 0)
        self.sampled, self.sample_rank, self.samples = taken, np.cumsum(taken) - 1, suffixes[taken]
        self.levels = []
        rest = self.bwt
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            on = (rest >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(on, dtype=np.int32)]), int(n - on.sum())))
            rest = np.concatenate([rest[~on], rest[on]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first `at` places of the transform."""
        low = np.zeros(len(at), dtype=np.int64)
        for bit, ones, zeros in self.levels:
            on = (symbol >> bit & 1).astype(bool)
            a, b = ones[at], ones[low]
            at = np.where(on, zeros + a, at - a)
            low = np.where(on, zeros + b, low - b)
        return at - low

    def count(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases: a row each, right-aligned. (which occur, their first row of the suffix array, one past the last)."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(1, phrases.shape[1] + 1):
            go = sizes[which] >= k
            c = phrases[which[go], -k]
            low[go] = self.before[c] + self.rank(c, low[go])
            high[go] = self.before[c] + self.rank(c, high[go])
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
        return which, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        row, steps = row.copy(), np.zeros(len(row), dtype=np.int64)
        todo = np.flatnonzero(~self.sampled[row])
        while len(todo):
            c = self.bwt[row[todo]]
            row[todo] = self.before[c] + self.rank(c, row[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[row[todo]]]
        return self.samples[self.sample_rank[row]] + steps


@dataclass
class Phrases:
    """The tests' windows: rows of word numbers (right-aligned), their sizes, and the items that hold each."""

    vocab: dict[bytes, int]
    rows: np.ndarray
    sizes: np.ndarray
    item_start: np.ndarray
    item_of: np.ndarray
    items: list[str]

    @classmethod
    def build(cls, items: list[tuple[str, bytes]], size: int) -> Phrases | None:
        vocab: dict[bytes, int] = {}
        found: dict[tuple, list[int]] = {}
        for k, (_, text) in enumerate(items):
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - size + 1)) if ids else ():
                held = found.setdefault(tuple(ids[i : i + size]), [])
                if not held or held[-1] != k:
                    held.append(k)
        if not found:
            return None
        rows = np.zeros((len(found), size), dtype=np.int64)
        for r, w in zip(rows, found, strict=True):
            r[size - len(w) :] = w
        held = list(found.values())
        return cls(vocab, rows, np.array([len(w) for w in found]), np.concatenate([[0], np.cumsum([len(h) for h in held])]), np.array([k for h in held for k in h]), [i for i, _ in items])


def search(texts_: list[bytes], p: Phrases) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """For a shard: words of each text; then, for each occurrence of a phrase: text, first word, phrase."""
    get, counts, held = p.vocab.get, [], []
    for t in texts_:
        ids = [get(w, 0) for w in words(t)]
        counts.append(len(ids))
        ids.append(0)
        held.append(np.array(ids, dtype=np.int64))
    stream = np.concatenate(held)
    origin = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    known = np.concatenate([[False], stream != 0, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    begin, end = edge[::2], edge[1::2]
    fit = end - begin >= p.sizes.min()
    begin, end = begin[fit], end[fit]
    none = np.zeros(0, dtype=np.int64)
    if not len(begin):
        return counts, none, none, none
    size = end - begin + 1
    place = np.cumsum(size) - size
    source = np.repeat(begin - 1 - place, size) + np.arange(int(size.sum()))
    text = np.where(np.isin(np.arange(len(source)), place), 0, stream[source])
    index = FMIndex(text, len(p.vocab))
    which, low, high = index.count(p.rows, p.sizes)
    many = high - low
    row = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    at = source[index.locate(row)]
    doc = np.searchsorted(origin, at, side="right") - 1
    return counts, doc, at - origin[doc], np.repeat(which, many)


def merged(first: np.ndarray, last: np.ndarray) -> tuple[list[int], list[int]]:
    """Spans [first, last) in order, overlapping and touching ones as one."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > last[:-1]])
    return first[new].tolist(), last[np.append(new[1:], True)].tolist()


def phrase_blocks(benchmark: DataFrame, size: int, id_col: str, text_col: str, most: int) -> Iterator[Phrases]:
    """Phrases of the tests, in blocks of a bounded number of bytes: each is sent to the executors whole."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).toLocalIterator(prefetchPartitions=False)
    for held in blocks(((i, bytes(t)) for i, t in rows), lambda r: len(r[1]), most):
        if (p := Phrases.build(held, size)) is not None:
            yield p


def find_spans(docs: DataFrame, benchmark: DataFrame, size: int = 8, shard_bytes: int = 4_000_000, most_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document: doc_id, n_words, the items with occurring windows, and the merged word spans [first, last).

    A benchmark within `most_bytes` takes one scan without a shuffle. A larger one is sought block by
    block, one scan each, and the spans are merged by a row key made for it; nothing is dropped. Null and
    empty texts have no words; an empty benchmark hits nothing; repeated rows and null ids stay as they are.
    Benchmark rows with a null item_id are one item, null, last in items. Extra columns are left out.
    """
    d = texts(docs, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])

    def one(shared):
        def run(batches):
            p = shared.value
            for held in blocks(pairs(batches), lambda r: len(r[1]), shard_bytes):
                if p is None:
                    counts, doc = [len(words(t)) for _, t in held], np.zeros(0, dtype=np.int64)
                    at = which = doc
                else:
                    counts, doc, at, which = search([t for _, t in held], p)
                items, first, last = ([[] for _ in held] for _ in range(3))
                order = np.argsort(doc, kind="stable")
                doc, at, which = doc[order], at[order], which[order]
                edge = np.flatnonzero(np.diff(doc, prepend=-1))
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(doc)], strict=True) if len(doc) else ():
                    k, w = int(doc[a]), which[a:b]
                    first[k], last[k] = merged(at[a:b], at[a:b] + p.sizes[w])
                    items[k] = ordered({p.items[i] for x in set(w.tolist()) for i in p.item_of[p.item_start[x] : p.item_start[x + 1]].tolist()})
                yield batch(schema, [i for i, _ in held], counts, [len(x) for x in items], items, first, last)

        return run

    found = [d.sparkSession.sparkContext.broadcast(p) for p in phrase_blocks(benchmark, size, item_col, item_text, most_bytes)]
    if len(found) < 2:
        return d.mapInArrow(one(found[0] if found else d.sparkSession.sparkContext.broadcast(None)), SPANS)

    def count(batches):
        for b in batches:
            n = [len(words(t)) for _, t in pairs([b])]
            items, first, last = ([x or [] for x in b.column(k).to_pylist()] for k in (2, 3, 4))
            spans = [merged(np.array(f), np.array(z)) if f else ([], []) for f, z in zip(first, last, strict=True)]
            items = [ordered(set(x)) for x in items]
            yield batch(schema, b.column(0), n, [len(x) for x in items], items, [f for f, _ in spans], [z for _, z in spans])

    rows = _with_spans(d, found, shard_bytes)
    return rows.select("row.doc_id", "row.text", "items", "first", "last").mapInArrow(count, SPANS)


def ordered(items: set) -> list:
    """Sorted; the item of null item_ids last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


def _with_spans(docs: DataFrame, found: list, shard_bytes: int) -> DataFrame:
    """(row struct, items, first, last): docs with what all blocks of phrases found in the text; null if none did."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("key"))
    kept = materialize(rows, "rows")
    schema = pa.schema([("key", pa.int64()), ("items", pa.list_(pa.string())), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])
    names = "key long, items array<string>, first array<long>, last array<long>"

    def seek(shared):
        def run(batches):
            p = shared.value
            for held in blocks(((i, t) for i, t in pairs(batches) if t), lambda r: len(r[1]), shard_bytes):
                _, doc, at, which = search([t for _, t in held], p)
                for x in np.unique(doc).tolist():
                    own = doc == x
                    w = which[own]
                    items = ordered({p.items[i] for y in set(w.tolist()) for i in p.item_of[p.item_start[y] : p.item_start[y + 1]].tolist()})
                    first, last = merged(at[own], at[own] + p.sizes[w])
                    yield batch(schema, [held[x][0]], [items], [first], [last])

        return run

    hits = reduce(DataFrame.unionByName, (kept.select("key", "row.text").mapInArrow(seek(p), names) for p in found))
    flat = hits.groupBy("key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("items", "first", "last")))
    return kept.join(flat, "key", "left").drop("key")


def digest(spans: DataFrame) -> DataFrame:
    """The spans as counts: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate(F.zip_with("last", "first", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return spans.select("doc_id", "n_words", hit.alias("n_hit"), "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


def cut_spans(text: bytes, first: list[int], last: list[int]) -> bytes:
    """The text without the words of the spans, and what lies between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(ALNUM))]
    out, begin = [], 0
    for a, b in zip(first, last, strict=True):
        out.append(text[begin : at[a][0]])
        begin = at[b - 1][1]
    return b"".join([*out, text[begin:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 8, shard_bytes: int = 4_000_000, most_bytes: int = 8_000_000) -> DataFrame:
    """docs with the spans cut out of `text`; clean rows are as they were, n_chars (if any) follows the text.

    A benchmark within `most_bytes` takes one scan without a shuffle. The spans of a larger one are sought
    block by block in the texts as they came, merged by row, and cut once. Null texts stay null, empty ones
    empty; long texts are searched whole; repeated rows are cut alike; an empty table or benchmark changes
    nothing. All columns stay, whatever their names; ids take no part, so null and repeated ones do no harm.
    """
    found = [docs.sparkSession.sparkContext.broadcast(p) for p in phrase_blocks(benchmark, size, "item_id", "text", most_bytes)]
    if not found:
        return docs
    if len(found) == 1:
        return docs.mapInArrow(_cutter(found[0], shard_bytes), docs.schema)
    return _with_spans(docs, found, shard_bytes).select("first", "last", "row").mapInArrow(_cut, docs.schema)


def _cut(batches):
    """Cut the spans (first, last) from the rows of the struct column after them."""
    for b in batches:
        rows = pa.RecordBatch.from_struct_array(b.column(2))
        raw = rows.column(rows.schema.names.index("text")).cast(pa.large_binary()).to_pylist()
        first, last = b.column(0).to_pylist(), b.column(1).to_pylist()
        changed = {i: cut_spans(raw[i], *merged(np.array(f), np.array(z))) for i, (f, z) in enumerate(zip(first, last, strict=True)) if f}
        yield _changed(rows, raw, changed)


def _changed(b: pa.RecordBatch, raw: list, changed: dict[int, bytes]) -> pa.RecordBatch:
    """The batch with new texts in some rows; n_chars (if any) follows."""
    if not changed:
        return b
    names, cols = b.schema.names, b.columns
    k = names.index("text")
    new = [changed.get(i, t) for i, t in enumerate(raw)]
    cols[k] = pa.array([None if t is None else t.decode() for t in new], type=b.schema.field(k).type)
    if "n_chars" in names:
        j = names.index("n_chars")
        n = b.column(j).to_pylist()
        cols[j] = pa.array([len(new[i].decode()) if i in changed else v for i, v in enumerate(n)], type=b.schema.field(j).type)
    return pa.RecordBatch.from_arrays(cols, schema=b.schema)


def _cutter(shared, shard_bytes: int):
    def run(batches):
        p = shared.value
        for b in batches:
            raw = b.column(b.schema.names.index("text")).cast(pa.large_binary()).to_pylist()
            rows = [(i, t) for i, t in enumerate(raw) if t]
            changed: dict[int, bytes] = {}
            for held in blocks(rows, lambda r: len(r[1]), shard_bytes):
                _, doc, at, which = search([t for _, t in held], p)
                for x in set(doc.tolist()):
                    own = doc == x
                    i, t = held[x]
                    changed[i] = cut_spans(t, *merged(at[own], at[own] + p.sizes[which[own]]))
            yield _changed(b, raw, changed)

    return run


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
