"""Brown class-based bigram model of the corpus, and scores of whole texts by it.

log10 P(text) sums, over its words and an end mark, log10 P(w | previous word), where for a known word

    P(w | v) = (1 - u(v)) * ((1 - share) * P(class(w) | class(v)) * P(w | class(w)) + share * P(w))

and u(v) = P(unknown | class(v)) for the one type that stands for all unknown words, estimated from the
words seen once (the chance of a new word). Sums are proper over the known words and the unknown type.

Classes come from exchange clustering. It starts from the most frequent words (`core`, a fixed number, by
their counts over all training rows), which are moved on the driver, one at a time, to the class that most
raises the class bigram likelihood, until none moves; all other words are one class then. Sweeps over the
whole training vocabulary follow, the core included: a sweep takes the class totals anew from the corpus,
and each shard of words moves its own, given all their neighbours' classes. Sweeps end when no word moves,
or one raises the likelihood by under a thousandth of what all have, or after `most_sweeps`; one that
lowers it is taken back. All counts cover all training rows.

The corpus is written once as blocks: a vocabulary of word hashes and the ids of the words. What a block
asks about its words (class, count) is dealt by hash to where all blocks' counts of a word meet; the
answers come back by block. So nothing that grows with the vocabulary is ever held in one place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batch, blocks, materialize, pairs, partitions, texts, word_hashes

END = b"\n"  # no word holds it
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
NONE = 255


def pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), 1) if len(x) else b""


def unpack(raw: bytes, kind) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def is_held_out(doc_id: int | None, modulus: int = 10) -> bool:
    """crc32 of the id's text mod modulus is 0; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == 0


BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("vocab", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
BLOCK_SQL = "block long, docs array<long>, sizes array<long>, vocab binary, counts binary, ids binary"


def corpus(docs: DataFrame, block_bytes: int = 6_000_000) -> DataFrame:
    """Blocks of documents: sorted word hashes, their training counts, and the words as places among them."""

    def run(batches):
        part, seq = TaskContext.get().partitionId() << 32, 0
        for held in blocks(pairs(batches), lambda r: len(r[1]), block_bytes):
            words, sizes = [], []
            for _, t in held:
                w = t.translate(LOWER).split()
                w.append(END)
                words += w
                sizes.append(len(w))
            h = word_hashes(words)
            vocab, ids = np.unique(h, return_inverse=True)
            train = np.repeat([not is_held_out(i) for i, _ in held], sizes)
            counts = np.bincount(ids[train], minlength=len(vocab))
            yield batch(BLOCK, [part + seq], [[i for i, _ in held]], [sizes], [vocab.tobytes()], [pack(counts.astype(np.uint32))], [pack(ids.astype(np.uint32))])
            seq += 1

    return docs.mapInArrow(run, BLOCK_SQL)


class Block:
    def __init__(self, docs, sizes, vocab, ids):
        self.docs, self.sizes = docs, np.array(sizes, dtype=np.int64)
        self.vocab = np.frombuffer(vocab, np.uint64)
        self.ids = unpack(ids, np.uint32).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat([not is_held_out(i) for i in docs], self.sizes)

    def previous(self, values: np.ndarray, start: int) -> np.ndarray:
        """Of each word, its predecessor's value; at a document's first word, `start`."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out


def place(core: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """For each hash its place in the sorted core, or len(core)."""
    at = np.minimum(np.searchsorted(core, vocab), max(0, len(core) - 1))
    return np.where(core[at] == vocab, at, len(core)) if len(core) else np.zeros(len(vocab), dtype=np.int64)


def exchange(bigrams: np.ndarray, n_classes: int) -> np.ndarray:
    """Classes of the first len-1 words of a bigram count matrix; its last word (all others) keeps a class
    of its own, the last one. Words start dealt in turn; a sweep moves each word once, and
    sweeps go on until none moves. Each move raises the likelihood by more than rounding can, so they end."""
    n = len(bigrams) - 1
    own = np.append(np.arange(n) % max(1, n_classes - 1), n_classes - 1)
    b = bigrams.astype(np.float64)
    hot = np.zeros((n + 1, n_classes))
    hot[np.arange(n + 1), own] = 1
    m = hot.T @ b @ hot
    h = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    rows, cols = b @ hot, b.T @ hot  # of each word: followers, predecessors by class
    least = 1e-9 + 1e-13 * float(h(b.sum()))
    moved = 1
    while moved:
        moved = 0
        for w in range(n):
            c, r, l, self_ = own[w], rows[w].copy(), cols[w].copy(), b[w, w]
            if not r.any() and not l.any():
                continue
            r[c] -= self_
            l[c] -= self_
            m[c, :] -= r
            m[:, c] -= l
            m[c, c] -= self_
            out, into = m.sum(axis=1) + l, m.sum(axis=0) + r  # each class's words but w, as predecessors and followers
            gain = h(m + r[None, :]) - h(m)
            gain2 = h(m + l[:, None]) - h(m)
            d = np.diag(m)
            best = gain.sum(axis=1) - np.diag(gain) + gain2.sum(axis=0) - np.diag(gain2) + h(d + r + l + self_) - h(d)
            best -= h(out + r.sum() + self_) - h(out) + h(into + l.sum() + self_) - h(into)
            best[-1] = -np.inf
            to = int(np.argmax(best))
            if best[to] <= best[c] + least:
                to = c
            m[to, :] += r
            m[:, to] += l
            m[to, to] += self_
            if to != c:
                moved += 1
                own[w] = to
                rows[:, c] -= b[:, w]
                rows[:, to] += b[:, w]
                cols[:, c] -= b[w, :]
                cols[:, to] += b[w, :]
    return own[:n]


def core_words(made: DataFrame, size: int) -> np.ndarray:
    """Hashes, sorted, of the `size` most frequent training words, by their counts over all blocks."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for vocab, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v, n = np.frombuffer(vocab, np.int64), unpack(counts, np.uint32).astype(np.int64)
                yield batch(schema, v[n > 0], n[n > 0])

    top = made.select("vocab", "counts").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(size).collect()
    return np.sort(np.array([r.h for r in top], dtype=np.int64).view(np.uint64))


def core_bigrams(made: DataFrame, core: np.ndarray) -> np.ndarray:
    """Counts of followers among the core and, as one word, all others. Bounded by the core's size."""
    n, end = len(core) + 1, int(word_hashes([END])[0])
    row = pa.schema([("id", pa.int32()), ("v", pa.binary())])

    def run(batches):
        held = np.zeros(n * n, dtype=np.int64)
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = Block(*r)
                at = place(core, x.vocab)[x.ids]
                start = int(place(core, np.array([end], dtype=np.uint64))[0])
                held += np.bincount((x.previous(at, start) * n + at)[x.train], minlength=n * n)
        held = held.reshape(n, n)
        used = np.flatnonzero(held.any(axis=1))
        yield batch(row, used.astype(np.int32), [pack(held[i]) for i in used])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[i] = held.get(i, 0) + unpack(v, np.int64)
        yield batch(row, list(held), [pack(v) for v in held.values()])

    out = np.zeros((n, n), dtype=np.int64)
    spread = made.select("docs", "sizes", "vocab", "ids").mapInArrow(run, "id int, v binary").repartition("id")
    for r in spread.mapInArrow(add, "id int, v binary").collect():
        out[r.id] = unpack(bytes(r.v), np.int64)
    return out


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def dense_gains(x: np.ndarray, c: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each word and class, the likelihood's gain from putting the word, taken out of its class c, there.
    x: how often each class comes before the word (k columns), after it (k), and the word after itself."""
    k = len(m)
    at, self_ = np.arange(len(c)), x[:, 2 * k]
    l, r = x[:, :k].copy(), x[:, k : 2 * k].copy()
    l[at, c] -= self_
    r[at, c] -= self_
    rest = np.repeat(m[None], len(c), axis=0)
    rest[at, c, :] -= r
    rest[at, :, c] -= l
    rest[at, c, c] -= self_
    rest = np.maximum(rest, 0)
    held, d = _h(rest), np.einsum("wii->wi", rest)
    out, into = rest.sum(axis=2) + l, rest.sum(axis=1) + r
    gain, gain2 = _h(rest + r[:, None, :]) - held, _h(rest + l[:, :, None]) - held
    best = gain.sum(axis=2) - np.einsum("wii->wi", gain) + gain2.sum(axis=1) - np.einsum("wii->wi", gain2) + _h(d + r + l + self_[:, None]) - _h(d)
    return best - (_h(out + (r.sum(axis=1) + self_)[:, None]) - _h(out) + _h(into + (l.sum(axis=1) + self_)[:, None]) - _h(into))


def sparse_gains(x: np.ndarray, c: np.ndarray, m: np.ndarray, small: int = 6) -> np.ndarray:
    """dense_gains() of words that never follow themselves and have few neighbours: only the cells of m that
    a word's neighbours touch can change, so a neighbour class costs k steps and not k squared."""
    k, n = len(m), len(c)
    at, l, r = np.arange(n), x[:, :k], x[:, k : 2 * k]
    best, cells_of, values = np.zeros((n, k)), [], []
    rise = lambda a, y: _h(a + y) - _h(a)

    def put(cell: np.ndarray, value: np.ndarray) -> None:
        cells_of.append(cell)
        values.append(value)

    for mine, other, cells in ((r, l, m.T), (l, r, m)):  # cells[j, t]: bigrams between neighbour class j and target t
        word, j = np.nonzero(mine)
        much, own = mine[word, j], c[word]
        table = np.concatenate([rise(cells, y) for y in range(1, small + 1)])
        hot = np.zeros((n, small * k))
        some = np.flatnonzero(much <= small)
        hot[word[some], (much[some].astype(np.int64) - 1) * k + j[some]] = 1
        best += hot @ table
        if len(big := np.flatnonzero(much > small)):
            edge = np.flatnonzero(np.diff(word[big], prepend=-1))
            best[word[big][edge]] += np.add.reduceat(rise(cells[j[big]], much[big, None]), edge)
        now = cells[j, own]
        put(word * k + j, -rise(cells[j, j], much))  # the cell of a class with itself comes below
        put(word * k + own, np.where(j == own, 0, _h(now) - _h(np.maximum(now - much, 0)) - rise(now, much)))
        if len(same := np.flatnonzero(j == own)):  # the word itself is in that class: its other neighbours leave these cells
            was, y = cells[j[same]], much[same, None]
            diff = rise(np.maximum(was - other[word[same]], 0), y) - rise(was, y)
            diff[np.arange(len(same)), j[same]] = 0
            best[word[same]] += diff
        # of all bigrams of a class, as neighbours' side, those with the word in it
        many, total = mine.sum(axis=1), cells.sum(axis=0)
        sizes, which = np.unique(many, return_inverse=True)
        best -= rise(total[None], sizes[:, None])[which]
        rest = np.maximum(total[c] - many, 0)
        put(at * k + c, rise(total[c], many) - rise(rest, many))
    both = l + r
    word, j = np.nonzero(both)
    much, d = both[word, j], m[j, j]
    put(word * k + j, rise(np.where(j == c[word], np.maximum(d - much, 0), d), much))
    return best + np.bincount(np.concatenate(cells_of), weights=np.concatenate(values), minlength=n * k).reshape(n, k)


def alike_gains(x: np.ndarray, c: np.ndarray, m: np.ndarray) -> np.ndarray:
    """sparse_gains() of words seen once: those of one class and the same neighbours gain alike."""
    k = len(m)
    _, first, which = np.unique((c * k + x[:, :k].argmax(axis=1)) * k + x[:, k : 2 * k].argmax(axis=1), return_index=True, return_inverse=True)
    return sparse_gains(x[first], c[first], m)[which]


def exchange_shard(near: np.ndarray, own: np.ndarray, m: np.ndarray, step: int = 256, few: int = 20) -> np.ndarray:
    """New classes of words, the most frequent first, given for each how often each class comes before it
    (k columns) and after it (k), and how often it follows itself; m: class bigrams of the corpus. Gains are
    those of exchange(); m takes up the moves after each `step` words, after 16 times as many of those with
    `few` neighbour classes, 160 times as many of those seen once."""
    k, near, own = len(m), np.asarray(near, dtype=np.float64), own.astype(np.int64)
    rare = (near[:, 2 * k] == 0) & (np.count_nonzero(near[:, : 2 * k], axis=1) <= few)
    once = rare & (near[:, :k].sum(axis=1) == 1) & (near[:, k:].sum(axis=1) == 1)
    least = 1e-9 + 1e-13 * float(_h(m.sum()))
    for which, gains, size in ((np.flatnonzero(~rare), dense_gains, step), (np.flatnonzero(rare & ~once), sparse_gains, 16 * step), (np.flatnonzero(once), alike_gains, 160 * step)):
        for a in range(0, len(which), size):
            w = which[a : a + size]
            x, c = near[w], own[w]
            at, best = np.arange(len(c)), gains(x, c, m)
            to = best.argmax(axis=1)
            to = np.where(best[at, to] > best[at, c] + least, to, c)
            go = to != c
            x, c, to = x[go], c[go], to[go]
            l, r, self_, at = x[:, :k].copy(), x[:, k : 2 * k].copy(), x[:, 2 * k], np.arange(len(x))
            l[at, c] -= self_
            r[at, c] -= self_
            shift = (to[:, None] == np.arange(k)).astype(float) - (c[:, None] == np.arange(k))
            m += shift.T @ r + l.T @ shift
            for sign, where in ((-1, c), (1, to)):
                np.add.at(m, (where, where), sign * self_)
            np.maximum(m, 0, out=m)
            own[w[go]] = to
    return own


def with_classes(made: DataFrame, told: DataFrame | None) -> DataFrame:
    """The blocks with `said`: what the last sweep told each of its words; null before the first."""
    if told is None:
        return made.withColumn("said", F.lit(None).cast("array<struct<shard int, cls binary, counts binary>>"))
    return made.join(told.groupBy("block").agg(F.collect_list(F.struct("shard", "cls", "counts")).alias("said")), "block", "left")


def own_classes(x: Block, said: list | None, core: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    if not said:
        return np.append(classes, k - 1).astype(np.uint8)[place(core, x.vocab)]
    return np.concatenate([unpack(s["cls"], np.uint8) for s in sorted(said, key=lambda s: s["shard"])])


def neighbours(x: Block) -> tuple[np.ndarray, np.ndarray]:
    """Of the training words, predecessors and words, as places in the block's vocabulary."""
    end = int(np.searchsorted(x.vocab, word_hashes([END])[0]))
    return x.previous(x.ids, end)[x.train], x.ids[x.train]


def class_bigrams(made: DataFrame, told: DataFrame | None, core: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """Counts of the training corpus's class bigrams."""
    schema = pa.schema([("i", pa.int32()), ("n", pa.int64())])

    def run(batches):
        held = np.zeros(k * k, dtype=np.int64)
        for b in batches:
            for *r, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = Block(*r)
                p, q = neighbours(x)
                cls = own_classes(x, said, core, classes, k).astype(np.int64)
                held += np.bincount(cls[p] * k + cls[q], minlength=k * k)
        used = np.flatnonzero(held)
        yield batch(schema, used.astype(np.int32), held[used])

    out = np.zeros(k * k, dtype=np.int64)
    for r in with_classes(made, told).select("docs", "sizes", "vocab", "ids", "said").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r.i] = r.n
    return out.reshape(k, k)


def likelihood(m: np.ndarray) -> float:
    """Of the corpus by its class bigrams, but for what no class changes."""
    h = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return h(m.astype(np.float64)) - h(m.sum(axis=0).astype(np.float64)) - h(m.sum(axis=1).astype(np.float64))


def answers(made: DataFrame, told: DataFrame | None, core: np.ndarray, classes: np.ndarray, m: np.ndarray, n_shards: int) -> DataFrame:
    """A sweep. (block, shard, cls, counts, n, v, moved): of each block's words, by hash: class and training
    count in the corpus. n, v, moved: training tokens, types and moved types of the shard, in one of its rows."""
    k = len(m)
    wide = 2 * k + 1
    asked = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("vocab", pa.binary()), ("counts", pa.binary()), ("own", pa.binary()), ("near", pa.binary()), ("many", pa.binary())])
    said_ = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("cls", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("moved", pa.int64())])

    def ask(batches):
        for b in batches:
            for block, counts, *r, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, counts = Block(*r), unpack(counts, np.uint32)
                own = own_classes(x, said, core, classes, k)
                cls, (p, q) = own.astype(np.int64), neighbours(x)
                seen = np.sort(np.concatenate([q * wide + cls[p], p * wide + k + cls[q], q[p == q] * wide + 2 * k]))
                edge = np.flatnonzero(np.diff(seen, prepend=-1))
                near, many = seen[edge], np.diff(edge, append=len(seen)).astype(np.uint32)
                cut = np.searchsorted((x.vocab >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32), np.arange(n_shards + 1, dtype=np.uint64))
                lie = np.searchsorted(near, cut * wide)
                span = list(zip(cut[:-1].tolist(), cut[1:].tolist(), lie[:-1].tolist(), lie[1:].tolist(), strict=True))
                yield batch(asked, list(range(n_shards)), [block] * n_shards, [x.vocab[a:z].tobytes() for a, z, _, _ in span], [pack(counts[a:z]) for a, z, _, _ in span], [pack(own[a:z]) for a, z, _, _ in span], [pack((near[i:j] - a * wide).astype(np.uint32)) for a, _, i, j in span], [pack(many[i:j]) for _, _, i, j in span])

    def answer(batches):
        got = {}
        for b in batches:
            for shard, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.setdefault(shard, []).append(r)
        for shard, rows in got.items():
            sizes = np.array([len(r[1]) // 8 for r in rows])
            ends = np.cumsum(sizes)
            words, at = np.unique(np.frombuffer(b"".join(r[1] for r in rows), np.uint64), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([unpack(r[2], np.uint32) for r in rows]), minlength=len(words)).astype(np.int64)
            cls = np.full(len(words), NONE, dtype=np.uint8)
            cls[at] = np.concatenate([unpack(r[3], np.uint8) for r in rows])
            place = np.empty(len(words), dtype=np.int64)  # the most frequent words first
            place[order := np.argsort(-total, kind="stable")] = np.arange(len(words))
            near = [(unpack(r[4], np.uint32).astype(np.int64), a) for r, a in zip(rows, (ends - sizes).tolist(), strict=True)]
            near = np.concatenate([place[at[a + i // wide]] * wide + i % wide for i, a in near])
            many = np.concatenate([unpack(r[5], np.uint32) for r in rows])
            by = np.argsort(near)
            near, many, was, totals = near[by], many[by], cls.copy(), m.astype(np.float64)
            for a in range(0, int((total > 0).sum()), 40_000):
                own = order[a : min(a + 40_000, int((total > 0).sum()))]
                lo, hi = np.searchsorted(near, [a * wide, (a + len(own)) * wide])
                seen = np.bincount(near[lo:hi] - a * wide, weights=many[lo:hi], minlength=len(own) * wide).reshape(len(own), wide)
                cls[own] = exchange_shard(seen, cls[own], totals)
            cls[total == 0] = NONE
            moved = int(((was != cls) & (total > 0)).sum())
            for i, (r, a, z) in enumerate(zip(rows, (ends - sizes).tolist(), ends.tolist(), strict=True)):
                yield batch(said_, [r[0]], [shard], [pack(cls[at[a:z]])], [pack(total[at[a:z]])], *([y if i == 0 else 0] for y in (int(total.sum()), int((total > 0).sum()), moved)))

    rows = with_classes(made, told).select("block", "counts", "docs", "sizes", "vocab", "ids", "said").mapInArrow(ask, "shard int, block long, vocab binary, counts binary, own binary, near binary, many binary")
    return rows.repartitionById(n_shards, "shard").mapInArrow(answer, "block long, shard int, cls binary, counts binary, n long, v long, moved long")


def resolved(made: DataFrame, told: DataFrame, k: int) -> DataFrame:
    """The blocks with class and count of each of their words, and their counts of class transitions."""
    schema = pa.schema([("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()), ("cls", pa.binary()), ("counts", pa.binary()), ("moves", pa.binary())])
    end = int(word_hashes([END])[0])

    def run(batches):
        for b in batches:
            for docs, sizes, vocab, ids, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = Block(docs, sizes, vocab, ids)
                said = sorted(said, key=lambda s: s["shard"])
                cls, count = (np.concatenate([unpack(s[f], kind) for s in said]) for f, kind in (("cls", np.uint8), ("counts", np.int64)))
                c, n = cls[x.ids].astype(np.int64), count[x.ids]
                before = x.previous(c, int(cls[np.searchsorted(x.vocab, np.uint64(end))]) if end in x.vocab else 0)
                once = x.previous((n == 1).astype(np.int64), 0)
                moves = np.zeros((k + 1) * (k + 1), dtype=np.int64)
                for own, take in ((np.minimum(before, k), x.train), (np.full(len(c), k), x.train & (once == 1))):
                    moves += np.bincount((own * (k + 1) + np.minimum(c, k))[take], minlength=len(moves))
                    moves[k :: k + 1] += np.bincount(own[take & (n == 1)], minlength=k + 1)
                yield batch(schema, [docs], [sizes], [ids], [pack(cls)], [pack(count)], [moves.tobytes()])

    return with_classes(made, told).select("docs", "sizes", "vocab", "ids", "said").mapInArrow(run, "docs array<long>, sizes array<long>, ids binary, cls binary, counts binary, moves binary")


def transitions(done: DataFrame, k: int) -> np.ndarray:
    """(k + 1)^2 counts summed over blocks: row k, what follows a word seen once; column k, words seen once."""
    schema = pa.schema([("i", pa.int32()), ("n", pa.int64())])

    def run(batches):
        held = np.zeros((k + 1) * (k + 1), dtype=np.int64)
        for b in batches:
            for v in b.column(0).to_pylist():
                held += np.frombuffer(v, np.int64)
        used = np.flatnonzero(held)
        yield batch(schema, used.astype(np.int32), held[used])

    out = np.zeros((k + 1) * (k + 1), dtype=np.int64)
    for r in done.select("moves").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r.i] = r.n
    return out.reshape(k + 1, k + 1)


def sweeps(made: DataFrame, k: int, core: int, most: int, n_shards: int) -> DataFrame:
    """What the last sweep told, after exchange sweeps over the whole training vocabulary."""
    heads = core_words(made, core)
    classes = exchange(core_bigrams(made, heads), k) if len(heads) else np.zeros(0, dtype=np.int64)
    told, m = None, class_bigrams(made, None, heads, classes, k)
    began = was = likelihood(m)
    for _ in range(max(1, most)):
        new = materialize(answers(made, told, heads, classes, m, n_shards), "answers")
        moved = new.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]
        m = class_bigrams(made, new, heads, classes, k)
        now = likelihood(m)
        if told is not None and now < was:
            break
        told = new
        if not moved or now - was <= 1e-3 * (now - began):
            break
        was = now
    return told


def scores(docs: DataFrame, n_classes: int = 32, core: int = 512, share: float = 0.02, most_sweeps: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document; see SCORES.

    Training rows: those whose id's text has a crc32 not divisible by 10; a null id counts as held out.
    Null and empty texts are the end mark alone. base_score is the unigram score with 0.1 added to each
    count. Repeated rows are trained on and scored each; an empty table gives no rows; texts of any length
    are whole. Without training rows all words are unknown. Extra columns are left out.
    """
    k = n_classes
    if not 2 <= k < NONE:
        raise ValueError(f"classes are one byte: 2 to {NONE - 1}")
    n_parts = partitions(docs.sparkSession)
    # kept by block, so that a sweep moves the words' classes and not the corpus
    made = corpus(texts(docs, id_col, text_col)).repartition(n_parts, "block").persist(StorageLevel.DISK_ONLY)
    told = sweeps(made, k, core, most_sweeps, n_parts)
    done = materialize(resolved(made, told, k), "resolved")
    made.unpersist()
    moves = transitions(done, k)
    n, v = (int(x) for x in told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())

    known = moves[:, :k].astype(np.float64)
    seen = known.sum(axis=1)
    of_class = known[:k].sum(axis=0)
    prior = (of_class + 1e-9) / (of_class.sum() + 1e-9 * k)
    follow = (known + 4 * prior[None, :]) / (seen + 4)[:, None]
    unknown = (moves[:, k] + 0.5) / (seen + 1)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for docs_, sizes, ids, cls, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sizes, at = np.array(sizes, dtype=np.int64), unpack(ids, np.uint32).astype(np.int64)
                cls, counts = np.minimum(unpack(cls, np.uint8).astype(np.int64), k), unpack(counts, np.int64)
                first = np.cumsum(sizes) - sizes
                c, x = cls[at], counts[at].astype(np.float64)
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[first] = c[first[0] + sizes[0] - 1]  # the end mark's class
                own = np.minimum(c, k - 1)
                word = (1 - share) * follow[before, own] * x / np.maximum(of_class[own], 1) + share * x / max(n, 1)
                p = np.where(x > 0, (1 - unknown[before]) * word, unknown[before])
                base = np.log10((x + 0.1) / (n + 0.1 * (v + 1)))
                add = lambda y: np.add.reduceat(y, first)
                yield batch(schema, docs_, [is_held_out(i) for i in docs_], sizes, add((x > 0).astype(np.int64)), [n] * len(docs_), add(base), add(np.log10(p)))

    return done.select("docs", "sizes", "ids", "cls", "counts").mapInArrow(run, SCORES)
