"""Postings in blocks: the stored form of an index's postings.

A block is some thousand chunks of one task. It has a head, a row without a term, that holds its chunks' ids,
their files and lengths, and a row for each term: which of the block's chunks hold it, as 16-bit places, and
how often. Terms are inverted inside the task that reads the chunks, so no posting is shuffled or repeats an id.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.stem import porter
from textloom.operators import rows as in_rows

SCHEMA = "term string, stem string, block string, n long, cnt long, at binary, tf binary, chunk_ids array<string>, file_uids array<string>, dl array<int>"
_ARROW = pa.schema([("term", pa.string()), ("stem", pa.string()), ("block", pa.string()), ("n", pa.int64()), ("cnt", pa.int64()), ("at", pa.binary()), ("tf", pa.binary()), ("chunk_ids", pa.list_(pa.string())), ("file_uids", pa.list_(pa.string())), ("dl", pa.list_(pa.int32()))])
SIZE, BYTES = 4096, 16 << 20  # chunks of a block, and bytes of their texts, at most


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _block(chunk_ids: list, file_uids: list, texts: list, stems: dict) -> pa.RecordBatch:
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    found: list = []
    dl = []
    for t in texts:
        w = in_rows.words(t)
        dl.append(len(w))
        found += map(known.__getitem__, w)
    names = np.array(list(known) or [b""], object)
    order = np.argsort(names, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    cell, tf = np.unique(rank[np.array(found, np.int64)] * SIZE + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    term, first = np.unique(cell // SIZE, return_index=True)
    bounds = np.append(first, len(cell)).astype(np.int64)
    terms = [names[i].decode() for i in order[term]]
    width = np.uint8 if tf.max(initial=0) < 256 else np.uint16 if tf.max() < 65536 else np.uint32
    n = len(terms)
    cnt = np.add.reduceat(tf, first) if n else np.zeros(0, np.int64)
    none = pa.nulls(n, pa.list_(pa.string()))
    made = [
        pa.array(terms, pa.string()), pa.array([stems[t] for t in terms], pa.string()), pa.array([uuid.uuid4().hex] * (n + 1), pa.string()), pa.array(np.diff(bounds), pa.int64()), pa.array(cnt, pa.int64()),
        _binary((cell % SIZE).astype(np.uint16), bounds), _binary(tf.astype(width), bounds),
    ]
    head = [pa.nulls(1, f.type) for f in _ARROW]
    head[3], head[4] = pa.array([len(dl)], pa.int64()), pa.array([sum(dl)], pa.int64())
    lists = [pa.array([x], f.type) for x, f in zip((chunk_ids, file_uids, dl), list(_ARROW)[7:], strict=True)]
    columns = [pa.concat_arrays([h, m]) if i != 2 else m for i, (h, m) in enumerate(zip(head[:7], made, strict=True))]
    columns += [pa.concat_arrays([x, none.cast(x.type) if x.type != none.type else none]) for x in lists]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class _Stems(dict):
    def __missing__(self, term: str) -> str:
        if len(self) > 300_000:
            self.clear()
        s = self[term] = porter(term)
        return s


def packed(chunks: DataFrame) -> DataFrame:
    """Blocks (SCHEMA) of chunks (chunk_id, file_uid, text)."""

    def run(batches):
        stems, ids, uids, texts, load = _Stems(), [], [], [], 0
        for b in batches:
            for i, u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                if ids and (len(ids) == SIZE or load > BYTES):
                    yield _block(ids, uids, texts, stems)
                    ids, uids, texts, load = [], [], [], 0
                ids.append(i)
                uids.append(u)
                texts.append(t)
                load += len(t or b"")
        if ids:
            yield _block(ids, uids, texts, stems)

    return chunks.select("chunk_id", "file_uid", "text").mapInArrow(run, SCHEMA)


def heads(postings: DataFrame) -> DataFrame:
    """(block, at, chunk_id, file_uid, dl, and other columns): the chunks of blocks."""
    more = [c for c in postings.columns if c not in {f.split()[0] for f in SCHEMA.split(", ")}]
    each = postings.filter("term is null").select("block", *more, F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("dl") - 1).alias("at"), "chunk_ids", "file_uids", "dl")).alias("c"))
    return each.select("block", *more, F.col("c.at").alias("at"), F.col("c.chunk_ids").alias("chunk_id"), F.col("c.file_uids").alias("file_uid"), F.col("c.dl").cast("long").alias("dl"))


def unpacked(postings: DataFrame, entries: DataFrame) -> DataFrame:
    """(term, stem, chunk_id, file_uid, tf, dl) of blocks' rows and the chunks (block, at, chunk_id, file_uid, dl) that count."""
    schema = pa.schema([("term", pa.string()), ("stem", pa.string()), ("block", pa.string()), ("at", pa.int32()), ("tf", pa.int64())])

    def run(batches):
        for b in batches:
            for o in range(0, b.num_rows, 512):
                part = b.slice(o, 512)
                places, times = zip(*map(_places, part.column(3).to_pylist(), part.column(4).to_pylist()), strict=True)
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(p) for p in places]))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in range(3)), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(times), pa.int64())], schema=schema)

    each = postings.filter("term is not null").select("term", "stem", "block", "at", "tf").mapInArrow(run, "term string, stem string, block string, at int, tf long")
    return each.join(entries.select("block", "at", "chunk_id", "file_uid", "dl"), ["block", "at"]).select("term", "stem", "chunk_id", "file_uid", "tf", "dl")


def _places(at: bytes, tf: bytes) -> tuple[np.ndarray, np.ndarray]:
    places = np.frombuffer(at, np.uint16)
    return places, np.frombuffer(tf, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(tf) // len(places)])


def marked(entries: DataFrame) -> dict[str, bytes]:
    """Of each block the places of some chunks (block, at), a bit for each chunk: small enough for the driver and for each task."""

    def run(table: pa.Table) -> pa.Table:
        bits = np.zeros(SIZE, np.uint8)
        bits[table.column(1).to_numpy()] = 1
        return pa.table({"block": table.column(0)[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return {r.block: bytes(r.bits) for r in entries.select("block", "at").groupBy("block").applyInArrow(run, "block string, bits binary").collect()}


def counted(postings: DataFrame, which: dict[str, bytes]) -> DataFrame:
    """(term, df, cnt) over the marked chunks alone."""
    schema = pa.schema([("term", pa.string()), ("df", pa.int64()), ("cnt", pa.int64())])

    def run(batches):
        bits = {k: np.unpackbits(np.frombuffer(v, np.uint8)).astype(bool) for k, v in which.items()} if len(which) < 20_000 else None
        for b in batches:
            n, cnt = [], []
            for block, at, tf in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                places, times = _places(at, tf)
                held = (bits[block] if bits is not None else np.unpackbits(np.frombuffer(which[block], np.uint8)).astype(bool))[places]
                n.append(int(held.sum()))
                cnt.append(int(times[held].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cnt, pa.int64())], schema=schema)

    inside = postings.filter("term is not null").join(F.broadcast(postings.sparkSession.createDataFrame([(k,) for k in which], "block string")), "block", "left_semi")
    each = inside.select("term", "block", "at", "tf").mapInArrow(run, "term string, df long, cnt long").filter("df > 0")
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt"))


def best(postings: DataFrame, entries: DataFrame, asked: in_rows.Asked, k: int | None, avgdl: float, k1: float, b: float, sign: int = 1, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score): of each block the k best chunks (entries: those that count) of each query, as rows.best.
    Rows of the asked terms meet their block's chunks; no posting stands for itself."""
    spark = postings.sparkSession
    schema, ddl = in_rows.out_schema(asked, key, "string", ("score", "double"))
    terms = spark.createDataFrame([(t, i) for i, t in enumerate(asked.terms)], "term string, i int")
    rows = postings.filter("term is not null").join(F.broadcast(terms), "term").select("block", "i", "at", "tf")
    most = max(1, in_rows.CELLS // max(1, len(asked.ids)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = in_rows.Best(len(asked.ids), 1, k)
        if left.num_rows and right.num_rows:
            places, times = zip(*map(_places, left.column("at").to_pylist(), left.column("tf").to_pylist()), strict=True)
            place = np.full(SIZE, -1)
            place[right.column("at").to_numpy()] = np.arange(right.num_rows)
            term = np.repeat(left.column("i").to_numpy(), [len(p) for p in places])
            row, tf = place[np.concatenate(places)], np.concatenate(times).astype(np.int64)
            keys, dl = in_rows.key_array(right.column("chunk_id").combine_chunks()), right.column("dl").to_numpy().astype(float)
            o = np.lexsort((term, row))
            row, tf, term = row[o], tf[o], term[o]
            for at in range(0, right.num_rows, most):
                x = slice(*np.searchsorted(row, [at, at + most]))
                n = min(most, right.num_rows - at)
                held.add(keys[at : at + n], np.zeros(n, np.int64), in_rows.saturated(asked, row[x] - at, term[x], tf[x], dl[at : at + n], avgdl, k1, b, n))
        q, found, s = held.drain()
        return pa.Table.from_arrays([*in_rows.out_columns(asked, q, found if len(found) else np.zeros(0, "S1"), "string"), pa.array(sign * s)], schema=schema)

    return rows.groupBy("block").cogroup(entries.select("block", "at", "chunk_id", "dl").groupBy("block")).applyInArrow(run, ddl)
