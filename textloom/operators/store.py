"""The stored index: tables in a folder, changed by segments.

A change writes one segment of each table it touches, `<root>/<table>/seq=<n>`, and then a row of the commit
table; what has no commit is not seen and is overwritten when the change is run again. Rows of a file are
dead once a later segment names the file in `gone`. Vocabulary and statistics are sums over segments (a
removal adds negative rows), so nothing is counted twice and no change rewrites the index; compact() does.
Postings are blocks (see blocks.py) made in the task that reads the chunks, and sorted by term inside a file,
so that a query's terms prune row groups and a word that every chunk holds doesn't land in one file.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import file_uid
from textloom.operators import blocks, chunk, index, rows as in_rows
from textloom.session import stored
from textloom.sources.files import extension_of

TABLES = {
    "commits": "kind string, at double",
    "files": "file_uid string, path string, size long, mtime double, content_sig string, version string, indexed_at double, status string, n_tokens long",
    "chunks": "chunk_id string, file_uid string, file_path string, ord int, chunk_type string, text string, text_hash binary",
    "postings": blocks.SCHEMA,
    "vocab": "term string, df long, cnt long",
    "totals": "files long, tokens long, rows long, row_tokens long",
    "vectors": "text_hash binary, model string, dim int, version string, vector array<double>, created double",
    "gone": "file_uid string",
    "dropped": "text_hash binary",
}


@dataclass
class Index:
    spark: SparkSession
    root: str
    version: str = "1"

    # ------------------------------------------------------------ segments

    def create(self) -> Index:
        """An empty index at root."""
        for name in TABLES:
            self._write(name, self.spark.createDataFrame([], TABLES[name]), 0)
        self._write("commits", self.spark.createDataFrame([("create", time.time())], TABLES["commits"]), 0)
        return self

    def _write(self, name: str, rows: DataFrame, seq: int) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}/seq={seq}")

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[name]}, seq int").parquet(f"{self.root}/{name}")

    def _state(self) -> tuple[int, int]:
        """(last committed segment, segment from which rows count)."""
        last, base = self._all("commits").agg(F.max("seq"), F.max(F.when(F.col("kind").isin("clear", "compact"), F.col("seq")))).first()
        return last, base or 0

    def _seen(self, name: str) -> DataFrame:
        last, base = self._state()
        return self._all(name).filter(F.col("seq").between(base, last))

    def _live(self, name: str) -> DataFrame:
        gone = self._seen("gone").groupBy("file_uid").agg(F.max("seq").alias("until"))
        rows = self._seen(name).join(gone, "file_uid", "left").filter("until is null or seq >= until")
        return rows.select(*(c.split()[0] for c in TABLES[name].split(", ")))

    # ------------------------------------------------------------ what is there

    def files(self) -> DataFrame:
        """The newest row of each file that is there."""
        columns = [c.split()[0] for c in TABLES["files"].split(", ")]
        gone = self._seen("gone").groupBy("file_uid").agg(F.max("seq").alias("until"))
        rows = self._seen("files").join(gone, "file_uid", "left").filter("until is null or seq >= until")
        return rows.groupBy("file_uid").agg(F.max_by(F.struct(*columns), "seq").alias("f")).select("f.*")

    def chunks(self) -> DataFrame:
        return self._live("chunks")

    def entries(self) -> DataFrame:
        """(block, at, chunk_id, file_uid, dl): the chunks that are there, by their place in the postings."""
        gone = self._seen("gone").groupBy("file_uid").agg(F.max("seq").alias("until"))
        rows = blocks.heads(self._seen("postings")).join(gone, "file_uid", "left").filter("until is null or seq >= until")
        return rows.select("block", "at", "chunk_id", "file_uid", "dl")

    def postings(self) -> DataFrame:
        """(term, stem, chunk_id, file_uid, tf, dl), a row for each term of a chunk."""
        return blocks.unpacked(self._seen("postings"), self.entries())

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Chunks that hold each of these terms."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        return {r.term: r.df for r in self._seen("vocab").join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").collect()}

    def best(self, asked: in_rows.Asked, k: int | None, avgdl: float, k1: float, b: float, sign: int = 1, within: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score) of chunks, as rows.best; within: (doc_id), the chunks that may be found."""
        entries = self.entries() if within is None else self.entries().join(within.select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")
        return blocks.best(self._seen("postings"), entries, asked, k, avgdl, k1, b, sign)

    def vocabulary(self) -> DataFrame:
        """(term, df, cnt)."""
        return self._seen("vocab").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt")).filter("df > 0")

    def totals(self) -> DataFrame:
        """One row (n, avgdl, rows, row_avgdl): files and their mean tokens, chunks with tokens and theirs."""
        t = self._seen("totals").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "tokens", "rows", "row_tokens")))
        mean = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
        return t.select(F.col("files").alias("n"), mean("tokens", "files").alias("avgdl"), "rows", mean("row_tokens", "rows").alias("row_avgdl"))

    def vectors(self, model: str, dim: int, version: str) -> DataFrame:
        """(text_hash, vector, created) of one model: of each text the newest."""
        dropped = self._seen("dropped").groupBy("text_hash").agg(F.max("seq").alias("until"))
        v = self._seen("vectors").filter((F.col("model") == model) & (F.col("dim") == dim) & (F.col("version") == version))
        v = v.join(dropped, "text_hash", "left").filter("until is null or seq >= until")
        return v.groupBy("text_hash").agg(F.max_by(F.struct("vector", "created"), F.struct("seq", "created")).alias("v")).select("text_hash", "v.vector", "v.created")

    def lookup(self, paths: DataFrame) -> DataFrame:
        return self.files().join(paths.select("path"), "path", "left_semi")

    def under(self, folder: str) -> DataFrame:
        """Active files below a folder."""
        return self.files().filter(F.col("path").startswith(folder.rstrip("/") + "/") & (F.col("status") == "active"))

    def unindexed(self, listing: DataFrame) -> DataFrame:
        """Paths of a listing that the index lacks."""
        return listing.select("path").join(self.files().filter("status = 'active'").select("path"), "path", "left_anti")

    def status(self) -> DataFrame:
        return index.status(self.files(), self.chunks(), self._seen("vectors"))

    # ------------------------------------------------------------ changes

    def _blocks(self, seq: int) -> DataFrame:
        """Write the postings of a segment's chunks; what was written."""
        made = self._all("chunks").filter(F.col("seq") == seq)
        self._write("postings", blocks.packed(made).sortWithinPartitions("term"), seq)
        return self._all("postings").filter(F.col("seq") == seq)

    def _commit(self, kind: str, files: DataFrame | None, gone: DataFrame | None, now: float | None, listed: DataFrame | None = None) -> Index:
        """files (path, size, mtime, text) are indexed, all that is there of the files `gone` (file_uid) goes first;
        `listed` are rows of the file table to write as they are."""
        seq, now = self._state()[0] + 1, time.time() if now is None else now
        one = lambda d: d.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
        vocab, totals = [], []
        if gone is not None:
            self._write("gone", gone.distinct(), seq)
            gone = self._all("gone").filter(F.col("seq") == seq).select("file_uid")
            lost = stored(self.entries().join(gone, "file_uid", "left_semi").select("block", "at", "dl"), "lost")
            away = blocks.counted(self._seen("postings"), blocks.marked(lost))
            vocab.append(away.select("term", (-F.col("df")).alias("df"), (-F.col("cnt")).alias("cnt")))
            totals += [(self.files().join(gone, "file_uid", "left_semi").filter("status = 'active'"), lost, -1)]
        table = [] if listed is None else [listed]
        if files is not None:
            text = files.select(file_uid(F.col("path")).alias("file_uid"), F.col("path").alias("file_path"), "path", "size", "mtime", "text")
            made = chunk.explode_chunks(text, extension_of(F.col("file_path")))
            self._write("chunks", made, seq)
            new = self._blocks(seq)
            vocab.append(new.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df"), F.sum("cnt").alias("cnt")))
            row = text.select("file_uid", "path", "size", "mtime", F.md5("text").alias("content_sig"), F.lit(self.version).alias("version"), F.lit(now).alias("indexed_at"), F.lit("active").alias("status"), in_rows.n_tokens(F.col("text")).alias("n_tokens"))
            table.append(row)
            table[-1] = row = stored(row, "files")
            totals += [(row, blocks.heads(new), 1)]
        if table:
            rows = table[0]
            for more in table[1:]:
                rows = rows.unionByName(more)
            self._write("files", rows, seq)
        for k, part in enumerate(vocab[1:]):
            vocab[0] = vocab[0].unionByName(part)
        if vocab:
            self._write("vocab", vocab[0], seq)
        sums = []
        for f, p, sign in totals:
            a, b = one(f), one(p.filter("dl > 0").select(F.col("dl").alias("n_tokens")))
            sums.append(a.crossJoin(b.toDF("rn", "rt")).select((sign * F.col("n")).alias("files"), (sign * F.coalesce("t", F.lit(0))).alias("tokens"), (sign * F.col("rn")).alias("rows"), (sign * F.coalesce("rt", F.lit(0))).alias("row_tokens")))  # single rows
        for part in sums[1:]:
            sums[0] = sums[0].unionByName(part)
        if sums:
            self._write("totals", sums[0], seq)
        self._write("commits", self.spark.createDataFrame([(kind, now)], TABLES["commits"]), seq)
        return self

    def build(self, files: DataFrame, now: float | None = None) -> Index:
        """A new index of files (path, size, mtime, text)."""
        return self.create()._commit("build", files, None, now)

    def refresh(self, files: DataFrame, now: float | None = None) -> Index:
        """Index what is new or changed in files (path, size, mtime, text). Where only size or time changed but
        not the text, the file table alone is touched. Rows under a path with another uid go."""
        had = stored(self.files(), "had")
        listed = files.select("path", "size", "mtime", F.md5("text").alias("sig"))  # what is judged; texts move once, below
        fresh = index.discover(listed, had, self.version).withColumn("file_uid", file_uid(F.col("path")))
        known = had.filter((F.col("status") == "active") & (F.col("version") == self.version)).select("file_uid", F.col("content_sig").alias("had"))
        judged = stored(fresh.join(known, "file_uid", "left").withColumn("same", F.coalesce(F.col("had") == F.col("sig"), F.lit(False))), "judged")
        changed = judged.filter("not same")
        moved = had.select("path", F.col("file_uid").alias("old")).join(changed.select("path", "file_uid"), "path").filter("old <> file_uid").select(F.col("old").alias("file_uid"))
        gone = had.select("file_uid").join(changed.select("file_uid"), "file_uid", "left_semi").unionByName(moved)
        texts = stored(files.select("path", "size", "mtime", "text").join(changed.select("path"), "path", "left_semi"), "changed")
        self._commit("refresh", texts, gone, now)
        touched = judged.filter("same").select("file_uid", F.col("size").alias("new_size"), F.col("mtime").alias("new_mtime"))
        return self if touched.isEmpty() else self._touch(touched, now)

    def _touch(self, touched: DataFrame, now: float | None) -> Index:
        """Only rows of the file table change; their chunks stay."""
        seq = self._state()[0]
        columns = [c.split()[0] for c in TABLES["files"].split(", ")]
        rows = self.files().join(touched, "file_uid").select(*(F.col({"size": "new_size", "mtime": "new_mtime"}.get(c, c)).alias(c) for c in columns))
        self._write("files", rows, seq + 1)
        self._write("commits", self.spark.createDataFrame([("touch", time.time() if now is None else now)], TABLES["commits"]), seq + 1)
        return self

    def sweep(self, listing: DataFrame, now: float | None = None, retention_days: float = 180) -> Index:
        """Files that the listing lacks become missing and lose their chunks; vectors that no chunk refers to,
        or older than the retention, go."""
        now = time.time() if now is None else now
        lost = self.files().filter("status = 'active'").join(listing.select("path"), "path", "left_anti").withColumn("status", F.lit("missing"))
        self._commit("sweep", None, lost.select("file_uid"), now, lost)
        return self.drop_vectors(now, retention_days)

    def drop_vectors(self, now: float | None = None, older_than_days: float | None = None) -> Index:
        """Vectors without a chunk go, and those older than so many days."""
        seq, now = self._state()[0] + 1, time.time() if now is None else now
        v = self._seen("vectors").groupBy("text_hash").agg(F.max("created").alias("created"))
        used = index.sweep_vectors(v, self.chunks(), now, 1e9 if older_than_days is None else older_than_days)
        self._write("dropped", v.join(used.select("text_hash"), "text_hash", "left_anti").select("text_hash"), seq)
        self._write("commits", self.spark.createDataFrame([("vectors", now)], TABLES["commits"]), seq)
        return self

    def remove(self, paths: DataFrame, now: float | None = None) -> Index:
        """Forget the files at these paths."""
        return self._commit("remove", None, self.lookup(paths).select("file_uid"), now)

    def put_vectors(self, vectors: DataFrame, now: float | None = None) -> Index:
        """Add vectors (text_hash, model, dim, version, vector, created); a newer one replaces an older one."""
        seq = self._state()[0] + 1
        self._write("vectors", vectors, seq)
        self._write("commits", self.spark.createDataFrame([("vectors", time.time() if now is None else now)], TABLES["commits"]), seq)
        return self

    def clear(self, now: float | None = None) -> Index:
        """Forget everything."""
        seq = self._state()[0] + 1
        self._write("commits", self.spark.createDataFrame([("clear", time.time() if now is None else now)], TABLES["commits"]), seq)
        return self

    def compact(self, now: float | None = None) -> Index:
        """The same index as one segment; older segments aren't read any more."""
        seq = self._state()[0]
        vectors = self._seen("vectors").join(self._seen("dropped").groupBy("text_hash").agg(F.max("seq").alias("until")), "text_hash", "left").filter("until is null or seq >= until")
        for name, rows in (("files", self.files()), ("chunks", self.chunks()), ("vocab", self.vocabulary()), ("vectors", vectors)):
            self._write(name, rows, seq + 1)
        self._blocks(seq + 1)
        t = self._seen("totals").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("files", "tokens", "rows", "row_tokens")))
        self._write("totals", t, seq + 1)
        self._write("commits", self.spark.createDataFrame([("compact", time.time() if now is None else now)], TABLES["commits"]), seq + 1)
        return self
