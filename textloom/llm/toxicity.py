"""Toxicity by weak supervision.

1. Lexicons. From a bounded sample of labelled training rows: words and word beginnings (with how often a
   text must hold them) that come far more often in toxic texts.
2. Voters. Each strong lexicon entry, groups of the rest, and patterns over the density of hits vote toxic
   or abstain; silence voters vote clean.
3. Label model. A generative model of the votes alone: class balance, and each voter's chances by class,
   by expectation maximisation; voters that agree beyond what the classes explain are correlated, and share
   one vote's weight.
4. A linear classifier on lexicon features and densities is trained on the posterior labels.

Every row is scored from its whole text. Only the text is an input.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blocks, held_out, materialize, texts

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_LETTERS = re.compile(r"[^\W\d_]+")
TIMES = (1, 2, 3, 5)


def tokens(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def entries(word: str) -> list[str]:
    """The lexicon entries that a word may count for: itself and its beginnings."""
    return ["=" + word, *(word[:n] + "*" for n in range(4, min(9, len(word) + 1)))]


@dataclass
class Model:
    """Features of a text: for each lexicon entry and number of times, whether it comes that often; then
    the densities of strong and of all hits."""

    lexicon: dict[str, int]
    need: list[tuple[int, int]]
    strong: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    _seen: dict = field(default_factory=dict)

    def hits(self, word: str) -> tuple[int, ...]:
        found = self._seen.get(word)
        if found is None:
            if len(self._seen) > 100_000:
                self._seen.clear()
            found = self._seen[word] = tuple(self.lexicon[e] for e in entries(word) if e in self.lexicon)
        return found

    def features(self, text: str) -> tuple[list[int], np.ndarray]:
        words = tokens(text)
        count: Counter = Counter()
        strong = any_ = 0
        for h in filter(None, map(self.hits, words)):
            count.update(h)
            any_ += 1
            strong += bool(self.strong[list(h)].any())
        on = [i for i, (e, t) in enumerate(self.need) if count.get(e, 0) >= t] if count else []
        n = max(len(words), 1)
        return on, np.array([1.0, min(1.0, 20 * strong / n), min(1.0, 20 * any_ / n), np.log1p(strong), np.log1p(any_)])

    def score(self, text: str) -> float:
        on, dense = self.features(text)
        z = float(self.weights[on].sum() + self.weights[len(self.need) :] @ dense)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}


def entry_counts(sample: DataFrame) -> DataFrame:
    """(entry, times, clean, toxic): for each lexicon entry and number of times, the texts of each label that
    hold it that often. Counted where the texts are, a bounded stretch at a time."""
    schema = pa.schema([("entry", pa.string()), ("times", pa.int32()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def run(batches):
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for held in blocks(rows, lambda r: len(r[0]), 1_000_000):
            found: dict[tuple[str, int], list[int]] = {}
            for text, label in held:
                count: Counter = Counter()
                for w, c in Counter(tokens(text)).items():
                    for e in entries(w):
                        count[e] += c
                for e, c in count.items():
                    for t in TIMES:
                        if c >= t:
                            found.setdefault((e, t), [0, 0])[label] += 1
            if found:
                yield batch(schema, [e for e, _ in found], [t for _, t in found], [c for c, _ in found.values()], [c for _, c in found.values()])

    made = sample.select("text", "toxic").mapInArrow(run, "entry string, times int, clean long, toxic long")
    return made.groupBy("entry", "times").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def induce(sample: DataFrame, n_clean: int, n_toxic: int, most: int = 600) -> Model:
    """Lexicons from labelled texts: the `most` best entries by smoothed log odds of texts that hold them
    often enough. Only these come to the driver."""
    odds = F.log((F.col("toxic") + 0.3) / (n_toxic + 1)) - F.log((F.col("clean") + 0.3) / (n_clean + 1))
    found = entry_counts(sample).filter(F.col("toxic") >= max(3, int(0.01 * n_toxic))).withColumn("odds", odds).filter("odds > 1.8")
    ranked = found.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "entry", "times").limit(most).collect()
    lexicon: dict[str, int] = {}
    need = [(lexicon.setdefault(r.entry, len(lexicon)), r.times) for r in ranked]
    strong = np.zeros(len(lexicon), dtype=bool)
    for (i, t), r in zip(need, ranked, strict=True):
        strong[i] |= t == 1 and r.odds > 3
    return Model(lexicon, need, strong)


def votes(on: np.ndarray, dense: np.ndarray, alone: int = 48, groups: int = 12) -> np.ndarray:
    """A row for each text, a column for each voter: 1 toxic, -1 clean, 0 silent."""
    n, f = on.shape
    cols = [on[:, j].astype(int) for j in range(min(alone, f))]
    cols += [on[:, alone + g :: groups].any(axis=1).astype(int) for g in range(groups) if alone + g < f]
    for j, limits in ((1, (0.1, 0.3)), (3, (0.5, 1.0)), (4, (1.0, 2.0))):
        cols += [(dense[:, j] >= x).astype(int) for x in limits]
        cols.append(-(dense[:, j] <= 0).astype(int))
    cols.append(-(~on.any(axis=1)).astype(int))
    return np.stack(cols, axis=1)


def label_model(v: np.ndarray, balance: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic, accuracies, share of a vote that each voter's correlations leave it), from votes
    alone and the class balance."""
    yes, no = v == 1, v == -1
    lean = yes.sum(axis=1) - 2.0 * no.sum(axis=1)
    post = np.where(lean > 0, 0.9, 0.03)
    weight = np.ones(v.shape[1])
    for step in range(rounds):
        w1, w0 = post.sum() + 1, (1 - post).sum() + 1
        p1 = [(post @ x + 0.2) / w1 for x in (yes, no)]
        p0 = [((1 - post) @ x + 0.2) / w0 for x in (yes, no)]
        if step == rounds // 3:  # correlations: what two voters share within the classes
            r = v - (post[:, None] * (p1[0] - p1[1]) + (1 - post)[:, None] * (p0[0] - p0[1]))
            sd = r.std(axis=0) + 1e-9
            corr = (r.T @ r) / len(v) / np.outer(sd, sd)
            np.fill_diagonal(corr, 1)
            weight = 1 / np.where(np.abs(corr) > 0.25, np.abs(corr), 0).sum(axis=1)
        l1 = yes * np.log(p1[0] / p0[0]) + no * np.log(p1[1] / p0[1])
        z = np.log(balance / (1 - balance)) + l1 @ weight
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    right = (post @ yes + (1 - post) @ no) / np.maximum(1, (v != 0).sum(axis=0))
    return post, right, weight


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        s = p * (1 - p) + 1e-6
        step = np.linalg.solve((x * s[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, most: int = 6000, modulus: int = 5) -> DataFrame:
    """Labelled training texts (doc_id, text, toxic), stored: at most `most` labelled ids, in the order of a
    hash. Of the texts of one id the least is taken, of its labels the greatest."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(modulus))
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")  # `most` rows
    return materialize(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")


def features_of(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries that a text holds often enough, densities, label) of the sample, in the order of its ids.
    Features are made on the executors; no text comes to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("found", pa.list_(pa.int32())), ("dense", pa.list_(pa.float64()))])

    def run(batches):
        m = shared.value
        for b in batches:
            made = [m.features(t) for t in b.column(1).to_pylist()]
            yield batch(schema, b.column(0), b.column(2), [f for f, _ in made], [d.tolist() for _, d in made])

    t = rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, found array<int>, dense array<double>").toArrow().sort_by("doc_id")
    on = np.zeros((t.num_rows, len(model.need)), dtype=bool)
    for i, f in enumerate(t.column("found").to_pylist()):
        on[i, f] = True
    return on, np.array(t.column("dense").to_pylist(), dtype=float).reshape(t.num_rows, -1), t.column("toxic").to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, most: int = 6000, modulus: int = 5) -> Model:
    """A model from labelled texts. Without toxic or clean ones: each text scores the smoothed share."""
    rows = sample(docs, labels, most, modulus)
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    share = (toxic + 0.5) / (clean + toxic + 1) if n else 0.25
    if not clean or not toxic:
        return Model({}, [], np.zeros(0, dtype=bool), np.array([np.log(share / (1 - share)), 0, 0, 0, 0]))
    model = induce(rows, clean, toxic)
    on, dense, y = features_of(rows, model)
    post, _, _ = label_model(votes(on, dense), share)
    x = np.concatenate([on, dense], axis=1, dtype=float)
    model.weights = fit_linear(x, post)
    z = x @ model.weights
    cut = np.unique(z)
    mids = np.concatenate([[cut[0] - 1], (cut[1:] + cut[:-1]) / 2, [cut[-1] + 1]])
    order = np.sort(z[y == 1]), np.sort(z[y == 0])
    wrong = np.searchsorted(order[0], mids) + len(order[1]) - np.searchsorted(order[1], mids)
    good = mids[wrong == wrong.min()]
    model.weights[len(model.need)] -= good[np.argmin(np.abs(good))]  # 0.5 where fewest labels of the sample disagree
    return model


def score(docs: DataFrame, labels: DataFrame, most: int = 6000, modulus: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs.

    The classifier is fitted on at most `most` labelled rows with crc32(doc_id) mod `modulus` not 0; all
    rows are scored, in one scan. Null and empty texts score as texts without words. A null doc_id counts
    as held out. Repeated rows are scored each; an empty table gives no rows; without labels every score
    is the same. Extra columns are left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most, modulus))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        m = model.value
        for b in batches:
            s = [m.score(t) for t in b.column(2).to_pylist()]
            yield batch(schema, b.column(0), b.column(1), s, [int(x >= 0.5) for x in s])

    return texts(docs).select("doc_id", F.coalesce(held_out(modulus), F.lit(True)).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows whose score is 0.5 or more, in one scan; all columns stay as they are.

    Null and empty texts score as texts without words, and each row of a repeated one is judged alike; long
    texts are read whole. Labels are joined by `doc_id` for training only, so rows of a null id are judged
    as well. An empty table gives no rows. Columns other than `doc_id` and `text` may have any name.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def run(batches):
        m = model.value
        for b in batches:
            yield b.filter(pa.array([m.score(t or "") < 0.5 for t in b.column(b.schema.names.index("text")).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
