"""Quality classifier by co-training of a text view and a metadata view.

Both views are logistic models over sparse binary features.  The text view has the
shape of a text (shares of symbols, capitals, bars, repeats, ... in bins) and those
words that tell the labels apart; the metadata view has language, source and length.
In each round either model labels all documents that aren't labelled, and some of those
it is sure of join the other's training set.  Scores of labelled rows by views that were
fitted without them calibrate both views and fit the combination, by which every
document is scored; rows that are used for nothing else measure the accuracy.

The labelled rows that are fitted on are a bounded sample, chosen by a hash of doc_id:
``LABELLED`` at most.  The unlabelled ones are all others: they are reduced to their few
features once, and scored in each round where they lie.  ``PER_ROUND`` of those that a
view is sure of, for each label, change hands; which ones, a hash decides.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

#: Bound of the labelled sample; words of the model, rows that a word must be in, its least chi-square statistic.
LABELLED = 8000
WORDS, LEAST_ROWS, LEAST_CHI, PENALTY = 2000, 4, 8.0, 3e-4
#: Of five parts of the labelled rows the last only measures; the others train, and are each other's folds for calibration.
PARTS, TRAIN = 5, (0, 1, 2, 3)
SHAPES = 256
ROUNDS, PER_ROUND, SURE = 3, 300, 0.97
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_SOURCE_BINS = 4096  # feature numbers stay below 2^15
#: Edges of the bins of each shape.
_EDGES = {
    "symbols": (0.001, 0.01, 0.03, 0.08, 0.2, 0.5), "bars": (0.001, 0.02, 0.06, 0.15, 0.3, 0.45), "capitals": (0.02, 0.05, 0.12, 0.3, 0.6, 0.9),
    "bangs": (0.001, 0.01, 0.05, 0.2, 0.5, 0.9), "digits": (0.001, 0.01, 0.05, 0.15, 0.4, 0.8), "distinct": (0.1, 0.2, 0.3, 0.45, 0.6, 0.8),
    "word_length": (2.5, 3.5, 4.5, 5.5, 7, 9), "stops": (0.1, 0.3, 0.5, 0.7, 0.9, 0.99), "repeats": (0.005, 0.02, 0.06, 0.15, 0.3, 0.6), "words": (3, 10, 30, 100, 1000, 10000),
}


def shape(text: str) -> list[int]:
    """Bin numbers of the shape of a text (0 .. SHAPES - 1), one for each kind."""
    tokens = text.split()
    n = len(tokens) or 1
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    value = {
        "symbols": sum(map(text.count, "#*$%&<>")) / n,
        "bars": text.count("|") / n,
        "capitals": sum(1 for t in tokens if t.isupper()) / n,
        "bangs": text.count("!") / n,
        "digits": sum(map(text.count, "0123456789")) / n,
        "distinct": len(set(tokens)) / math.sqrt(n) / 10,
        "word_length": sum(map(len, tokens)) / n,
        "stops": sum(x[-1] in ".!?\"')…" for x in lines) / (len(lines) or 1),
        "repeats": sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n,
        "words": len(tokens),
    }
    return [16 * k + int(np.searchsorted(edges, value[name], "right")) for k, (name, edges) in enumerate(_EDGES.items())]


def word_keys(text: str) -> set[str]:
    """The distinct lower-case words of the whole text, and the beginnings of longer ones (marked by a dash)."""
    words = set(_WORD.findall(" ".join(set(text.lower().split()))))
    return words | {w[:4] + "-" for w in words if len(w) > 4}


def metadata_keys(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    length = min(40, int(2 * math.log2(max(1, n_chars or 1))))
    return [length, 64 + zlib.crc32(f"lang {lang}".encode()) % _SOURCE_BINS, 64 + _SOURCE_BINS + zlib.crc32(f"source {source}".encode()) % _SOURCE_BINS]


@dataclass
class Linear:
    """Weights of binary features; unknown features count nothing."""

    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, keys) -> float:
        w = self.weights
        return self.bias + sum(w[k] for k in keys if k in w)

    def scores(self, rows: Rows) -> np.ndarray:
        z, names = np.full(len(rows), self.bias), np.array(sorted(self.weights), np.int64)
        if len(names):
            at, col = rows.only(names)
            z += np.bincount(at, weights=np.array([self.weights[k] for k in names.tolist()])[col], minlength=len(rows))
        return z


class Rows:
    """Sparse binary rows: all feature numbers one after the other, and how many each row has."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat, self.counts = flat, counts
        self.ends = np.cumsum(counts)

    @classmethod
    def of(cls, rows) -> Rows:
        rows = [np.asarray(sorted(r), np.int64) for r in rows]
        return cls(np.concatenate([np.empty(0, np.int64), *rows]), np.array([len(r) for r in rows], np.int64))

    @classmethod
    def of_lists(cls, lists) -> Rows:
        """Of an Arrow array of lists."""
        return cls(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64))

    def __len__(self) -> int:
        return len(self.counts)

    def take(self, at: np.ndarray) -> Rows:
        at = np.asarray(at, np.int64)
        n = self.counts[at]
        return Rows(self.flat[np.repeat(self.ends[at] - np.cumsum(n), n) + np.arange(n.sum())], n)

    def __add__(self, other: Rows) -> Rows:
        return Rows(np.append(self.flat, other.flat), np.append(self.counts, other.counts))

    def only(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in the sorted ``keep``) of each feature that is in it."""
        place = np.minimum(np.searchsorted(keep, self.flat), len(keep) - 1)
        inside = keep[place] == self.flat
        return np.repeat(np.arange(len(self)), self.counts)[inside], place[inside]


def fit(rows: Rows, y: np.ndarray, keep: np.ndarray, steps: int = 200) -> Linear:
    """Logistic regression over the features in ``keep`` (sorted), each scaled by its log odds ratio, with quadratic penalty."""
    if not len(keep):
        return Linear()
    at, col = rows.only(keep)
    n1 = np.bincount(col, weights=y[at], minlength=len(keep))
    n0 = np.bincount(col, minlength=len(keep)) - n1
    ratio = np.log((n1 + 0.5) / (y.sum() + 1)) - np.log((n0 + 0.5) / ((1 - y).sum() + 1))
    value = ratio[col]
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    energy = np.bincount(at, weights=value**2, minlength=len(y))
    rate = 4.0 / (1 + np.quantile(energy, 0.9))
    w, speed, b = np.zeros(len(keep)), np.zeros(len(keep) + 1), 0.0
    for _ in range(steps):
        z = b + np.bincount(at, weights=w[col] * value, minlength=len(y))
        e = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.append(np.bincount(col, weights=e[at] * value, minlength=len(keep)) + PENALTY * w, e.sum())
        speed = 0.9 * speed - rate * g
        w, b = w + speed[:-1], b + speed[-1]
    return Linear(float(b), dict(zip(keep.tolist(), (w * ratio).tolist(), strict=True)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that calibrate scores."""
    a, b = newton(z[:, None], y)
    return float(a), float(b)


def newton(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression on few dense columns; the intercept comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


@dataclass
class Model:
    """Two calibrated views and their combination; ``words`` has the number of each word that counts."""

    text: Linear
    meta: Linear
    text_fit: tuple[float, float]
    meta_fit: tuple[float, float]
    mix: tuple[float, float, float]
    words: dict[str, int] = field(default_factory=dict)
    held_out: dict[str, float] = field(default_factory=dict)

    def probability(self, text_keys, meta_keys) -> tuple[float, float, float]:
        """Calibrated text view, calibrated metadata view, both combined."""
        t = self.text_fit[0] * self.text.score(text_keys) + self.text_fit[1]
        m = self.meta_fit[0] * self.meta.score(meta_keys) + self.meta_fit[1]
        z = self.mix[0] * t + self.mix[1] * m + self.mix[2]
        return tuple(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in (t, m, z))


def text_keys(text: str, words: dict[str, int]) -> list[int]:
    """Feature numbers of a text: its shape, and those of ``words`` that it has."""
    return shape(text) + sorted(SHAPES + words[w] for w in word_keys(text) & words.keys())


#: Asked for rows that the views are sure of: (models, round) -> for each view that learns, text rows, metadata rows, labels.
Confident = Callable[[dict[str, Linear], int], dict[str, tuple[Rows, Rows, np.ndarray]]]


def co_train(text: Rows, meta: Rows, y: np.ndarray, part: np.ndarray, confident: Confident | None = None) -> Model | None:
    """Fit on labelled rows, by their ``part``, and on what ``confident`` gives in each round; None unless both classes have five rows or more.

    Where a part lacks a class, all rows serve for everything.
    """
    y = np.asarray(y, float)
    if min(y.sum(), len(y) - y.sum()) < 5:
        return None
    alone = all(len(set(y[part == p].tolist())) == 2 for p in range(PARTS))
    train = np.flatnonzero(np.isin(part, TRAIN)) if alone else np.arange(len(y))
    measure = np.flatnonzero(~np.isin(part, TRAIN)) if alone else train
    views = {"text": text, "meta": meta}
    more = {v: (Rows.of(()), np.empty(0)) for v in views}

    def fitted(view: str, at: np.ndarray) -> Linear:
        rows, labels = views[view].take(at) + more[view][0], np.append(y[at], more[view][1])
        return fit(rows, labels, np.unique(rows.flat))

    models = {v: fitted(v, train) for v in views}
    for turn in range(ROUNDS if confident else 0):
        for view, (more_text, more_meta, labels) in confident(models, turn).items():
            more[view] = (more[view][0] + (more_text if view == "text" else more_meta), np.append(more[view][1], labels))
        models = {v: fitted(v, train) for v in views}
    z = {v: models[v].scores(views[v].take(train)) for v in views}
    for p in TRAIN if alone else ():
        out = part[train] == p
        for v in views:
            z[v][out] = fitted(v, train[~out]).scores(views[v].take(train[out]))
    fits = {v: _platt(z[v], y[train]) for v in views}

    def both(z: dict[str, np.ndarray]) -> np.ndarray:
        return np.column_stack([fits[v][0] * z[v] + fits[v][1] for v in ("text", "meta")])

    mix = newton(both(z), y[train], 1.0)
    right = ((both({v: models[v].scores(views[v].take(measure)) for v in views}) @ mix[:2] + mix[2] >= 0) == (y[measure] > 0)).mean()
    return Model(models["text"], models["meta"], fits["text"], fits["meta"], tuple(map(float, mix)), {}, {"rows": float(len(measure)), "accuracy": float(right)})


_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """The columns that are looked at, by one type; a missing one is null."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) if c in docs.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in _COLUMNS))


@lean
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words: list[str] = []
        good: list[int] = []
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
            own = word_keys(text or "")
            words += own
            good += [y] * len(own)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(good, pa.int32())], names=["word", "y"])


def vocabulary(sample: DataFrame, most: int = WORDS) -> dict[str, int]:
    """The ``most`` words of ``sample(text, y)`` with the largest chi-square statistics against y, numbered."""
    total, good = sample.agg(F.count("*"), F.sum("y")).first()
    if not total or not 0 < good < total:
        return {}
    expected = F.col("n") * (good / total)
    chi = F.pow(F.col("n1") - expected, 2) / (expected * (1 - F.col("n") / total) * (1 - good / total) + 1e-9)
    counts = sample.mapInArrow(_words, "word string, y int").groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("n1"))
    found = counts.where(F.col("n") >= LEAST_ROWS).select("word", F.round(chi, 6).alias("chi")).where(F.col("chi") > LEAST_CHI)
    return {r["word"]: k for k, r in enumerate(found.orderBy(F.desc("chi"), "word").limit(most).collect())}


def _reduced(docs: DataFrame, words: dict[str, int], *more: str) -> DataFrame:
    """(doc_id, keys, meta, more ...) of each row of ``docs`` whose text has a word."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array([bool(t and t.strip()) for t in b.column("text").to_pylist()], pa.bool_()))
            keys = [text_keys(t, sent.value) for t in b.column("text").to_pylist()]
            meta = [metadata_keys(*row) for row in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, _SHORTS), pa.array(meta, _SHORTS), *(b.column(c) for c in more)], names=["doc_id", "keys", "meta", *more])

    return docs.mapInArrow(run, ", ".join(["doc_id long, keys array<short>, meta array<short>", *(f"{c} int" for c in more)]))


_SHORTS = pa.list_(pa.int16())
#: Rows that a view is sure of are of kind 2 * (0: text view, 1: metadata view) + label.
_KINDS = [(view, label) for view in ("text", "meta") for label in (0, 1)]


def _sure_of(pool: DataFrame, models: dict[str, Linear]) -> DataFrame:
    """(kind, order, keys, meta): the rows of ``pool`` that a view is sure of."""
    sent = pool.sparkSession.sparkContext.broadcast(models)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, (view, name) in enumerate((("text", "keys"), ("meta", "meta"))):
                p = 1 / (1 + np.exp(-np.clip(sent.value[view].scores(Rows.of_lists(b.column(name))), -30, 30)))
                for label, sure in ((0, 1 - p), (1, p)):
                    if (at := np.flatnonzero(sure >= SURE)).size:
                        rows = b.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2 * v + label, np.int32)), *(rows.column(c) for c in ("order", "keys", "meta"))], names=["kind", "order", "keys", "meta"])

    return pool.mapInArrow(run, "kind int, order long, keys array<short>, meta array<short>")


def _exchange(pool: DataFrame, per_round: int) -> Confident:
    """``per_round`` rows of each kind, those with the smallest hash; about twice as many reach the driver."""

    def confident(models: dict[str, Linear], turn: int) -> dict[str, tuple[Rows, Rows, np.ndarray]]:
        sure = _sure_of(pool.withColumn("order", F.shiftrightunsigned(F.xxhash64("doc_id", "keys", F.lit(turn)), 1)), models)
        counts = {r["kind"]: r["n"] for r in sure.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        out = {}
        below = {k: min(2 * per_round, n) * (2**63 - 1) // n for k, n in counts.items()}
        few = F.lit(False)
        for k, top in below.items():
            few = few | ((F.col("kind") == k) & (F.col("order") <= top))
        table = sure.where(few).orderBy("kind", "order", "keys").toArrow().to_pydict() if counts else {"kind": [], "keys": [], "meta": []}
        chosen: dict[str, list[tuple]] = {"text": [], "meta": []}
        taken = [0] * len(_KINDS)
        for kind, keys, meta in zip(table["kind"], table["keys"], table["meta"], strict=True):
            if taken[kind] < per_round:
                taken[kind] += 1
                view, label = _KINDS[kind]
                chosen["meta" if view == "text" else "text"].append((keys, meta, label))
        for view, rows in chosen.items():
            out[view] = (Rows.of(r[0] for r in rows), Rows.of(r[1] for r in rows), np.array([r[2] for r in rows], float))
        return out

    return confident


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, per_round: int = PER_ROUND) -> Model | None:
    """A model from ``labels(doc_id, quality, toxic)``: good is quality 1 and not toxic.

    Rows with null labels don't count; of several labels of a doc_id the lowest does;
    of rows that share a labelled doc_id the least counts; labels of documents that
    aren't there, and documents without words, are left out.  Fewer than five rows of a
    class, or no documents, give no model.
    """
    plain = _plain(docs)
    told = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("y")
    )
    order = F.xxhash64("doc_id", F.lit(11))
    # At most ``labelled`` rows of two numbers: 16 bytes each.
    some = F.broadcast(cut(told.orderBy(order, "doc_id").limit(labelled), few=True))
    one = plain.join(some, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*_COLUMNS[1:])).alias("r")).select("doc_id", "y", "r.*")
    sample = cut(one.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(PARTS)).cast("int")), few=True)
    words = vocabulary(sample.where(F.col("part").isin(*TRAIN)))
    table = _reduced(sample, words, "y", "part").orderBy("doc_id").toArrow()
    if not len(table):
        return None
    text, meta = (Rows.of_lists(table[c].combine_chunks()) for c in ("keys", "meta"))
    pool = cut(_reduced(plain.join(some, "doc_id", "left_anti"), words))
    model = co_train(text, meta, table["y"].to_numpy(), table["part"].to_numpy(), _exchange(pool, per_round))
    if model is not None:
        model.words = words
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns, and text_score, meta_score, quality_score (probabilities) and kept.

    A null text, or one without words, scores 0 and isn't kept.  Without a model scores
    are null and texts with words are kept.  The whole text is read, however long;
    repeated rows score alike; a null or missing lang, source or n_chars is a value of
    its own; columns of the added names are replaced, others stay; an empty table gives
    no rows.
    """
    added = ["text_score", "meta_score", "quality_score", "kept"]
    docs = docs.drop(*added)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{c} double" for c in added[:3]] + ["kept boolean"])
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            given = [b.column(c).to_pylist() if c in names else [None] * b.num_rows for c in ("lang", "source", "n_chars")]
            out: list[list] = [[], [], [], []]
            for text, lang, source, n_chars in zip(b.column("text"), *given, strict=True):
                text = text.as_py() or ""
                if not text.split():
                    row = (0.0, 0.0, 0.0, False)
                elif model is None:
                    row = (None, None, None, True)
                else:
                    p = model.probability(text_keys(text, model.words), metadata_keys(lang, source, n_chars))
                    row = (*(round(x, 6) for x in p), p[2] >= threshold)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = (pa.float64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[*names, *added])

    return docs.mapInArrow(run, schema)
