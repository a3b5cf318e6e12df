"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the hashed embeddings of the word and of its prefixes.
Filters of several widths run over the words of the whole text, each keeps its maximum,
and a linear layer gives the score. Training reads every labelled row in the tasks, which
sum counts and gradients; scoring runs in the tasks on every whole text. Thresholds are
calibrated by the language that the words of the text show, and folded into the score,
so that 0.5 is the threshold everywhere.

Defined results: a null text counts as empty; an empty text gets the score of one blank
word; rows without an id are scored, never learned from; labels that are null are left out;
without labels of both kinds every score is the share of toxic labels (0 when there are none).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.llm.shared import sliced, stage

# Frequent function words, one line a language.
FUNCTION_WORDS = (
    ("the", "and", "of", "to", "is", "that", "with", "for", "was", "this"),
    ("der", "die", "und", "das", "nicht", "ist", "mit", "dem", "den", "von"),
    ("le", "les", "des", "et", "qui", "dans", "pour", "une", "du", "est"),
    ("el", "los", "las", "y", "por", "con", "del", "una", "su", "para"),
)
#: ASCII letters to lower case, other ASCII but digits to a blank; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_PREFIXES = range(4, 10)
_LANGUAGE = {w.encode(): k for k, ws in enumerate(FUNCTION_WORDS) for w in ws}
_WORDS_KEPT = 300_000
#: False alarms that weigh as much as one toxic row missed.
MISSED = 2.0
#: Parts of one that gradients, and steps of one that logits, are counted in.
_UNIT, _GRID = 1 << 42, 1 << 10


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def features(word: bytes, buckets: int) -> list[int]:
    """Hash buckets of a word and of its proper prefixes (counted in bytes)."""
    parts = [b"<" + word + b">", *(b"<" + word[:n] for n in _PREFIXES if n < len(word))]
    return [zlib.crc32(p) % buckets for p in parts]


def language_of(words: list[bytes]) -> int:
    """Index of the language most of whose function words occur; one past the last when none does."""
    votes = [0] * len(FUNCTION_WORDS)
    for w in words:
        k = _LANGUAGE.get(w)
        if k is not None:
            votes[k] += 1
    return int(np.argmax(votes)) if any(votes) else len(FUNCTION_WORDS)


def _voted(votes: np.ndarray) -> int:
    """The same from how often each function word occurs (at 0: other words)."""
    by = votes[1:].reshape(len(FUNCTION_WORDS), -1).sum(axis=1)
    return int(by.argmax()) if by.any() else len(FUNCTION_WORDS)


@dataclass
class ToxicityModel:
    """Weights; ``rows`` maps a hash bucket to its embedding (0: not seen in training)."""

    buckets: int
    rows: dict[int, int]
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, dims, filters)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))
    constant: float | None = None

    def scorer(self) -> Scorer:
        return Scorer(self)


class _Index(dict):
    """Table row of each word met so far."""

    def __init__(self, scorer: Scorer):
        super().__init__()
        self.scorer = scorer

    def __missing__(self, word: bytes) -> int:
        k = self[word] = self.scorer.row_of(word)
        return k


class Scorer:
    """Scores texts; what a filter gives for a word at one of its places is computed once a word."""

    def __init__(self, model: ToxicityModel):
        self.m = model
        places = [(w, j) for w in sorted(model.filters) for j in range(w)]
        n = next(iter(model.filters.values())).shape[2] if model.filters else 0
        self.kernel = np.concatenate([model.filters[w][j] for w, j in places], axis=1).astype(np.float32) if n else None
        self.at = {p: slice(k * n, (k + 1) * n) for k, p in enumerate(places)}
        self.reset()

    def reset(self) -> None:
        self.index = _Index(self)
        self.used = 1  # row 0: words that training gave no vector; then the function words
        self.table = np.zeros((4096, self.kernel.shape[1] if self.kernel is not None else 1), np.float32)

        for w in _LANGUAGE:
            self.index[w] = self.add([r for f in features(w, self.m.buckets) if (r := self.m.rows.get(f)) is not None])

    def rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def row_of(self, word: bytes) -> int:
        own = [r for f in features(word, self.m.buckets) if (r := self.m.rows.get(f)) is not None]
        return self.add(own) if own else 0

    def add(self, own: list[int]) -> int:
        """A row of the table for a word made up of these embeddings."""
        k = self.used
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if own and self.kernel is not None:
            self.table[k] = self.m.embed[own].sum(axis=0) @ self.kernel
        self.used = k + 1
        return k

    def score(self, text: bytes | None) -> float:
        """Score of one whole text."""
        if self.m.constant is not None:
            return self.m.constant
        if len(self.index) > _WORDS_KEPT:
            self.reset()
        words = words_of(text)
        pooled, step, widest, votes = None, 65_536, max(self.m.filters), np.zeros(len(_LANGUAGE) + 1, np.int64)
        for start in range(0, max(1, len(words)), step):
            part = self.rows(words[start:start + step + widest - 1])
            here = max(1, min(step, len(words) - start))
            part = np.concatenate([part, np.zeros(max(0, here + widest - 1 - len(part)), np.int64)])
            values = self.table[part]
            votes += np.bincount(np.where(part[:here] <= len(_LANGUAGE), part[:here], 0), minlength=len(votes))
            tops = []
            for w in sorted(self.m.filters):
                total = values[:here, self.at[w, 0]].copy()
                for j in range(1, w):
                    total += values[j:here + j, self.at[w, j]]
                tops.append(total.max(axis=0) + self.m.bias[w])
            top = np.concatenate(tops)
            pooled = top if pooled is None else np.maximum(pooled, top)
        logit = float(np.maximum(pooled, 0) @ self.m.out + self.m.out_bias) - self.m.shift[_voted(votes)]
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


class _Reader(dict):
    """Row of each word met so far: 0 for words without a vector, then the function words, then words with one."""

    def __init__(self, rows: dict[int, int], buckets: int):
        super().__init__()
        self.known, self.buckets = rows, buckets
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.own: list[list[int]] = [[]]
        for w in _LANGUAGE:
            self[w] = self.add(self.parts(w))

    def parts(self, word: bytes) -> list[int]:
        return [self.known[f] for f in features(word, self.buckets) if f in self.known]

    def add(self, own: list[int]) -> int:
        self.own.append(own)
        return len(self.own) - 1

    def __missing__(self, word: bytes) -> int:
        own = self.parts(word)
        k = self[word] = self.add(own) if own else 0
        return k

    def read(self, text: bytes | None, widest: int) -> tuple[int, np.ndarray, list[int], list[int]]:
        """Language shown, words as numbers of the text's own list, embeddings of that list, and how many each word has.

        Of a longer run of words without a vector ``widest`` stay: filters meet the same stretches as in the whole text.
        """
        if len(self) > _WORDS_KEPT:
            self.reset()
        words = words_of(text)
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        language = _voted(np.bincount(np.where(ids <= len(_LANGUAGE), ids, 0), minlength=len(_LANGUAGE) + 1))
        met = [int(k) for k in np.unique(ids) if self.own[k]]
        place = np.searchsorted(met, ids) + 1 if met else np.zeros(len(ids), np.int64)
        place[~np.isin(ids, met)] = 0
        full = np.concatenate([[-1], np.flatnonzero(place)])
        since = np.arange(len(place)) - full[np.searchsorted(full, np.arange(len(place)), "right") - 1]
        return language, place[(place > 0) | (since <= widest)], [f for k in met for f in self.own[k]], [len(self.own[k]) for k in met]


_READ = "toxic int, hold boolean, language int, seq array<int>, parts array<int>, sizes array<int>"


def _read(batches, rows: dict[int, int], buckets: int, widest: int):
    """Batches (text, toxic, hold) in the form that training needs."""
    reader = _Reader(rows, buckets)
    ints = pa.list_(pa.int32())
    for batch in batches:
        got = [reader.read(t, widest) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1).cast(pa.int32()), batch.column(2), pa.array([g[0] for g in got], pa.int32()), *[pa.array([g[k] for g in got], ints) for k in (1, 2, 3)]],
            names=["toxic", "hold", "language", "seq", "parts", "sizes"])


def _count(batches, buckets: int):
    """(f, c0, c1): in how many texts of each class a feature occurs, from batches (text, toxic)."""
    counts, known = np.zeros((2, buckets), np.int32), {}
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(known) > _WORDS_KEPT:
                known.clear()
            own = set()
            for w in set(words_of(text)):
                f = known.get(w)
                if f is None:
                    f = known[w] = features(w, buckets)
                own.update(f)
            counts[label, np.fromiter(own, np.int64, len(own))] += 1
    met = np.flatnonzero(counts.any(axis=0))
    for start in range(0, len(met), 100_000):
        f = met[start:start + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(f), *[pa.array(counts[k, f].astype(np.int64)) for k in (0, 1)]], names=["f", "c0", "c1"])


@dataclass
class _Layers:
    """What training moves, and how a batch of read texts goes through it."""

    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> dict[str, np.ndarray]:
        """All but the embeddings, by name."""
        return {"out": self.out, "ob": self.out_bias} | {f"k{w}": k for w, k in self.filters.items()} | {f"b{w}": b for w, b in self.bias.items()}

    def forward(self, batch: pa.RecordBatch):
        seq, parts, sizes = (batch.column(batch.schema.names.index(n)) for n in ("seq", "parts", "sizes"))
        lengths, own = np.asarray(seq.value_lengths()).astype(np.int64), np.asarray(sizes.value_lengths()).astype(np.int64)
        seq, parts, sizes = (np.asarray(c.flatten()).astype(np.int64) for c in (seq, parts, sizes))
        widest, n = max(self.filters), len(lengths)
        v = np.zeros((1 + len(sizes), self.embed.shape[1]))
        if len(sizes):
            v[1:] = np.add.reduceat(self.embed[parts], np.cumsum(sizes) - sizes, axis=0)
        at = np.arange(len(seq)) + np.repeat(np.arange(n) * (widest - 1), lengths)
        flat = np.zeros(len(seq) + n * (widest - 1), np.int64)
        flat[at] = np.where(seq > 0, seq + np.repeat(np.cumsum(own) - own, lengths), 0)
        begin = np.cumsum(lengths + widest - 1) - (lengths + widest - 1)
        doc = np.repeat(np.arange(n), lengths)
        top, where = [], []
        for w in sorted(self.filters):
            total = np.full((len(flat), self.filters[w].shape[2]), -np.inf)
            total[at] = sum(np.einsum("wd,df->wf", v, self.filters[w][j])[flat[at + j]] for j in range(w))
            best = np.maximum.reduceat(total, begin, axis=0)
            place, f = np.nonzero(total[at] == best[doc])
            first = np.zeros(best.shape, np.int64)
            first[doc[place[::-1]], f[::-1]] = at[place[::-1]]  # of equal ones the first is written last
            top.append(best + self.bias[w])
            where.append(first)
        z = np.concatenate(top, axis=1)
        logit = (np.maximum(z, 0) * self.out).sum(axis=1) + self.out_bias[0]
        return v, flat, parts, sizes, z, where, logit

    def gradients(self, batches, weight: float, n: float):
        """Whole numbers, so that sums do not depend on the order: of the embeddings, and of the other parameters by name."""
        embed = np.zeros(self.embed.shape, np.int64)
        rest = {k: np.zeros(x.shape, np.int64) for k, x in self.parameters().items()}
        for batch in batches:
            v, flat, parts, sizes, z, where, logit = self.forward(batch)
            y = np.asarray(batch.column(batch.schema.names.index("toxic")))
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * np.where(y == 1, weight, 1.0) / n
            back = g[:, None] * self.out[None, :] * (z > 0)
            rest["out"] += _whole(np.maximum(z, 0) * g[:, None]).sum(axis=0)
            rest["ob"] += _whole(g).sum()
            word_grad = np.zeros(v.shape, np.int64)
            for i, w in enumerate(sorted(self.filters)):
                many = self.filters[w].shape[2]
                share = back[:, i * many:(i + 1) * many]
                for j in range(w):
                    word = flat[where[i] + j]  # (docs, filters)
                    rest[f"k{w}"][j] += _whole(v[word] * share[:, :, None]).sum(axis=0).T
                    own = (share != 0) & (word > 0)
                    np.add.at(word_grad, word[own], _whole((share[:, :, None] * self.filters[w][j].T[None, :, :])[own]))
                rest[f"b{w}"] += _whole(share).sum(axis=0)
            np.add.at(embed, parts, np.repeat(word_grad[1:], sizes, axis=0))
        return embed, rest


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * _UNIT).astype(np.int64)


def _cells(batches, layers: _Layers):
    """(language, toxic, cell): the logit of each read text in steps of one to ``_GRID``."""
    for batch in batches:
        cell = np.floor(np.clip(layers.forward(batch)[-1], -20, 20) * _GRID).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(cell)], names=["language", "toxic", "cell"])


def _learn(rows: list, counted: np.ndarray, n: tuple[float, float], summed, cells, *, dims: int = 8, filters: int = 6, widths: tuple[int, ...] = (1, 2, 3),
           buckets: int = 1 << 22, min_docs: int = 3, epochs: int = 8, seed: int = 7, odds: float = 1.0) -> ToxicityModel:
    """Train from counts of features and passes over all rows.

    ``rows``: the features kept, ``counted``: their texts by class, ``n``: texts by class.
    ``summed(layers, weight, n)`` gives the gradients over all texts to learn from, ``cells(layers)``
    the number of texts to check by (language, toxic, cell).
    """
    n0, n1 = n
    rng = np.random.default_rng(seed)
    a, b = (counted[:, 1], counted[:, 0]) if len(rows) else (np.zeros(1), np.zeros(1))
    a, b = a + 0.5, b + 0.5
    log_odds = np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))
    embed = rng.normal(0, 0.02, (len(a), dims))
    embed[:, 0] = np.clip(log_odds / np.sqrt(1 / a + 1 / b), 0, 6) * np.clip(log_odds, 0, 6) / 12  # evidence of the class, as a start
    layers = _Layers(embed, {}, {}, np.full(len(widths) * filters, 0.5), np.array([-1.0]))
    for w in sorted(widths):
        kernel = rng.normal(0, 0.1, (w, dims, filters))
        kernel[:, 0, :] += 0.5 / w
        layers.filters[w], layers.bias[w] = kernel, -np.linspace(0.2, 1.2, filters)

    steps = {"embed": np.zeros_like(embed)} | {k: np.zeros(x.shape) for k, x in layers.parameters().items()}

    def move(name: str, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        steps[name] += grad * grad  # Adagrad
        value -= rate * grad / np.sqrt(steps[name] + 1e-8)

    for _ in range(epochs):
        grad, rest = summed(layers, (n0 / max(n1, 1)) ** 0.5, n0 + n1)
        for name, value in layers.parameters().items():
            decay = 1e-4 if name == "out" or name[0] == "k" else 0.0
            move(name, value, rest[name] / _UNIT + decay * value, 0.05 if name[0] == "o" else 0.02)
        move("embed", layers.embed, grad / _UNIT + 1e-5 * layers.embed, 0.02)

    model = ToxicityModel(buckets, {f: k for k, f in enumerate(rows)}, layers.embed.astype(np.float32), layers.filters, layers.bias, layers.out, float(layers.out_bias[0]))
    # Thresholds: per shown language the cut with the least mistakes, drawn to the cut of all.
    language, toxic, cell, count = (np.asarray(c) for c in cells(layers))
    everywhere = _cut(cell, toxic, count, MISSED * odds)
    for k in range(len(model.shift)):
        own = language == k
        few = min(count[own & (toxic == 1)].sum(), count[own & (toxic == 0)].sum())
        trust = few / (few + 20)
        model.shift[k] = trust * _cut(cell[own], toxic[own], count[own], MISSED * odds) + (1 - trust) * everywhere if few else everywhere
    return model


def _kept(f: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[list[int], np.ndarray]:
    order = np.argsort(f)
    return f[order].tolist(), np.column_stack([c0, c1])[order].astype(float)


def _constant(share: float, options: dict) -> ToxicityModel:
    return ToxicityModel(options.get("buckets", 1 << 22), {}, np.zeros((1, options.get("dims", 8))), {}, {}, np.zeros(0), 0.0, constant=share)


def fit(texts: list[bytes], labels: np.ndarray, **options) -> ToxicityModel:
    """Train on given texts (a quarter of them, by checksum, calibrates the thresholds); ``train`` does the same with tables.

    ``odds`` is how much rarer toxic rows are in truth than in ``labels``; thresholds allow for it.
    """
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 0.0, options)
    buckets, widest = options.get("buckets", 1 << 22), max(options.get("widths", (1, 2, 3)))
    held = np.array([zlib.crc32(t) % 4 == 3 for t in texts])
    split = not (y[held].sum() in (0, held.sum()) or y[~held].sum() in (0, (~held).sum()))
    learn = ~held if split else np.ones(len(y), bool)
    n1 = int(y[learn].sum())
    n0 = int(learn.sum()) - n1
    table = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(y, pa.int32()), pa.array(held & split)], names=["text", "toxic", "hold"])
    got = pa.Table.from_batches(list(_count([table.filter(pa.array(learn))], buckets)) or [pa.RecordBatch.from_pylist([], pa.schema([(c, pa.int64()) for c in ("f", "c0", "c1")]))])
    f, c0, c1 = (np.asarray(got.column(c)) for c in ("f", "c0", "c1"))
    use = (c0 + c1 >= options.get("min_docs", 3)) & (c1 * n0 > 3 * c0 * n1)
    rows, counted = _kept(f[use], c0[use], c1[use])
    read = pa.Table.from_batches(list(_read(sliced([table]), {f: k for k, f in enumerate(rows)}, buckets, widest)))
    mine = pa.array(learn)
    learning, checking = read.filter(mine).to_batches(500), (read.filter(pa.array(held)) if split else read).to_batches(500)

    def cells(layers):
        at = np.concatenate([np.column_stack([np.asarray(c) for c in b.columns]) for b in _cells(checking, layers)])
        at, count = np.unique(at, axis=0, return_counts=True)
        return *at.T, count

    return _learn(rows, counted, (n0, n1), lambda layers, weight, n: layers.gradients(learning, weight, n), cells, **options)


def _cut(cell: np.ndarray, toxic: np.ndarray, count: np.ndarray, missed: float) -> float:
    """The middle of the widest stretch of cuts with the least mistakes; a missed toxic row counts as ``missed`` false alarms."""
    z, at = np.unique(cell, return_inverse=True)
    bad, good = (np.bincount(at, np.where(toxic == k, count, 0), len(z)) for k in (1, 0))
    wrong = np.concatenate([[0], np.cumsum(bad) * missed]) + np.concatenate([np.cumsum(good[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    low = np.where(best > 0, z[np.maximum(best - 1, 0)] + 1, z[0] - _GRID)
    high = np.where(best < len(z), z[np.minimum(best, len(z) - 1)], z[-1] + 1 + _GRID)
    k = int(np.argmax(high - low))
    return float(low[k] + high[k]) / 2 / _GRID


def held_out(doc_id) -> F.Column:
    """Rows never learned from: every fifth by the checksum of the id, and rows without one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _known(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels to learn from, one row an id."""
    return (labels.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
            .filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int | None = None, sample_bytes: int | None = None, toxic_share: float = 0.25, **options) -> ToxicityModel:
    """Fit on every labelled row that is not held out; with ``sample_rows`` or ``sample_bytes`` on a sample drawn class by class.

    Tasks count the features of the whole texts, and the counts choose those that get an embedding.
    The texts are then written as their words with an embedding. Each of the ``epochs`` is a pass
    over them: tasks sum the gradients of all rows, the driver moves the weights. What reaches it
    is bounded by the number of hash buckets, and by the steps of a logit for the thresholds.
    """
    if sample_rows is not None or sample_bytes is not None:
        return _train_sample(docs, labels, sample_rows or 5_000, sample_bytes or 48 << 20, toxic_share, options)
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # The same join at every size: the ids of labels grow with the input, so they are not sent out whole.
    rows = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", body.alias("text")).join(_known(docs, labels).hint("merge"), "doc_id")
    labelled = stage(rows.select("text", "toxic", (F.crc32("text") % 4 == 3).alias("hold")), "labelled")
    there = {(r["hold"], r["toxic"]): r["count"] for r in labelled.groupBy("hold", "toxic").count().collect()}
    total = [sum(v for (_, label), v in there.items() if label == k) for k in (0, 1)]
    if not min(total):
        return _constant(float(total[1] > 0), options)
    split = len(there) == 4  # otherwise all rows are learned from, and checked
    if not split:
        labelled = labelled.withColumn("hold", F.lit(False))
    n0, n1 = (there[False, k] if split else total[k] for k in (0, 1))
    buckets, widest = options.get("buckets", 1 << 22), max(options.get("widths", (1, 2, 3)))
    counts = labelled.filter(~F.col("hold")).select("text", "toxic").mapInArrow(lambda batches: _count(sliced(batches), buckets), "f long, c0 long, c1 long")
    found = counts.groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).filter(
        (F.col("c0") + F.col("c1") >= options.get("min_docs", 3)) & (F.col("c1") * n0 > 3 * F.col("c0") * n1)).toArrow()  # at most a row a bucket
    kept, counted = _kept(*(found.column(c).to_numpy() for c in ("f", "c0", "c1")))
    index = spark.sparkContext.broadcast({f: k for k, f in enumerate(kept)})
    read = stage(labelled.mapInArrow(lambda batches: _read(sliced(batches), index.value, buckets, widest), _READ), "read")
    learning, checking = read.filter(~F.col("hold")), read.filter("hold") if split else read

    def summed(layers: _Layers, weight: float, n: float):
        dims, shared = layers.embed.shape[1], spark.sparkContext.broadcast(layers)
        names = [f"g{i}" for i in range(dims)]

        def run(batches):
            embed, rest = shared.value.gradients(sliced(batches), weight, n)
            at = np.flatnonzero(embed.any(axis=1))
            flat = np.concatenate([x.ravel() for x in rest.values()])
            flat = np.concatenate([flat, np.zeros(-len(flat) % dims, np.int64)]).reshape(-1, dims)
            for key, values in ((at, embed[at]), (-1 - np.arange(len(flat)), flat)):
                for start in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[start:start + 100_000]), *[pa.array(values[start:start + 100_000, i]) for i in range(dims)]], names=["k", *names])

        sums = learning.mapInArrow(run, "k long, " + ", ".join(f"{g} long" for g in names)).groupBy("k").agg(*[F.sum(g).alias(g) for g in names]).toArrow()
        shared.destroy()
        key, values = sums.column("k").to_numpy(), np.column_stack([sums.column(g).to_numpy() for g in names]).reshape(-1, dims)
        embed = np.zeros(layers.embed.shape, np.int64)
        embed[key[key >= 0]] = values[key >= 0]
        flat = np.zeros((-min(int(key.min()), 0), dims), np.int64)
        flat[-1 - key[key < 0]] = values[key < 0]
        flat, rest, start = flat.ravel(), {}, 0
        for name, x in layers.parameters().items():
            rest[name] = flat[start:start + x.size].reshape(x.shape)
            start += x.size
        return embed, rest

    def cells(layers: _Layers):
        got = checking.mapInArrow(lambda batches: _cells(sliced(batches), layers), "language int, toxic int, cell int").groupBy("language", "toxic", "cell").count().toArrow()
        return [c.to_numpy() for c in got.columns]

    return _learn(kept, counted, (n0, n1), summed, cells, **options)


def _train_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_bytes: int, toxic_share: float, options: dict) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled rows that are not held out, drawn class by class.

    Each class gives the rows whose ids hash lowest: toxic ones up to ``toxic_share`` of the
    sample, the others up to the rest. Rows over a sixteenth of ``sample_bytes`` of text, and
    rows that would take a class over its share of ``sample_bytes``, are passed over for the next
    ones; this bounds what reaches the driver, whatever the size of the tables, and both kinds
    are in the sample wherever short enough rows of both exist. Tasks send only ids below a hash
    bound, which follows from the number of rows of the class.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    known = _known(docs, labels)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = ["doc_id", "size", "mark"]
    rows = docs.select("doc_id", body.alias("text")).select("doc_id", "text", F.length("text").alias("size"), F.xxhash64("text").alias("mark"))
    labelled = stage(rows.select(*key).filter(F.col("size") <= sample_bytes // 16).join(known, "doc_id"), "labelled")
    there = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    chosen: dict[tuple, list[int]] = {}  # number of equal rows, and their label
    for label, share in ((0, 1 - toxic_share), (1, toxic_share)):
        if label not in there:
            continue
        most, so_far, taken = max(1, round(sample_rows * share)), 0, 0
        # A quarter over the wanted part, so that few enough rows come and very seldom too few.
        part = min(1.0, 1.25 * (most + 100) / there[label])
        low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))
        picked = labelled.filter(F.col("toxic") == label).filter(low).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), *key)
        for r in picked.select(*key).limit(2 * most).collect():
            if taken < most and so_far + r["size"] <= max(sample_bytes * share, sample_bytes // 16):
                chosen.setdefault((r["doc_id"], r["size"], r["mark"]), [0, label])[0] += 1
                so_far += r["size"]
                taken += 1
    if not chosen:
        return fit([], np.zeros(0), **options)
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("size", T.IntegerType()), T.StructField("mark", T.LongType())])
    texts = rows.join(F.broadcast(spark.createDataFrame(list(chosen), schema)), key).dropDuplicates(key).select(*key, "text")
    got = sorted((r["doc_id"], bytes(r["text"]), label) for r in texts.toLocalIterator() for n, label in [chosen[r["doc_id"], r["size"], r["mark"]]] for _ in range(n))
    truth = np.array([x for _, _, x in got])
    options.setdefault("odds", there[1] / there[0] * (truth == 0).sum() / (truth == 1).sum() if 0 < truth.sum() < len(truth) else 1.0)
    return fit([t for _, t, _ in got], truth, **options)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` (score at least 0.5) of every row."""
    def run(batches):
        scorer = model.scorer()
        for batch in sliced(batches):
            s = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    ids = docs.schema["doc_id"].dataType
    scored = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, T.StructType([T.StructField("doc_id", ids), T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns as they were."""
    at = docs.columns.index("text")

    def run(batches):
        scorer = model.scorer()
        for batch in sliced(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([scorer.score(t) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
