"""A convolutional text classifier for toxicity in numpy.

A word's embedding is the sum of hashed embeddings of the word and of two of its beginnings.  Filters of several widths
run over the words of a whole text, each gives its largest response, and a logistic unit weighs these.  The language of a
text, guessed from its own common words, chooses the threshold that calibration found for it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
#: Hashed embeddings and their length; filter widths, and filters of each.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 20, 8, (1, 2, 3), 8
PAD = max(WIDTHS) - 1
CUT = 0.7
# Common words that tell languages apart.
COMMON = {
    "en": "the of and to in is that for was with as by on this are be at from it".split(),
    "fr": "le la les des et du que un une qui dans pour par sur est au en ou".split(),
    "de": "der die das und den von zu mit sich des ist im dem nicht ein eine als".split(),
    "es": "el los las que del y por un una con para se su al lo como".split(),
}
LANGUAGES = (*COMMON, "other")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Hashed features of the words in bytes of text: runs of letters, digits and bytes above ASCII, A-Z in lower case."""

    def __init__(self):
        seeds = _mixed(np.arange(1, 300, dtype=_U) * _U(0x9E3779B97F4A7C15))
        self.values = seeds[:256].copy()
        self.values[65:91] = self.values[97:123]
        self.ink = np.zeros(256, bool)
        for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
            self.ink[lo:hi] = True
        self.base = int(seeds[260] | _U(1))
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, _U)
        self.language = np.full(BUCKETS, len(COMMON), np.uint8)
        for k, words in enumerate(COMMON.values()):
            data = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
            self.language[self.features(data, np.array([0, len(data)]))[0][:, 0]] = k

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three buckets for each word, and where the words of each text begin; ``offsets``: where texts do."""
        if len(self.powers) <= len(data):
            n = max(len(data) + 1, 1 << 20)
            for name, x in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, x, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        ink = np.zeros(len(data) + 2, bool)
        ink[1:-1] = self.ink[data]
        breaks = offsets[1:-1]
        breaks = breaks[(breaks > 0) & (breaks < len(data))]
        first, last = ink[1:-1] & ~ink[:-2], ink[1:-1] & ~ink[2:]
        first[breaks] = ink[1:-1][breaks]
        last[breaks - 1] = ink[1:-1][breaks - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        out = np.empty((len(a), 3), np.int32)
        for k, size in enumerate((1 << 30, 4, 5)):
            hashes = (sums[np.minimum(a + size, b)] - sums[a]) * self.inverses[a]
            out[:, k] = _mixed(hashes + _U(k * 0x9E3779B9)) % _U(BUCKETS)
        return out, np.searchsorted(a, offsets)


@dataclass
class Model:
    """Parameters, and the thresholds of the logit by language."""

    embedding: np.ndarray
    filters: np.ndarray  # DIM by one column for each filter and offset
    bias: np.ndarray
    weights: np.ndarray
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None
    frozen: np.ndarray | None = None

    @classmethod
    def fresh(cls, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        return cls(
            (rng.standard_normal((BUCKETS, DIM), np.float32) * np.float32(0.05)), rng.standard_normal((DIM, sum(WIDTHS) * FILTERS)).astype(np.float32) * np.float32(0.4),
            np.full(n, 0.05, np.float32), (rng.standard_normal(n) * 0.3).astype(np.float32))

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Of every filter at every row of ``x``, a text's embeddings followed by PAD rows of zeros."""
        y = x @ self.filters
        out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        at = 0
        for k, width in enumerate(WIDTHS):
            z = out[:, k * FILTERS : (k + 1) * FILTERS]
            z[:] = y[:, at : at + FILTERS]
            for j in range(1, width):
                z[:-j] += y[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += width * FILTERS
        return out

    def embedded(self, buckets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings with PAD zero rows after each text, the row of each word, and where texts begin."""
        lengths = np.diff(begins)
        starts = np.r_[0, np.cumsum(lengths + PAD)]
        rows = np.arange(len(buckets)) + np.repeat(starts[:-1] - begins[:-1], lengths)
        x = np.zeros((starts[-1], DIM), np.float32)
        e = self.embedding
        x[rows] = e[buckets[:, 0]] + e[buckets[:, 1]] + e[buckets[:, 2]]
        return x, rows, starts

    def logits(self, buckets: np.ndarray, begins: np.ndarray) -> np.ndarray:
        x, _, starts = self.embedded(buckets, begins)
        best = np.maximum.reduceat(self.responses(x), starts[:-1], axis=0)
        return np.maximum(best + self.bias, 0) @ self.weights + np.float32(self.offset)

    def train(self, texts: list[tuple[np.ndarray, float]], epochs: int, seed: int, rate: float = 0.08, batch: int = 32) -> None:
        """Adagrad on the logistic loss, over texts as (buckets, label)."""
        rng = np.random.default_rng(seed)
        rates = {name: np.full_like(getattr(self, name), 1e-4) for name in ("embedding", "filters", "bias", "weights")}
        offset_rate, n_filters = 1e-4, len(WIDTHS) * FILTERS
        heavy = sum(label for _, label in texts) / len(texts)
        balance = min(5.0, ((1 - heavy) / heavy) ** 0.5)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(texts), batch):
                part = [texts[i] for i in order[lo : lo + batch]]
                label = np.array([x[1] for x in part], np.float32)
                begins = np.r_[0, np.cumsum([len(x[0]) for x in part])]
                buckets = np.concatenate([x[0] for x in part])
                x, rows, starts = self.embedded(buckets, begins)
                z = self.responses(x)
                best = np.maximum.reduceat(z, starts[:-1], axis=0)
                hidden = np.maximum(best + self.bias, 0)
                error = (1 / (1 + np.exp(-(hidden @ self.weights + np.float32(self.offset)))) - label) * np.where(label > 0, balance, 1).astype(np.float32) / len(part)
                back = error[:, None] * self.weights * (hidden > 0)
                grads = {"weights": hidden.T @ error + 1e-4 * self.weights, "bias": back.sum(0)}
                at = np.stack([starts[i] + np.argmax(z[starts[i] : starts[i + 1]], axis=0) for i in range(len(part))])
                word = np.full(starts[-1] + PAD, -1)
                word[rows] = np.arange(len(rows))
                padded = np.concatenate((x, np.zeros((PAD, DIM), np.float32)))
                dw = np.zeros_like(self.filters)
                touched, slopes, base = [], [], 0
                for k, width in enumerate(WIDTHS):
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    for j in range(width):
                        columns = slice(base + j * FILTERS, base + (j + 1) * FILTERS)
                        place = at[:, own] + j
                        dw[:, columns] = np.einsum("df,dfe->ef", back[:, own], padded[place])
                        hit = word[place]
                        use = (hit >= 0) & (back[:, own] != 0)
                        touched.append(hit[use])
                        slopes.append((back[:, own, None] * self.filters[:, columns].T[None])[use])
                    base += width * FILTERS
                grads["filters"] = dw + 1e-4 * self.filters
                for name in ("weights", "bias", "filters"):
                    rates[name] += grads[name] ** 2
                    setattr(self, name, getattr(self, name) - rate * grads[name] / np.sqrt(rates[name]))
                offset_rate += float(error.sum()) ** 2
                self.offset -= rate * float(error.sum()) / offset_rate**0.5
                hits = np.concatenate(touched)
                if len(hits):
                    ids, inverse = np.unique(buckets[hits].ravel(), return_inverse=True)
                    total = np.zeros((len(ids), DIM), np.float32)
                    np.add.at(total, inverse.ravel(), np.repeat(np.concatenate(slopes), 3, axis=0))
                    if self.frozen is not None:
                        total[self.frozen[ids]] = 0
                    rates["embedding"][ids] += total**2
                    self.embedding[ids] -= rate * total / np.sqrt(rates["embedding"][ids])
        assert n_filters == len(self.weights)


def _batches(words: Words, column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row number, buckets, begins, and languages of runs of texts of about ``most`` bytes (a longer text by itself)."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        buckets, begins = words.features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        guess = words.language[buckets[:, 0]]
        counts = np.stack([np.r_[0, np.cumsum(guess == k)] for k in range(len(COMMON))])
        counts = counts[:, begins[1:]] - counts[:, begins[:-1]]
        yield i, buckets, begins, np.where(counts.max(0) > 0, counts.argmax(0), len(COMMON))
        i = j


def _threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap at which the F1 measure is largest."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(hits) + 1) + labels.sum())
    k = int(np.argmax(f1))
    below = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + below) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        most_toxic: int = 2000, most_clean: int = 4000, most_chars: int = 100_000, epochs: int = 6, seed: int = 7) -> Model:
    """A model from at most ``most_toxic`` rows labelled 1 and ``most_clean`` labelled 0, of texts of up to
    ``most_chars`` characters.  The rows are the first by a hash of their ids, so the sample is bounded whatever the
    corpus, and reruns agree.  Every fifth row is kept from training and calibrates the thresholds, the whole sample's
    for languages that have few of them.  If a class has no row, scores are constant: the share of label 1, or 0."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null")
    pick = lambda value, n: known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = F.broadcast(pick(1, most_toxic).unionByName(pick(0, most_clean)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.char_length("text") <= most_chars).join(chosen, "id").select("id", "text", "label").limit(2 * (most_toxic + most_clean)).toArrow()
    rows = rows.take(np.argsort(rows["id"].to_numpy(), kind="stable"))
    return learn(rows["text"].combine_chunks(), rows["label"].to_numpy().astype(np.float32), epochs, seed)


def learn(texts: pa.Array, y: np.ndarray, epochs: int = 6, seed: int = 7) -> Model:
    """``fit`` on texts and labels in memory.  Embeddings of features that fewer than 2 texts (a text in 700 of larger
    samples) have stay zero, for they would only learn single texts by heart.  The others start from
    their log odds, the less the larger the sample."""
    if not len(y) or y.min() == y.max():
        return Model(*[np.zeros(0)] * 4, constant=float(y.mean()) if len(y) else 0.0)
    words, found = Words(), []
    for _, buckets, begins, languages in _batches(words, texts):
        found += [(buckets[a:b], k) for a, b, k in zip(begins[:-1], begins[1:], languages)]
    kept = np.arange(len(y)) % 5 == 4
    if y[kept].min() == y[kept].max():
        kept[:] = True
    train = [(x[0], label) for x, label, k in zip(found, y, kept) if not k or kept.all()]
    n_texts, n_toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for x in {hash(x.tobytes()): (x, label) for x, label in train}.values():
        ids = np.unique(x[0])
        n_texts[ids] += 1
        n_toxic[ids] += int(x[1])
    model = Model.fresh(seed)
    share = float(n_toxic.sum()) / max(1, int(n_texts.sum()))
    model.embedding[n_texts < max(2, round(len(train) / 700))] = 0
    odds = (n_toxic + 4 * share) / (n_texts + 4)
    known = n_texts >= max(2, round(len(train) / 700))
    model.embedding[known] += (np.log(odds[known] / (1 - odds[known])) - np.log(share / (1 - share)))[:, None].astype(np.float32) * np.float32(300 / (1000 + len(train)))
    model.frozen = ~known
    model.train(train, epochs if len(train) > 1000 else 4 * epochs, seed)
    model.frozen = None
    held = np.flatnonzero(kept)
    begins = np.r_[0, np.cumsum([len(found[i][0]) for i in held])]
    logits = model.logits(np.concatenate([found[i][0] for i in held]), begins)
    language = np.array([found[i][1] for i in held])
    common = _threshold(logits, y[held])
    for k, name in enumerate(LANGUAGES):
        own = language == k
        n = int(y[held][own].sum())
        mine = _threshold(logits[own], y[held][own]) if n and n < own.sum() else common
        model.thresholds[name] = (n * mine + 10 * common) / (n + 10)
    return model


def _scorer(model: Model):
    """A function from a string column to scores and guessed languages."""
    words = Words()
    limits = np.array([model.thresholds.get(name, 0.0) for name in LANGUAGES])
    shift = float(np.log(CUT / (1 - CUT)))

    def run(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        scores, languages = np.zeros(len(column)), np.zeros(len(column), int)
        for i, buckets, begins, language in _batches(words, column):
            own = slice(i, i + len(language))
            languages[own] = language
            scores[own] = model.constant if model.constant is not None else 1 / (1 + np.exp(-np.clip(model.logits(buckets, begins) - limits[language] + shift, -500, 500)))
        return scores, languages

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, language`` for each row: a score from 0 to 1 that is ``CUT`` at the threshold of the text's guessed
    language.  The score is a function of the text alone.  A null or empty text is scored as one without words;
    repeated rows have equal scores; ids may be null; other columns aren't looked at; an empty table gives an empty one.
    One pass without a shuffle; the model has a fixed size and is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(held.value)
        for batch in batches:
            scores, languages = scorer(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array([LANGUAGES[k] for k in languages], pa.string())], [id_col, "score", "language"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, score double, language string")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``cut``."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(held.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at))[0] < cut))

    return docs.mapInArrow(run, docs.schema)


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
