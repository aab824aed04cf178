"""Quality classifier on supervised subword embeddings.

A document is the average of the learned vectors of its features: hashed words,
hashed character n-grams of its words, and one feature for every distance at
which a word comes back soon after itself. Softmax over two outputs; numpy
stochastic gradient descent on a bounded sample of labelled rows.

The average and the output layer are both linear, so after training a feature is
one number: the dot product of its vector with the difference of the outputs.
Tasks add those numbers up over the whole text, each word looked up once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import remembering, small_batches, source, table

#: Bound of the labelled sample: rows of either label that training may see.
ROWS_PER_LABEL = 2_000
BITS = 18
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.3
GRAMS = (3, 4, 5)
#: Distances at which a returning word counts, and how many features each return weighs.
RETURNS, RETURN_WEIGHT = 8, 6
THRESHOLD = 0.7
#: Words a worker remembers before it starts afresh.
CACHE_WORDS = 500_000

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of one kind of feature folded into 2**BITS buckets."""
    h = (h ^ np.uint64(kind * 0x100000001B3)) * _Q
    h ^= h >> np.uint64(29)
    return (h * _P >> np.uint64(64 - BITS)).astype(np.int32)


def return_buckets() -> np.ndarray:
    return _bucket(np.arange(1, RETURNS + 1, dtype=np.uint64), 1)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of the word itself and of the n-grams of ``<word>``, by code points."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(chars)) - starts[owner]
    powers = np.cumprod(np.full(int(lengths.max()), _P, np.uint64))
    whole = np.add.reduceat(chars * powers[place], starts)
    owners, buckets = [np.arange(len(words))], [_bucket(whole, 2)]
    room = lengths[owner] - place
    for n in GRAMS:
        at = np.flatnonzero(room >= n)
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * _P + chars[at + k]
        owners.append(owner[at])
        buckets.append(_bucket(h, n + 10))
    return np.concatenate(owners), np.concatenate(buckets)


def returns(ids: np.ndarray) -> np.ndarray:
    """How many words equal the one 1, 2, … RETURNS places before."""
    return np.array([np.count_nonzero(ids[k:] == ids[:-k]) if len(ids) > k else 0 for k in range(1, RETURNS + 1)])


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share of each in all its features."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids: dict[str, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words])
    owner, bucket = word_features(list(ids))
    weight = np.bincount(at)[owner].astype(float)
    bucket = np.concatenate([bucket, return_buckets()])
    weight = np.concatenate([weight, RETURN_WEIGHT * returns(at)])
    distinct, where = np.unique(bucket, return_inverse=True)
    total = np.bincount(where, weight)
    return distinct[total > 0], (total[total > 0] / weight.sum()).astype(np.float32)


class Scorer:
    """Mean feature value of texts under trained bucket values."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(float)
        self.back = self.values[return_buckets()]
        self.forget()

    def __len__(self) -> int:
        return len(self.known)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums = np.zeros(0)
        self.counts = np.zeros(0)

    def means(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.forget()
        known = self.known
        new = sorted(set().union(*split).difference(known))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            owner, bucket = word_features(part)
            known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
            self.sums = np.concatenate([self.sums, np.bincount(owner, self.values[bucket])])
            self.counts = np.concatenate([self.counts, np.bincount(owner)])
        out = np.zeros(len(texts))
        for i, ws in enumerate(split):
            if ws:
                ids = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
                back = RETURN_WEIGHT * returns(ids)
                out[i] = (self.sums[ids].sum() + back @ self.back) / (self.counts[ids].sum() + back.sum())
        return out


def train(buckets: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Bucket values and bias of ``P(label 1) = sigmoid(mean value + bias)``."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    order = np.arange(len(labels))
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        for done, i in enumerate(order):
            rate = RATE * (1 - (epoch + done / len(order)) / EPOCHS)
            b, w = buckets[i], weights[i]
            hidden = w @ vectors[b] if len(b) else np.zeros(DIMENSIONS, np.float32)
            logit = hidden @ out + bias
            e = np.exp(logit - logit.max())
            error = e / e.sum()
            error[labels[i]] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            if len(b):
                vectors[b] -= (rate * len(b)) * w[:, None] * back
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", rows_per_label: int = ROWS_PER_LABEL) -> tuple[np.ndarray, float]:
    """Train on at most ``rows_per_label`` rows of either label, those with the smallest hashed ids.

    Only labels 0 and 1 of ids that are not held out count; an id labelled twice is
    two rows. Without rows of both labels the model says the share of label 1, or
    one half. At most ``2 * rows_per_label`` rows of features go to the task that
    trains; the driver gets the model, ``2 ** BITS`` numbers.
    """
    marked = source(labels, doc_id="doc_id", quality="quality").filter(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [marked.filter(F.col("quality") == q).orderBy(*by).limit(rows_per_label) for q in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # 2 * rows_per_label rows at most
    small_batches(docs.sparkSession)

    def features(batches):
        for b in batches:
            found = [text_features(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    b["quality"],
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.list_(pa.float32())),
                ],
                ["doc_id", "quality", "buckets", "weights"],
            )

    texts = source(docs, doc_id="doc_id", text=text).join(chosen, "doc_id")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    # Ids that documents repeat could pass the bound, so it is set again.
    rows = texts.mapInArrow(features, f"doc_id {id_type}, quality int, buckets array<int>, weights array<float>")
    got = rows.orderBy(*by, F.hash("buckets")).limit(2 * rows_per_label)

    def learn(batches):
        """One task trains, so that the driver sees the model alone."""
        y, buckets, weights = [], [], []
        for b in batches:
            y.append(b["quality"].to_numpy())
            buckets += [x.values.to_numpy() for x in b["buckets"]]
            weights += [x.values.to_numpy() for x in b["weights"]]
        y = np.concatenate(y) if y else np.zeros(0, np.int64)
        if len(set(y.tolist())) < 2:
            share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
            values, bias = np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
        else:
            values, bias = train(buckets, weights, y)
        yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([bias])], ["values", "bias"])

    model = got.mapInArrow(learn, "values binary, bias double").first()
    return (np.frombuffer(model["values"], np.float32), model["bias"]) if model else (np.zeros(1 << BITS, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """``docs`` with ``__score``, the probability of label 1, from the whole text alone.

    Null and empty texts have no features and get the bias's probability.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def add(batches):
        values, bias = sent.value
        with remembering("scorer", (values.tobytes(), bias), lambda: Scorer(values)) as scorer:
            for b in batches:
                p = 1 / (1 + np.exp(-np.clip(scorer.means(b.column(at).to_pylist()) + bias, -500, 500)))
                yield b.append_column("__score", pa.array(p))

    return docs.mapInArrow(add, docs.withColumn("__score", F.lit(0.0)).schema)


def accepted() -> Column:
    return F.col("__score") >= THRESHOLD


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of three quarters of the ids."""
    docs = source(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), accepted().cast("int").alias("predicted")
    )
