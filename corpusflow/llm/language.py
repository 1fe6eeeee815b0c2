"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all learning rows; the weights are fitted by
follow-the-regularised-leader with an elastic net on a bounded sample of labelled rows, and a
temperature, fitted on rows the weights have not seen, calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm import common

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS = 13
#: Labelled rows the weights and the temperature are fitted on, over all languages.
SAMPLE_ROWS = 6000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0005

_WIDTH = 1 << BITS
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Term counts (a row per text) of hashed character n-grams, and the letters per text.

    Case is folded, and everything between letters is one blank.
    """
    letter = common.per_worker("letters", _letters, small=True)
    raw = [("" if t is None else t.lower() + "\n").encode("utf-32-le", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) // 4 for r in raw]).astype(np.int64)
    chars = np.frombuffer(b"".join(raw), np.uint32)
    of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    is_letter = letter[chars]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first character behind a word stands for the gap
    chars, of, is_letter = np.where(is_letter, chars, 32)[keep].astype(np.uint64), of[keep], is_letter[keep]
    counts = np.zeros((len(texts), _WIDTH), np.float32)
    flat = counts.reshape(-1)
    hashed = np.zeros(len(chars), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        hashed = (hashed[:m] + chars[n - 1 :] + np.uint64(n)) * _FACTOR
        hashed ^= hashed >> np.uint64(29)
        if n in ORDERS:
            inside = of[:m] == of[n - 1 :]
            at = of[:m][inside] * _WIDTH + (hashed[inside] >> np.uint64(64 - BITS)).astype(np.int64)
            flat += np.bincount(at, minlength=len(flat)).astype(np.float32)
    return counts, np.bincount(of[is_letter], minlength=len(texts))


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: square roots of counts times inverse document frequencies."""
    out = np.sqrt(counts, out=counts)
    out *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.maximum(norm, 1e-12)[:, None]
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (a row per text) and the letters per text."""
        counts, letters = features(texts)
        return softmax((tf_idf(counts, self.idf) @ self.weights + self.bias) / self.temperature), letters


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by follow-the-regularised-leader over sparse rows (indexes, values)."""
    z, n = np.zeros((_WIDTH + 1, n_langs)), np.zeros((_WIDTH + 1, n_langs))

    def of(at: np.ndarray) -> np.ndarray:
        own = z[at]
        w = -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(own) <= L1] = 0
        return w

    for _ in range(EPOCHS):
        for (at, values), label in zip(rows, labels):
            at, values = np.append(at, _WIDTH), np.append(values, 1.0)  # the last weight is the bias
            w = of(at)
            p = softmax(values @ w)
            p[label] -= 1
            g = values[:, None] * p
            squared = g * g
            sigma = (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += squared
    w = of(np.arange(_WIDTH + 1))
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the smallest log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = np.log(0.02), np.log(5.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(learning: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Texts that hold each feature, and all texts. Tasks send one row per feature at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(_WIDTH, np.int64), 0
        for block in common.blocks(batches, "text", 1_000_000):
            for part in (block.slice(k, 256) for k in range(0, block.num_rows, 256)):
                counts, _ = features(part.column("text").to_pylist())
                found += (counts > 0).sum(axis=0)
                rows += len(counts)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], rows))], ["feature", "texts"])

    sums = learning.select(F.col(text).alias("text")).mapInArrow(count, "feature long, texts long").groupBy("feature").agg(F.sum("texts").alias("texts"))
    out, rows = np.zeros(_WIDTH), 0
    for r in sums.collect():  # one row per feature
        if r.feature < 0:
            rows = r.texts
        else:
            out[r.feature] = r.texts
    return out, rows


def learning_sample(learning: DataFrame, key: str, text: str, lang: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``rows`` labelled rows at most, as many of each language as there are, the smallest hashes of the key first."""
    sizes = {r[0]: r[1] for r in learning.groupBy(lang).count().collect()}  # one row per language
    quota = max(1, rows // max(1, len(sizes)))
    order = F.xxhash64(F.col(key).cast("string"))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, 1.3 * (quota + 20) / n))).otherwise(share)
    # the hash sends about the quota of each language to the last step, which then takes it exactly
    likely = learning.select(F.col(text).alias("text"), F.col(lang).alias("lang"), order.alias("hash"), share.alias("share")).where(
        F.pmod(F.col("hash"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    )
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "text"))
    return likely.withColumn("nth", nth).where(F.col("nth") <= quota).select("text", "lang", "hash")


def fit(learning: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """A model of the languages of ``learning``; None if no row has a text and a label."""
    learning = learning.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    frequencies, n = document_frequencies(learning, text)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + frequencies)) + 1).astype(np.float32)

    def train(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["hash", "text"])
        langs = sorted(sample["lang"].unique())
        labels = np.array([langs.index(x) for x in sample["lang"]])
        sparse, texts = [], sample["text"].tolist()
        for k in range(0, len(texts), 128):
            for row in tf_idf(features(texts[k : k + 128])[0], idf):
                at = np.flatnonzero(row)
                sparse.append((at.astype(np.int32), row[at]))
        held = np.arange(len(labels)) % 5 == 4
        weights, bias = ftrl([r for r, h in zip(sparse, held) if not h], labels[~held], len(langs))
        logits = np.array([v @ weights[at] + bias for (at, v), h in zip(sparse, held) if h]).reshape(-1, len(langs))
        temperature = best_temperature(logits, labels[held])
        return pd.DataFrame(
            {"lang": langs, "weights": [weights[:, k].astype(np.float32).tobytes() for k in range(len(langs))], "bias": bias, "temperature": temperature}
        )

    sample = learning_sample(learning, key, text, lang, rows)
    found = sample.groupBy().applyInPandas(train, "lang string, weights binary, bias double, temperature double").orderBy("lang").collect()
    return LanguageModel(
        [r.lang for r in found], idf, np.array([np.frombuffer(r.weights, np.float32) for r in found]).T.copy(), np.array([r.bias for r in found], np.float32), found[0].temperature
    )


def _predict(model: LanguageModel | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Language and score per text, 128 texts at a time."""
    langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    for k in range(0, len(texts) if model else 0, 128):
        p, letters = model.scores(texts[k : k + 128])
        best = p.argmax(axis=1)
        known = np.flatnonzero(letters > 0)
        langs[k + known] = np.array(model.langs, object)[best[known]]
        scores[k + known] = p[known, best[known]]
    return langs, np.clip(scores, 0, 1)


def predict(documents: DataFrame, model: LanguageModel | None, *also: Column, text: str = "text") -> DataFrame:
    """The columns ``also``, ``lang_pred`` and ``score`` per row; nothing but the text decides.

    ``und`` with score 0 for null texts, texts without a letter, and all texts if there is no model.
    """
    rows = documents.select(*also, F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = schema.fieldNames()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "_text", 1_000_000):
            langs, scores = _predict(model, block.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(langs.tolist(), pa.string()), pa.array(scores)], names)

    return rows.mapInArrow(work, schema)


def is_held_out(key: Column) -> Column:
    """Rows that are never learned from: a quarter, by the checksum of the key's decimal form; a null key is held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def identify(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``key``, ``held_out``, ``lang_pred``, ``score`` per row, learned from the rows that are not held out.

    Repeated rows get the same answer; no rows give no rows; other columns are not read.
    """
    model = fit(documents.where(~is_held_out(F.col(key))), key, text, lang, rows)
    return predict(documents, model, F.col(key), is_held_out(F.col(key)).alias("held_out"), text=text)


def keep_known(documents: DataFrame, min_score: float, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose language is known with ``min_score`` or more, with all their columns as they are."""
    model = fit(documents.where(~is_held_out(F.col(key))), key, text, lang)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, text, 1_000_000):
            langs, scores = _predict(model, block.column(text).to_pylist())
            yield block.filter(pa.array((langs != UNKNOWN) & (scores >= min_score)))

    return documents.mapInArrow(work, documents.schema)
