"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties; its confidences are calibrated by one temperature.

Document frequencies come from all documents. The classifier is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import hashed_sample, small_batches, texts

#: Most labelled documents the classifier is fitted on; hash bits of the features; longest n-gram; least confidence kept, of
#: texts with at least so many letters: a word or two may belong to several languages and is no reason to reject a document.
SAMPLE, BITS, LONGEST, LEAST, ENOUGH = 2000, 15, 3, 0.35, 20
#: Lengths of windows of the sampled texts that are trained on beside the whole texts, so that short documents are known too.
WINDOWS = (12, 40, 160)
UNKNOWN = "und"
BLOCK = 1 << 19


def features(batch: list[str | None], bits: int = BITS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count), sorted by document and feature: hashed character n-grams of 1 to `longest` characters of the
    lower-case text, white space runs being one space."""
    clean = [" ".join((x or "").lower().split()) for x in batch]
    lens = np.fromiter(map(len, clean), np.int64, len(clean))
    points = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(clean), dtype=np.uint64), lens)
    keys, h = [], np.zeros(len(points), np.uint32)
    for n in range(1, longest + 1):
        if len(points) < n:
            break
        m = len(points) - n + 1
        h = h[:m] * np.uint32(0x01000193) ^ points[n - 1 :] * np.uint32(0x9E3779B1)
        f = (h ^ np.uint32(n)) * np.uint32(0x85EBCA6B)
        f = ((f ^ (f >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
        own = doc[:m] << np.uint64(bits) | f
        keys.append(own[doc[:m] == doc[n - 1 :]] if n > 1 else own)
    key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    key = np.sort(key.astype(np.uint32) if len(clean) < 1 << (32 - bits) else key)
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    some = key[new].astype(np.int64)
    return some >> bits, some & ((1 << bits) - 1), np.diff(np.r_[new, len(key)])


def blocks(column: pa.Array):
    """Lists of texts of about BLOCK characters each; a longer text is a list of its own."""
    out, n = [], 0
    for x in column:
        x = x.as_py()
        if out and n + len(x or "") > BLOCK:
            yield out
            out, n = [], 0
        out.append(x)
        n += len(x or "")
    if out:
        yield out


def document_frequencies(docs: DataFrame, bits: int = BITS) -> tuple[int, np.ndarray]:
    """(documents, for each feature those that have it), over all rows of docs. Each task sends one row a feature."""

    def count(batches):
        n, df = 0, np.zeros(1 << bits, np.int64)
        for batch in batches:
            for block in blocks(batch["text"]):
                df += np.bincount(features(block, bits)[1], minlength=1 << bits)
                n += len(block)
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.r_[-1, some]), pa.array(np.r_[n, df[some]])], ["feature", "n"])

    got = docs.select("text").mapInArrow(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << bits, np.int64)
    own = got[got.feature >= 0]
    df[own.feature.to_numpy()] = own.n.to_numpy()
    return int(got.n[got.feature < 0].sum()), df


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # feature x language
    bias: np.ndarray
    temperature: float = 1.0

    def vectors(self, batch: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value): (1 + log count) x idf, each document of length 1."""
        doc, f, n = features(batch, int(len(self.idf)).bit_length() - 1)
        v = (1 + np.log(n)) * self.idf[f]
        norm = np.sqrt(np.bincount(doc, v * v, len(batch)))
        return doc, f, v / norm[doc]

    def logits(self, batch: list[str | None]) -> np.ndarray:
        doc, f, v = self.vectors(batch)
        w = self.weights[f]
        return np.stack([np.bincount(doc, v * w[:, k], len(batch)) for k in range(len(self.languages))], 1) + self.bias

    def probabilities(self, batch: list[str | None]) -> np.ndarray:
        return softmax(self.logits(batch) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_features: int, n_labels: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by FTRL-proximal, one example at a time: a coordinate is 0 until its sum of gradients exceeds l1."""
    z, n = np.zeros((n_features + 1, n_labels)), np.zeros((n_features + 1, n_labels))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, x = np.r_[rows[i][0], n_features], np.r_[rows[i][1], 1.0]
            w = weights(z[f], n[f])
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha * w
            n[f] += g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()
    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, most: int = SAMPLE, bits: int = BITS) -> Model | None:
    """A model from the column lang of docs (doc_id, text, lang); None where no row has a label, an id and a text.

    At most `most` labelled documents, those of least hash of doc_id, are fitted; a fifth of them sets the temperature."""
    n, df = document_frequencies(docs, bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    labelled = docs.where("lang is not null and doc_id is not null and trim(text) != ''").select("doc_id", "text", "lang")
    got = sorted((r.doc_id, r.lang, r.text) for r in hashed_sample(labelled, "doc_id", most).collect())
    if not got:
        return None
    languages = sorted({lang for _, lang, _ in got})
    model = Model(languages, idf, np.zeros((1 << bits, len(languages))), np.zeros(len(languages)))
    rng, parts = np.random.default_rng(11), ([], [])
    for k, (_, lang, text) in enumerate(got):
        begin = rng.integers(0, max(1, len(text)), len(WINDOWS))
        for x in [text, *(text[max(0, min(b, len(text) - w)) :][:w] for b, w in zip(begin, WINDOWS))]:
            parts[k % 5 == 4].append((x, languages.index(lang)))
    fit, held = parts
    vectors = []
    for at in range(0, len(fit), 500):
        doc, f, v = model.vectors([x for x, _ in fit[at : at + 500]])
        ends = np.searchsorted(doc, np.arange(len(fit[at : at + 500]) + 1))
        vectors += [(f[a:b], v[a:b]) for a, b in zip(ends, ends[1:])]
    model.weights, model.bias = fit_ftrl(vectors, np.array([y for _, y in fit]), 1 << bits, len(languages))
    model.weights = model.weights.astype(np.float32)
    model.temperature = fit_temperature(model.logits([x for x, _ in held]), np.array([y for _, y in held], np.int64)) if held else 1.0
    return model


def identify(docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """(doc_id, lang, confidence, accepted) for every row of docs.

    A text that is null or has no letter is of language "und" with confidence 0 and isn't accepted. Others are accepted if
    their calibrated confidence is at least `least` or they have fewer letters than ENOUGH; without a model they are "und"
    with confidence 0, and accepted. Repeated
    rows and null doc_ids give a row each; ties go to the language first in order; an empty table gives an empty one.
    """
    return texts(docs).mapInArrow(_identify(model, least, ["doc_id"]), "doc_id bigint, lang string, confidence double, accepted boolean")


def _identify(model: Model | None, least: float, keep: list[str]):
    def run(batches):
        for batch in batches:
            lang, sure, ok = [], [], []
            for block in blocks(batch["text"]):
                p = model.probabilities(block) if model else np.zeros((len(block), 1))
                best = p.argmax(1)
                for x, k, c in zip(block, best.tolist(), p.max(1).tolist()):
                    letters = x is not None and any(map(str.isalpha, x))
                    enough = c >= least or model is None or sum(map(str.isalpha, x or "")) < ENOUGH
                    lang.append(model.languages[k] if model and letters else UNKNOWN)
                    sure.append(c if letters else 0.0)
                    ok.append(letters and enough)
            kept = [batch[c] for c in keep]
            yield pa.record_batch([*kept, pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(ok, pa.bool_())], [*keep, "lang", "confidence", "accepted"])

    return run


def language_id(docs: DataFrame, most: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """identify() with a model trained on the labels of docs itself."""
    return identify(docs, train(docs, most), least)


def keep_identified(docs: DataFrame, most: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) without the rows that aren't accepted; lang is the language found.

    A null or empty text has no letters and goes; rows that repeat another, and null doc_ids, are judged like any; an empty table
    gives an empty one; other columns are left out.
    """
    small_batches(docs.sparkSession)
    model = train(docs, most)
    keep = ["doc_id", "text", "source", "n_chars"]
    found = docs.select(*keep).mapInArrow(_identify(model, least, keep), "doc_id bigint, text string, source string, n_chars bigint, lang string, confidence double, accepted boolean")
    return found.where("accepted").select("doc_id", "text", "lang", "source", "n_chars")
