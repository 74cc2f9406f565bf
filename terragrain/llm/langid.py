"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters are hashed into FEATURES cells; a text's value in a cell is its share of all
n-grams there times the cell's inverse document frequency over all labelled texts. The weights are trained by follow-the-regularised-leader
with elastic-net penalties, so most of them stay exactly zero; a temperature fitted on rows kept out of the training
calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import crc_mod, lean, materialise, small, table

ORDERS, FEATURES = (1, 2, 3), 1 << 16
#: Documented bound of the training sample: this many rows, shared evenly by the languages, and as many of each at least. Whole
#: texts are read; a row goes to the driver as its cells, of which there are FEATURES at most.
SAMPLE_ROWS, LEAST_ROWS = 4_000, 40
#: FTRL: learning rate, smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 1e-4, 1e-5, 4
#: Most that a row of a rare language weighs.
HEAVIEST = 30.0
AT_ONCE = 2_000_000
UND = "und"
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@lru_cache(maxsize=1)
def fold() -> np.ndarray:
    """Code point -> lower case; everything that is no letter is a blank. One character to one."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def cells(texts: list[str], lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(orders, characters) hashed cells that start at each character of ``texts``, each led in by two blanks so that no cell
    reaches into the next one, the start of each text, and whether it has a letter."""
    joined = "".join("  " + t for t in texts) + "   "
    x = lut[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    n = len(x) - 3
    h, out = np.zeros(n, np.uint32), np.empty((len(ORDERS), n), np.uint16)
    for k in range(max(ORDERS)):
        h = (h ^ x[k : k + n]) * _MUL[k % 3]
        h ^= h >> np.uint32(15)
        if k + 1 in ORDERS:
            out[ORDERS.index(k + 1)] = ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.uint16)
    starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])[:-1]])
    letter = np.add.reduceat(x[:n] != 32, starts) > 0
    return out, starts, letter


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (FEATURES, languages), idf folded in
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str], lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) calibrated probabilities, and whether each text has a letter."""
        c, starts, letter = cells(texts, lut)
        n = np.diff(np.append(starts, c.shape[1]))
        z = np.zeros((len(texts), len(self.langs)))
        for j in range(len(self.langs)):
            w = np.ascontiguousarray(self.weights[:, j])
            per = w[c[0]]
            for row in c[1:]:
                per += w[row]
            z[:, j] = np.add.reduceat(per, starts, dtype=np.float64) / (n * len(ORDERS))
        z = (z + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), letter


def counted(text: str, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a whole text and their shares of all its n-grams."""
    n = np.zeros(FEATURES, np.int64)
    size = 0
    for k in range(0, max(1, len(text)), AT_ONCE):
        c, _, _ = cells([text[k : k + AT_ONCE]], lut)
        n += np.bincount(c.ravel(), minlength=FEATURES)
        size += c.size
    at = np.flatnonzero(n)
    return at, n[at] / size


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[str], df: np.ndarray, n: int, kept_out: float = 0.2) -> Model:
    """Train on the cells of labelled texts; ``df`` counts in how many of ``n`` texts a cell occurs. Deterministic: rows are
    used in the order given, the last ``kept_out`` part calibrates the temperature."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    y = np.array([langs.index(x) for x in labels])
    idf = np.log((1 + n) / (1 + df)) + 1
    k = len(langs)
    cut = max(1, round(len(docs) * (1 - kept_out)))
    z, n2 = np.zeros((FEATURES, k)), np.zeros((FEATURES, k))
    zb, nb = np.zeros(k), np.zeros(k)
    scale = 30.0  # shares are small numbers; this brings the values of a text to about one

    def weights(z: np.ndarray, n2: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n2)) / ALPHA + L2))

    def one(at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, b = weights(z[at], n2[at], L1), weights(zb, nb, 0.0)
        s = v @ w + b
        p = np.exp(s - s.max())
        return w, b, p / p.sum()

    heft = np.minimum(HEAVIEST, cut / (k * np.maximum(1, np.bincount(y[:cut], minlength=k))))  # rare languages weigh as much as others
    for _ in range(PASSES):
        for (at, tf), want in zip(docs[:cut], y[:cut]):
            v = tf * idf[at] * scale
            w, b, p = one(at, v)
            p[want] -= 1
            p *= heft[want]
            g = v[:, None] * p[None, :]
            s = (np.sqrt(n2[at] + g * g) - np.sqrt(n2[at])) / ALPHA
            z[at] += g - s * w
            n2[at] += g * g
            s = (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA
            zb += p - s * b
            nb += p * p
    w = weights(z, n2, L1)
    bias = weights(zb, nb, 0.0)
    rest = docs[cut:] or docs
    want = y[cut:] if len(docs) > cut else y
    logits = np.stack([(tf * idf[at] * scale) @ w[at] + bias for at, tf in rest])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), want]).mean())

    temperature = min((0.1 * 1.15**i for i in range(40)), key=loss)
    return Model(langs, (w * idf[:, None] * scale).astype(np.float32), bias, temperature)


def labelled(docs: DataFrame) -> DataFrame:
    """lang, text and a seeded number h of the rows that may be learned from: labelled, with a text, outside the held-out fold."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)).select("lang", "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("h"))


def training_rows(docs: DataFrame) -> DataFrame:
    """The bounded sample: of each language the rows with the least h, as many as its share of SAMPLE_ROWS. A threshold on h from
    the number of its rows comes first, so that what is ranked follows the sample and not the corpus."""
    rows = labelled(docs)
    counts = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-counts")
    most = max(LEAST_ROWS, SAMPLE_ROWS // max(1, counts.count()))
    share = F.least(F.lit(1.0), (1.5 * most + 100) / F.col("n"))
    some = rows.join(small(counts), "lang").where((share >= 1) | (F.col("h") <= F.least(share * 2.0**64 - 2.0**63, F.lit(9.2e18)).cast("long")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return some.withColumn("k", rank).where(F.col("k") <= most).select(F.xxhash64(F.lit(6), "h").alias("h"), "lang", "text")  # in an order that mixes the languages


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts that may be learned from each cell occurs, and the number of these texts."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen = np.zeros(FEATURES, bool)
                for k in range(0, max(1, len(text)), AT_ONCE):
                    seen[cells([text[k : k + AT_ONCE]], fold())[0].ravel()] = True
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], ["cell", "n"])

    rows = labelled(docs).select("text").mapInArrow(lean(scan), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # FEATURES + 1 rows at most
    cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(FEATURES)
    df[cell[cell >= 0]] = n[cell >= 0]
    return df, int(n[cell < 0].sum())


def train(docs: DataFrame) -> Model:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, lang, text in zip(*(batch.column(c).to_pylist() for c in ("h", "lang", "text"))):
                at, share = counted(text, fold())
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([lang]), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([share.astype("<f4").tobytes()], pa.binary())], ["h", "lang", "cells", "shares"])

    rows = training_rows(docs).mapInArrow(lean(scan), "h long, lang string, cells binary, shares binary").collect()  # bounded, see SAMPLE_ROWS
    rows.sort(key=lambda r: (r["h"], r["lang"]))
    return fit([(np.frombuffer(r["cells"], "<u2").astype(np.int64), np.frombuffer(r["shares"], "<f4").astype(float)) for r in rows], [r["lang"] for r in rows], *frequencies(docs))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, over its whole text.

    A null text, or one without a letter, is ``und`` with score 0. Without training rows everything is ``und``.
    Ties between languages go to the first in sorted order. Only the text is an input of a prediction; other
    columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lut = shared.value, fold()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pred, score, k = [], [], 0
            while k < len(texts):
                group, n = [], 0
                while k < len(texts) and (not group or n + len(texts[k]) <= AT_ONCE):
                    group.append(texts[k])
                    n += len(texts[k])
                    k += 1
                if not model.langs:
                    pred += [UND] * len(group)
                    score += [0.0] * len(group)
                    continue
                p, letter = model.scores(group, lut)
                best = p.argmax(axis=1)
                pred += [model.langs[b] if ok else UND for b, ok in zip(best, letter)]
                score += np.where(letter, p[np.arange(len(best)), best], 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(lean(scan), "doc_id long, held_out boolean, lang_pred string, score double")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, train(docs))
