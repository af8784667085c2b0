"""Language identification with a blended-spectrum string kernel (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_batches, table, text_or_empty

#: Bounds of the sample that the classifier is fitted on; prediction reads every text whole.
PER_LANG, MAX_LANGS, MAX_TRAIN_CHARS = 200, 256, 20_000
#: Landmark texts, at least one of every language, and byte grams; both belong to the fit alone.
LANDMARKS, VOCABULARY, RIDGE = 96, 4096, 1e-3
#: Parts of a language that are ranked on their own first.
DEALT = 64
#: Of the share of known grams that 99 in 100 labelled texts reach, a text in a known language has at least this part.
KNOWN_SHARE = 0.7
UND = "und"
NGRAMS = (1, 2, 3)


def normalised():
    """Lower-case letters, everything else one space; done by Spark before any Python."""
    return F.regexp_replace(F.lower(text_or_empty()), r"[^\p{L}]+", " ")


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


@dataclass
class Kernel:
    """Presence of 1- to 3-byte grams of a fixed vocabulary, compared with landmark texts."""

    grams: list[np.ndarray]
    landmarks: np.ndarray = None
    weights: np.ndarray = None
    bias: np.ndarray = None
    langs: list[str] = field(default_factory=list)
    least: float = 0.0
    _tables: list = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    @property
    def size(self) -> int:
        return sum(map(len, self.grams))

    def tables(self) -> list[np.ndarray]:
        """Column of every possible gram, 0 for those outside the vocabulary (column 0 is thrown away)."""
        if self._tables is None:
            self._tables, at = [], 1
            for n, codes in zip(NGRAMS, self.grams, strict=True):
                t = np.zeros(256**n, np.int16)
                t[codes] = np.arange(at, at + len(codes))
                at += len(codes)
                self._tables.append(t)
        return self._tables

    def presence(self, texts: list[bytes]) -> np.ndarray:
        """0/1 rows by texts over the vocabulary; grams never cross from one text to the next."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer(b"".join(texts), np.uint8).astype(np.int32)
        width = self.size + 1
        row = np.repeat(np.arange(len(texts), dtype=np.int64) * width, lens)
        left = np.repeat(np.cumsum(lens), lens) - np.arange(len(codes))
        out = np.zeros(len(texts) * width, np.float32)
        gram = np.zeros(0, np.int32)
        for n, t in zip(NGRAMS, self.tables(), strict=True):
            gram = codes if n == 1 else (gram[:-1] << 8) | codes[n - 1 :]
            whole = left[: len(gram)] >= n
            out[row[: len(gram)][whole] + t[gram[whole]]] = 1
        return out.reshape(len(texts), width)[:, 1:]

    def covered(self, texts: list[bytes]) -> np.ndarray:
        """Share of each text's longest grams that the vocabulary has; 1 for texts too short to have one."""
        n, table = NGRAMS[-1], self.tables()[-1]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        gram = codes = np.frombuffer(b"".join(texts), np.uint8).astype(np.int32)
        for k in range(1, n):
            gram = (gram[:-1] << 8) | codes[k:]
        row = np.repeat(np.arange(len(texts)), lens)[: len(gram)]
        whole = (np.repeat(np.cumsum(lens), lens) - np.arange(len(codes)))[: len(gram)] >= n
        held = np.bincount(row[whole], weights=table[gram[whole]] > 0, minlength=len(texts))
        every = np.bincount(row[whole], minlength=len(texts))
        return np.where(every > 0, held / np.maximum(every, 1), 1.0)

    def similarity(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        own, their = rows.sum(axis=1), others.sum(axis=1)
        return (rows @ others.T) / np.sqrt(np.maximum(own[:, None] * their[None, :], 1))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.similarity(self.presence(texts), self.landmarks) @ self.weights + self.bias


def gram_counts(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    every = []
    for x in texts:
        b = np.frombuffer(x, np.uint8).astype(np.int32)
        g = b
        for k in range(1, n):
            g = (g[:-1] << 8) | b[k:]
        every.append(np.unique(g))
    return np.unique(np.concatenate(every) if every else np.zeros(0, np.int32), return_counts=True)


def fitted(texts: list[str], langs: list[str]) -> Kernel | None:
    """Nyström landmarks and one ridge regression per language, over the given texts (normalised)."""
    if not texts:
        return None
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    parts = [gram_counts(raw, n) for n in NGRAMS]
    ranked = sorted(((-int(c), n, int(g)) for n, (g, cs) in zip(NGRAMS, parts, strict=True) for g, c in zip(g, cs, strict=True)))[:VOCABULARY]
    model = Kernel([np.array(sorted(g for _, k, g in ranked if k == n), np.int64) for n in NGRAMS])
    model.langs = sorted(set(langs))
    x = model.presence(raw)
    at, picked = {}, []
    for i, lang in enumerate(langs):  # landmarks in turn over the languages
        at.setdefault(lang, []).append(i)
    for k in range(max(map(len, at.values()))):
        picked += [at[lang][k] for lang in model.langs if k < len(at[lang])]
    model.landmarks = x[picked[: max(LANDMARKS, len(model.langs))]]
    values, vectors = np.linalg.eigh(model.similarity(model.landmarks, model.landmarks).astype(np.float64))
    good = values > 1e-6 * values[-1]
    half = vectors[:, good] / np.sqrt(values[good])
    z = model.similarity(x, model.landmarks).astype(np.float64) @ half
    y = np.where(np.array(langs)[:, None] == np.array(model.langs)[None, :], 1.0, -1.0)
    mean_z, mean_y = z.mean(axis=0), y.mean(axis=0)
    zc = z - mean_z
    w = np.linalg.solve(zc.T @ zc + RIDGE * len(z) * np.eye(z.shape[1]), zc.T @ (y - mean_y))
    model.weights = (half @ w).astype(np.float32)
    model.bias = (mean_y - mean_z @ w).astype(np.float32)
    model.least = KNOWN_SHARE * float(np.quantile(model.covered(raw), 0.01))
    return model


def training_sample(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], list[str]]:
    """At most per_lang distinct texts of each language, those of least text hash; never a held-out document."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out() & F.length("text").between(1, MAX_TRAIN_CHARS))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    # A common language is dealt to many tasks by hash, each of which keeps its least; these few are ranked once more.
    deal = F.pmod(F.shiftright("h", 8), F.lit(DEALT))
    first = F.row_number().over(Window.partitionBy("lang", "deal").orderBy("h"))
    few = rows.select("lang", "h", deal.alias("deal")).distinct().withColumn("r", first).where(F.col("r") <= per_lang)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = few.withColumn("r", rank).where(F.col("r") <= per_lang)
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).select("lang")
    picked = few.join(F.broadcast(sizes), "lang", "left_semi").select("lang", "h")  # at most 256 rows
    pairs = [(r["lang"], r["h"]) for r in picked.collect()]
    if not pairs:
        return [], []
    ids = docs.sparkSession.createDataFrame(pairs, "lang string, h long")
    got = rows.withColumn("text", normalised()).join(F.broadcast(ids), ["lang", "h"]).where("trim(text) != ''").dropDuplicates(["lang", "h"])
    out = sorted((r["lang"], r["h"], r["text"]) for r in got.collect())
    return [x[2] for x in out], [x[0] for x in out]


def predict(docs: DataFrame, model: Kernel | None, into: str = "_language", known_only: bool = False) -> DataFrame:
    """docs with the struct `into` (lang_pred, score): a narrow map in batches of matrix products; only normalised texts go to Python.

    With known_only, texts with fewer known grams than labelled ones have (Kernel.least) are `und` too.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts = [x.encode("utf-8", "surrogatepass") for x in batch]
            langs, scores, a = [], [], 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and b - a < 128 and (b == a or size + len(texts[b]) < 1 << 18):
                    size += len(texts[b])
                    b += 1
                some = [bool(x.strip()) for x in texts[a:b]]
                if known_only and model is not None:
                    some = [x and bool(c >= model.least) for x, c in zip(some, model.covered(texts[a:b]), strict=True)]
                if model is None:
                    langs += [UND] * (b - a)
                    scores += [0.0] * (b - a)
                else:
                    s = model.scores(texts[a:b])
                    at, top = s.argmax(axis=1), np.clip((s.max(axis=1) + 1) / 2, 0, 1)
                    langs += [model.langs[i] if ok else UND for i, ok in zip(at, some, strict=True)]
                    scores += [float(v) if ok else 0.0 for v, ok in zip(top, some, strict=True)]
                a = b
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn(into, scored(normalised()))


def identify(docs: DataFrame, into: str = "_language", known_only: bool = False) -> DataFrame:
    """Fit on a bounded sample of labelled documents, then predict every document from its whole text.

    A text that is null or has no letter is `und` with score 0; so is everything if no document is
    labelled. Repeated rows and ties of doc_id are predicted row by row; other columns pass unchanged.
    """
    return predict(docs, fitted(*training_sample(docs)), into, known_only)


def keep_language(docs: DataFrame) -> DataFrame:
    """docs without those in no known language (noise, or a language without labels); all columns unchanged."""
    return identify(docs, "_language", known_only=True).where(F.col("_language.lang_pred") != UND).drop("_language")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out().alias("held_out"), "_language.lang_pred", "_language.score")
