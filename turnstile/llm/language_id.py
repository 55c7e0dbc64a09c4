"""Language identification with a string kernel.

Two texts are compared by the byte n-grams (n = 1, 2, 3) that occur in both:
``k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|)``, where ``G`` holds the
n-grams of a text that occur in any landmark.  Landmarks are training texts;
with ``K`` their kernel matrix, ``k(x, landmarks) K^(-1/2)`` are the Nystrom
features on which one-versus-rest ridge regression is solved.  The weights of
all steps after the presence vector are linear, so a batch of texts is scored
by one product of its presence matrix with an (n-grams x languages) matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm import textarrays as ta

ORDERS = (1, 2, 3)
CELLS = 1 << 24              # of a presence matrix: texts at once times n-grams
_LETTER = regex.compile(r"\p{L}")
_FOLD = ta._LOWER.copy()     # A-Z to a-z, other ASCII non-letters to blank
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


@dataclass
class LanguageModel:
    languages: list[str]
    grams: list[np.ndarray]      # for each order, the sorted codes of its n-grams
    weights: np.ndarray          # (n-grams, languages)
    bias: np.ndarray
    sharpness: float

    def tables(self) -> list[np.ndarray]:
        out, first = [], 0
        narrow = sum(map(len, self.grams)) <= np.iinfo(np.int16).max
        for n, codes in zip(ORDERS, self.grams):
            table = np.full(256 ** n, -1, np.int16 if narrow else np.int32)
            table[codes] = np.arange(first, first + len(codes))
            first += len(codes)
            out.append(table)
        return out


def _codes(data: np.ndarray, rows: np.ndarray):
    """For each order, n-gram codes and the rows they belong to."""
    folded = _FOLD[data].astype(np.int32)
    for n in ORDERS:
        if len(folded) < n:
            yield np.zeros(0, np.int32), np.zeros(0, np.int64)
            continue
        code = folded[:len(folded) - n + 1].copy()
        for k in range(1, n):
            code = (code << 8) | folded[k:len(folded) - n + 1 + k]
        first, last = rows[:len(code)], rows[n - 1:]
        inside = first == last
        yield (code, first) if n == 1 else (code[inside], first[inside])


def presence(data: np.ndarray, offs: np.ndarray, tables: list[np.ndarray], n_grams: int) -> np.ndarray:
    out = np.zeros((len(offs) - 1, n_grams), bool)
    rows = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    for (code, row), table in zip(_codes(data, rows), tables):
        at = table[code]
        known = at >= 0
        out[row[known], at[known]] = True
    return out


def _at_once(n_grams: int) -> int:
    """How many texts a presence matrix holds."""
    return max(1, min(512, CELLS // max(1, n_grams)))


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return ta.text_buffer(pa.array(texts, pa.string()))


def fit(texts: list[str], langs: list[str], landmarks_per_language: int = 64, ridge: float = 0.1,
        sharpness: float = 8.0) -> LanguageModel:
    """Fits the model on the driver from a bounded sample of texts."""
    names = sorted(set(langs))
    picked = [i for name in names for i in [k for k, x in enumerate(langs) if x == name][:landmarks_per_language]]
    data, offs = _joined([texts[i] for i in picked])
    rows = np.repeat(np.arange(len(picked)), np.diff(offs))
    grams = [np.unique(code) for code, _ in _codes(data, rows)]
    model = LanguageModel(names, grams, np.zeros(0), np.zeros(0), sharpness)
    tables, n_grams = model.tables(), sum(map(len, grams))
    step = _at_once(n_grams)

    def unit(x):
        x = x.astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    marks = unit(presence(data, offs, tables, n_grams))
    kernel = []
    for i in range(0, len(texts), step):
        kernel.append(unit(presence(*_joined(texts[i:i + step]), tables, n_grams)) @ marks.T)
    kernel = np.concatenate(kernel).astype(float)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])                  # K^(-1/2) on its range
    z = kernel @ root
    y = (np.array(langs)[:, None] == np.array(names)).astype(float)
    weight = 1 / y.sum(0)[y.argmax(1)]                             # languages count alike
    weight /= weight.mean()
    zc, yc = np.average(z, 0, weight), np.average(y, 0, weight)
    zw = (z - zc) * weight[:, None]
    coef = np.linalg.solve(zw.T @ (z - zc) + ridge * np.eye(z.shape[1]), zw.T @ (y - yc))
    model.weights = (marks.T @ (root @ coef)).astype(np.float32)
    model.bias = (yc - zc @ coef).astype(np.float32)
    return model


def _predict(model: LanguageModel, text_col: str):
    def run(batches):
        tables, names = model.tables(), np.array(model.languages, object)
        step = _at_once(len(model.weights))
        for b in batches:
            column = ta.struct_field(b.column(0), text_col)
            data, offs = ta.text_buffer(column)
            for i, j in ta.chunks(offs):
                for a in range(i, j, step):
                    e = min(j, a + step)
                    x = presence(data[offs[a]:offs[e]], offs[a:e + 1] - offs[a], tables, len(model.weights))
                    f = x.astype(np.float32) @ model.weights / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + model.bias
                    p = np.exp((f - f.max(1, keepdims=True)) * model.sharpness)
                    p /= p.sum(1, keepdims=True)
                    texts = column.slice(a, e - a).to_pylist()
                    known = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(a, e - a), pa.array(np.where(known, names[p.argmax(1)], "und"), pa.string()),
                         pa.array(np.where(known, p.max(1), 0.0).astype(float))], names=["row", "lang_pred", "score"])
    return ta.tidy(run)


def training_sample(docs: DataFrame, per_language: int, max_chars: int, text_col: str, lang_col: str) -> list:
    """About ``per_language`` distinct texts of each language, chosen by a hash of the text."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= max_chars))
    rows = rows.withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()      # one row per language
    if not counts:
        return []
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.3 * per_language / r["n"]))])
    place = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(place < rate[F.col("lang")]).groupBy("h", "lang").agg(F.min("text").alias("text"))
    return picked.orderBy(place, "lang").limit(2 * per_language * len(counts)).collect()


def identify(docs: DataFrame, train: DataFrame, per_language: int = 400, max_chars: int = 20_000,
             landmarks_per_language: int = 64, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``row, lang_pred, score`` of every row of ``docs``; ``row`` is a struct of all its columns.

    The model is fitted on a bounded sample of ``train`` (about
    ``per_language`` distinct texts of at most ``max_chars`` characters of
    each non-null language) and reads whole texts when it predicts.  A null
    text, or one without a letter, is ``und`` with score 0; so is everything
    if there is nothing to learn from.  Repeated rows and nulls in other
    columns stay; columns of any name are carried in ``row``; an empty table
    gives none.  Ties go to the language that sorts first.  ``score`` is the
    predicted language's share (0 to 1).
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))         # each text goes to Python once, in its row
    sample = training_sample(train, per_language, max_chars, text_col, lang_col)
    if not sample:
        return rows.select("row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = fit([r["text"] for r in sample], [r["lang"] for r in sample], landmarks_per_language)
    return rows.mapInArrow(_predict(model, text_col), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
