"""Quality classification by co-training two views of a document.

The content view describes the text (byte frequencies, word statistics), the
metadata view the other columns (source, language, length).  Each view has a
logistic model.  In every round a model labels the unlabelled documents it is
surest of, among all unlabelled ones, for the other model.  Both are then
calibrated on labelled documents kept aside, and a logistic model of the two calibrated log-odds
gives the final score; a view without information ends with no weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm import textarrays as ta
from turnstile.llm.scratch import Scratch

N_STATS = 12
N_CONTENT = 256 + N_STATS
SOURCE_SLOTS, LANG_SLOTS, SIZE_SLOTS = 64, 16, 16
N_META = SOURCE_SLOTS + LANG_SLOTS + SIZE_SLOTS
ROWS_AT_ONCE = 2048          # rows of features that are a matrix at once
VIEW_BYTES = 1 << 18         # text that is turned into features at once; a longer one stands alone


def content_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row per text: square roots of byte shares, then word statistics."""
    n = len(offs) - 1
    size = np.diff(offs)
    out = np.zeros((n, N_CONTENT), np.float32)
    code = np.repeat(np.arange(n) * 256, size)
    code += data
    counts = np.bincount(code, minlength=n * 256).reshape(n, 256)
    del code                                                # 8 bytes for each of the text
    out[:, :256] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    s, e, row = ta.words(data, offs)
    h = ta.word_hashes(ta.lower_ascii(data), s, e)
    n_words = np.bincount(row, minlength=n)
    some = np.maximum(n_words, 1)
    same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) if len(h) else np.zeros(0, np.int64)
    again = np.bincount(row[same], minlength=n) if len(same) else np.zeros(n)
    _, distinct_rows = ta.distinct_sorted(h, row)
    distinct = np.bincount(distinct_rows, minlength=n)
    length = (e - s).astype(float)
    mean = np.bincount(row, weights=length, minlength=n) / some
    square = np.bincount(row, weights=length ** 2, minlength=n) / some
    one = np.bincount(row, weights=length == 1, minlength=n) / some
    letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122) | (data >= 128)
    odd = ~letter & ~ta._SPACE[data]
    mark = np.bincount(row, weights=odd[s], minlength=n) / some if len(s) else np.zeros(n)
    tail = np.bincount(row, weights=odd[e - 1], minlength=n) / some if len(s) else np.zeros(n)
    letters = np.concatenate([[0], np.cumsum(letter)])
    share = (letters[offs[1:]] - letters[offs[:-1]]) / np.maximum(size, 1)
    del letters
    lines = counts[:, 10] / some
    stats = [again / some, np.sqrt(again / some), distinct / some, mean / 10, np.sqrt(np.maximum(square - mean ** 2, 0)) / 10,
             one, mark, tail, share, lines, np.log1p(n_words) / 10, n_words == 0]
    out[:, 256:] = np.stack(stats, 1)
    return out


def _slot(value, slots: int) -> int:
    return 0 if value is None else 1 + xxhash.xxh64_intdigest(value) % (slots - 1)


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """One-hot slots of source, language and the length's order of magnitude; null has its own slot."""
    out = np.zeros((len(source), N_META), np.float32)
    at = np.arange(len(source))
    out[at, [_slot(x, SOURCE_SLOTS) for x in source]] = 1
    out[at, [SOURCE_SLOTS + _slot(x, LANG_SLOTS) for x in lang]] = 1
    bins = [0 if x is None or x < 0 else 1 + min(SIZE_SLOTS - 2, int(np.log2(x + 1) * 0.8)) for x in n_chars]
    out[at, [SOURCE_SLOTS + LANG_SLOTS + b for b in bins]] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 25) -> np.ndarray:
    """Weights (last one the constant) of ridge logistic regression by Newton steps."""
    x = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        r = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * r[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass
class QualityModel:
    content: np.ndarray
    meta: np.ndarray
    calibration: list            # (slope, constant) of each view
    mix: np.ndarray              # weights of the two log-odds and a constant

    @property
    def informed(self) -> bool:
        """Whether a view tells documents apart; if not, all have the same score."""
        return any(m * slope > 0 for m, (slope, _) in zip(self.mix, self.calibration))

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        views = [_logit(content, self.content) * self.calibration[0][0] + self.calibration[0][1],
                 _logit(meta, self.meta) * self.calibration[1][0] + self.calibration[1][1]]
        both = views[0] * self.mix[0] + views[1] * self.mix[1] + self.mix[2]
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (*views, both))


def co_train(content, meta, labels, totals, draw, rounds: int = 4, per_round: int = 100, sure: float = 0.95) -> QualityModel:
    """Fits both views from labelled rows and unlabelled ones that ``draw`` finds.

    ``totals`` are the numbers of bad and good labels that the rows stand
    for.  ``draw(weights, offset, taken, n, sure)`` gives, for each view and
    class, the hashes and both views of the ``n`` surest unlabelled texts.
    Every fourth row of a class is kept aside for calibration; a class of
    fewer than four rows serves in both.
    """
    if len(labels) == 0 or labels.min() == labels.max():          # nothing to tell apart: the prior for all
        prior = (totals[1] + 1) / (sum(totals) + 2)
        zero = [(0.0, 0.0), (0.0, 0.0)]
        return QualityModel(np.zeros(N_CONTENT + 1), np.zeros(N_META + 1), zero, np.array([0, 0, np.log(prior / (1 - prior))]))
    held, both = np.zeros(len(labels), bool), np.zeros(len(labels), bool)
    for y in (0, 1):
        at = np.flatnonzero(labels == y)
        held[at[3::4]] = True
        both[at] = len(at) < 4
    share = totals / np.sum(totals)
    odds = (labels == 1).sum() / (labels == 0).sum()
    offset = np.log(totals[1] / totals[0] / odds)                  # from the sample's odds to those of all labels
    own = [(content[~held], labels[~held]), (meta[~held], labels[~held])]
    held |= both
    taken = np.zeros(0, np.int64)
    for k in range(rounds + 1):
        weights = [logistic(x, y, l2=0.5) for x, y in own]
        if k == rounds:
            break
        wanted = [max(1, round(per_round * s)) for s in share]
        found = draw(weights, offset, taken, 4 * max(wanted), sure)   # a text may be among the surest of all four
        before = len(taken)
        for v in (0, 1):
            for y in (1, 0):
                h, *views = found[v, y]
                best = np.flatnonzero(~np.isin(h, taken))[:wanted[y]]
                taken = np.concatenate([taken, h[best]])
                x_other, y_other = own[1 - v]
                own[1 - v] = (np.concatenate([x_other, views[1 - v][best]]), np.concatenate([y_other, np.full(len(best), float(y))]))
        if len(taken) == before:
            break
    calibration, logits = [], []
    for x, w in zip((content, meta), weights):
        z = _logit(x[held], w)
        slope, constant = logistic(z[:, None], labels[held], l2=1.0)
        slope = max(slope, 0.0)
        calibration.append((slope, constant + offset))
        logits.append(z * slope + constant)
    mix = logistic(np.stack(logits, 1), labels[held], l2=1.0)
    a, b = max(mix[0], 0), max(mix[1], 0)
    return QualityModel(*weights, calibration, np.array([a, b, mix[2] + offset - (a + b) * offset]))


def _views(b: pa.RecordBatch):
    data, offs = ta.text_buffer(b.column("text"))
    for i, j in ta.chunks(offs):
        part = {n: b.column(n).slice(i, j - i) for n in b.schema.names}
        at = offs[i:j + 1]
        content = [content_features(data[at[k]:at[m]], at[k:m + 1] - at[k]) for k, m in ta.chunks(at - at[0], VIEW_BYTES)]
        yield part, np.concatenate(content), meta_features(part["source"].to_pylist(), part["lang"].to_pylist(), part["n_chars"].to_pylist())


def _features(batches):
    for b in batches:
        for part, content, meta in _views(b):
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["h"], pa.array([x.tobytes() for x in content], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())],
                names=["doc_id", "h", "content", "meta"])


_FEATURES = "doc_id long, h long, content binary, meta binary"
_SUREST = "kind int, q double, h long, content binary, meta binary"


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _surest(weights, offset: float, taken: np.ndarray, n: int, sure: float):
    """The ``n`` surest distinct texts of a partition for each view and class (kind 2 * view + class)."""
    def run(batches):
        kept = {}
        for b in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            h = b.column("h").to_numpy()
            free = ~np.isin(h, taken)
            for v, (name, width) in enumerate((("content", N_CONTENT), ("meta", N_META))):
                p = 1 / (1 + np.exp(-np.clip(_logit(_matrix(b.column(name), width), weights[v]) + offset, -30, 30)))
                for y, q in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero(free & (q >= sure))
                    at = at[np.lexsort((h[at], -q[at]))]
                    at = at[np.sort(np.unique(h[at], return_index=True)[1])][:n]
                    rows = pa.Table.from_arrays([pa.array(np.full(len(at), 2 * v + y, np.int32)), pa.array(q[at]),
                                                 *(b.column(c).take(pa.array(at)) for c in ("h", "content", "meta"))],
                                                names=["kind", "q", "h", "content", "meta"])
                    if (v, y) in kept:
                        rows = pa.concat_tables([kept[v, y], rows])
                        hs = rows.column("h").to_numpy()
                        at = np.lexsort((hs, -rows.column("q").to_numpy()))
                        rows = rows.take(pa.array(at[np.sort(np.unique(hs[at], return_index=True)[1])][:n]))
                    kept[v, y] = rows
        for rows in kept.values():
            yield from rows.combine_chunks().to_batches()
    return ta.tidy(run)


def _scores(model: QualityModel):
    def run(batches):
        for b in batches:
            row = b.column(0)
            columns = [row] + [ta.struct_field(row, n) for n in ("text", "source", "lang", "n_chars")]
            named = pa.RecordBatch.from_arrays(columns, names=["row", "text", "source", "lang", "n_chars"])
            for part, content, meta in _views(named):
                p, q, both = model.score(content, meta)
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(p), pa.array(q), pa.array(both)],
                                                 names=["row", "content_score", "meta_score", "score"])
    return ta.tidy(run)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                       F.col("n_chars").cast("long").alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, n_labelled: int = 4000, max_chars: int = 50_000) -> QualityModel:
    """The co-trained model; arguments as for ``classify``."""
    scratch = Scratch(docs.sparkSession, "quality")
    judged = (labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg((F.avg("quality") >= 0.5).cast("double").alias("label")))
    texts = _rows(docs).drop("row").where("text is not null and doc_id is not null").withColumn("h", F.xxhash64("text"))
    keyed = texts.select("doc_id", "h", (F.length("text") > max_chars).alias("long")).join(judged, "doc_id", "left")
    one = keyed.groupBy("h").agg(F.min(F.struct(F.col("label").isNull().alias("u"), "doc_id", "label", "long")).alias("x"))
    one = scratch.write(one.select("h", "x.doc_id", "x.label", "x.long"), "texts")
    n = {r["label"]: r["n"] for r in one.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    totals = np.array([n.get(0.0, 0), n.get(1.0, 0)], float)
    # at most n_labelled ids of each class, so the broadcast has a fixed bound
    short = one.where("not long").drop("long")
    picked = short.where("label = 0").orderBy("h").limit(n_labelled).union(short.where("label = 1").orderBy("h").limit(n_labelled))
    sample = (texts.join(F.broadcast(picked.drop("label")), ["doc_id", "h"]).dropDuplicates(["h"])
              .mapInArrow(ta.tidy(_features), _FEATURES).join(F.broadcast(picked.select("h", "label")), "h")
              .orderBy("h").limit(2 * n_labelled).select("label", "content", "meta").toArrow())
    label = np.array(sample.column("label").to_pylist(), float)
    pool = None

    def draw(weights, offset, taken, n, sure):
        nonlocal pool
        if pool is None:
            unlabelled = one.where("label is null").select("doc_id", "h")
            pool = scratch.write(texts.mapInArrow(ta.tidy(_features), _FEATURES).join(unlabelled, ["doc_id", "h"]).select("h", "content", "meta"), "pool")
        best = scratch.write(pool.mapInArrow(_surest(weights, offset, taken, n, sure), _SUREST), "surest")
        out = {}
        for v in (0, 1):
            for y in (0, 1):
                top = best.where(F.col("kind") == 2 * v + y).dropDuplicates(["h"]).orderBy(F.desc("q"), "h").limit(n).toArrow()
                out[v, y] = (top.column("h").to_numpy(), _matrix(top.column("content"), N_CONTENT), _matrix(top.column("meta"), N_META))
        scratch.drop(best)
        return out

    model = co_train(_matrix(sample.column("content"), N_CONTENT), _matrix(sample.column("meta"), N_META), label, totals, draw)
    scratch.drop(one, *([] if pool is None else [pool]))
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``classify`` with a model that is fitted already."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))         # each text goes to Python once, in its row
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_scores(model), f"row {kind}, content_score double, meta_score double, score double")


def classify(docs: DataFrame, labels: DataFrame, n_labelled: int = 4000, max_chars: int = 50_000) -> DataFrame:
    """``row, content_score, meta_score, score`` of every row of ``docs``; ``row`` is a struct of all its columns.

    ``docs`` has ``doc_id, text, lang, source, n_chars``; ``labels`` has
    ``doc_id, quality`` (1 good, 0 bad).  ``score`` is the probability of
    good.  The models are fitted on distinct texts: at most ``n_labelled``
    labelled ones of each class and of at most ``max_chars`` characters, chosen
    by a hash of the text (the odds are those of all labels), and the surest of
    all unlabelled ones of any length, scored anew in each round.  Scoring reads every row's
    whole text.  Null labels are ignored, and of several labels of a document
    the mean decides (a half counts as good).  A null text is empty, null
    metadata has a value of its own.  Without labels of both classes all
    scores are the prior.  Repeated rows stay; columns of any name are
    carried in ``row``; an empty table gives none.
    """
    return score(docs, fit(docs, labels, n_labelled, max_chars))
