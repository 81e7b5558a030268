"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling; numpy only.

A word's embedding is the sum of four rows: two hashes of the word and one each of its first four and five letters. The
first dimension starts as the shrunken log-odds of the hashed feature in the labelled sample. Filters slide over the whole
text, each keeps its largest response, and a logistic layer joins them. Neither language, source nor id reaches the score;
the language picks only the threshold with which ``reject`` decides.

The model is fitted on a bounded, deterministic sample of labelled rows (``SAMPLE`` a class, texts up to ``SAMPLE_CHARS``);
every document is scored, over its whole text, at every size. Null text is empty text, which gets the score of no evidence.
Without labels of both classes every score is 0. Repeated rows are scored each; other columns are kept by ``score``, except
a column named score, which it replaces. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import slices
from .tables import first_hashes, free_name, map_parts, remembered

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
SAMPLE, SAMPLE_CHARS = 3000, 40_000
WORD = re.compile(r"\w+")
KEEP_WORDS = 400_000


class WordFeatures:
    """The four hashed features of each word, hashed once while remembered."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.table = np.zeros((4096, 4), np.int32)

    def rows(self, words: list[str]) -> np.ndarray:
        """(len(words), 4) rows of the embedding tables, each table after the other."""
        if len(self.at) > KEEP_WORDS:
            self.at = {}
        for w in set(words).difference(self.at):
            i = self.at[w] = len(self.at)
            if i == len(self.table):
                self.table = np.resize(self.table, (2 * i, 4))
            b = w.encode()
            h = zlib.crc32(b)
            self.table[i] = h % BUCKETS, BUCKETS + (h >> 16 ^ zlib.adler32(b) * 2654435761) % BUCKETS, 2 * BUCKETS + zlib.crc32(w[:4].encode(), 4) % BUCKETS, 3 * BUCKETS + zlib.crc32(w[:5].encode(), 5) % BUCKETS
        return self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


@dataclass
class Model:
    embeddings: np.ndarray  # (4 * BUCKETS, DIM)
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.7
    fitted: bool = True


PAD = max(WIDTHS) - 1


def responses(m: Model, features: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Embeddings of the positions and what each filter makes of the window that begins there. A window that begins at an empty
    position is empty, whatever document follows."""
    x = m.embeddings[features].sum(axis=1) if len(features) else np.zeros((0, DIM), np.float32)
    made = [sum(np.pad(x[o:], ((0, o), (0, 0))) @ m.filters[k][o] for o in range(w)) + m.shifts[k] for k, w in enumerate(WIDTHS)]
    for a, shift in zip(made, m.shifts):
        a[features[:, 0] < 0] = shift
    return x, made


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features of documents one after the other, PAD empty positions after each (row -1 of the tables is zero)."""
    gap = np.full((PAD, 4), -1, np.int64)
    return np.concatenate([y for x in docs for y in (x, gap)]), np.cumsum([0, *(len(x) + PAD for x in docs)])[:-1]


def pooled(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    features, starts = laid_out(docs)
    _, made = responses(m, features)
    return np.maximum(np.concatenate([np.maximum.reduceat(a, starts, axis=0) for a in made], axis=1), 0)


def probability(m: Model, top: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(top @ m.out + m.bias, -30, 30).astype(np.float64)))


def split_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def fit(texts: list[str], toxic: np.ndarray, langs: list[str | None], seed: int = 11, epochs: int = 8, rate: float = 0.02) -> Model:
    """The classifier, trained on four fifths of the texts; the rest calibrates the thresholds."""
    rng = np.random.default_rng(seed)
    words = WordFeatures()
    docs = [words.rows(split_words(t)) for t in texts]
    y = np.asarray(toxic, np.float32)
    aside = np.arange(len(y)) % 5 == 4
    model = Model(np.zeros((4 * BUCKETS + 1, DIM), np.float32), [], [], np.full(FILTERS * len(WIDTHS), 0.5, np.float32), -3.0, fitted=0 < y[~aside].sum() < (~aside).sum())
    for w in WIDTHS:
        f = rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32)
        f[:, 0, :] += 1.0 / w
        model.filters.append(f)
        model.shifts.append(np.zeros(FILTERS, np.float32))
    if not model.fitted:
        return model
    train = np.flatnonzero(~aside)
    share, strength = y[train].mean(), 4.0
    seen = [np.zeros(4 * BUCKETS + 1, np.float32) for _ in range(2)]
    for i in train:
        seen[int(y[i])][np.unique(docs[i])] += 1
    weight = np.log((seen[1] + strength * share) / (share * len(train) + strength * share)) - np.log((seen[0] + strength * (1 - share)) / ((1 - share) * len(train) + strength * (1 - share)))
    model.embeddings[:-1] = rng.normal(0, 0.02, (4 * BUCKETS, DIM))
    model.embeddings[:-1, 0] += weight[:-1] / 4
    dense = [*model.filters, *model.shifts, model.out]
    first, second, used, step = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense], np.full(4 * BUCKETS + 1, 1e-3, np.float32), 0
    balance = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 48)):
            step += 1
            features, starts = laid_out([docs[i] for i in batch])
            x, made = responses(model, features)
            top = np.concatenate([np.maximum.reduceat(a, starts, axis=0) for a in made], axis=1)
            act = np.maximum(top, 0)
            error = ((probability(model, act) - y[batch]) * balance[batch] / len(batch)).astype(np.float32)
            back = error[:, None] * model.out * (top > 0)
            grads, into = [np.zeros_like(p) for p in dense], np.zeros_like(x)
            doc_of = np.repeat(np.arange(len(batch)), np.diff([*starts, len(features)]))
            for k, w in enumerate(WIDTHS):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                at, col = np.nonzero(made[k] == top[doc_of, part])
                _, one = np.unique(doc_of[at] * FILTERS + col, return_index=True)
                at, col = at[one], col[one]
                g = back[doc_of[at], k * FILTERS + col]
                np.add.at(grads[len(WIDTHS) + k], col, g)
                for o in range(w):
                    inside = (at + o < len(x)) & (features[at, 0] >= 0)
                    a, c, h = at[inside] + o, col[inside], g[inside]
                    np.add.at(grads[k][o].T, c, h[:, None] * x[a])
                    np.add.at(into, a, h[:, None] * model.filters[k][o].T[c])
            grads[-1] = act.T @ error
            model.bias -= rate * float(error.sum())
            for p, g, m1, m2 in zip(dense, grads, first, second):
                g += 1e-4 * p
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
            hit = np.flatnonzero(np.abs(into).sum(axis=1))
            for table in range(4):
                rows = features[hit, table]
                used_here = (into[hit] ** 2).mean(axis=1)
                np.add.at(used, rows, used_here)
                np.add.at(model.embeddings, rows, -rate * into[hit] / np.sqrt(used[rows])[:, None])
            model.embeddings[-1] = 0
    calibrate(model, [docs[i] for i in np.flatnonzero(aside)], y[aside], [langs[i] for i in np.flatnonzero(aside)])
    return model


def best_threshold(score: np.ndarray, y: np.ndarray, least: float, most: float) -> float:
    """The middle of the widest gap among the thresholds with the fewest errors, within bounds."""
    edges = np.unique(np.concatenate(([least, most], score[(score > least) & (score < most)])))
    middles = (edges[1:] + edges[:-1]) / 2
    wrong = [int(((score >= t) != (y > 0)).sum()) for t in middles]
    best = [(b - a, t) for a, b, t, w in zip(edges[:-1], edges[1:], middles, wrong) if w == min(wrong)]
    return float(max(best)[1])


def calibrate(m: Model, docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], enough: int = 5) -> None:
    """Thresholds by language from rows that the fit has not seen; languages with too few keep the common one."""
    score = np.concatenate([probability(m, pooled(m, docs[i : i + 64])) for i in range(0, len(docs), 64)]) if docs else np.zeros(0)
    if 0 < y.sum() < len(y):
        m.threshold = best_threshold(score, y, 0.4, 0.9)
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        if min(y[own].sum(), (1 - y[own]).sum()) >= enough:
            m.thresholds[lang] = best_threshold(score[own], y[own], 0.4, 0.9)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows of each class, the first in the order of a hash of their ids, one text an id."""
    named = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    ranked = named.withColumn("h", F.xxhash64(id_col))
    counts = dict(map(tuple, named.groupBy("y").agg(F.count("*")).collect()))
    picked = [r for y in (0, 1) for r in first_hashes(ranked.where(F.col("y") == y), "h", sample, counts.get(y, 0)).orderBy("h", id_col).limit(sample).collect()]
    spark = docs.sparkSession
    few = spark.createDataFrame([(r[id_col], int(r["y"]), r["h"]) for r in picked], f"{id_col} {labels.schema[id_col].dataType.simpleString()}, y int, h long")
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.where(F.length(text_col) <= SAMPLE_CHARS).select(id_col, F.col(text_col).alias("text"), lang.alias("lang"))
    # an id may be repeated very often, and one of its texts is enough
    one = texts.join(F.broadcast(few), id_col).groupBy(id_col).agg(F.min(F.struct("h", "text", "lang", "y")).alias("r")).select("r.*")
    rows = sorted(one.collect(), key=lambda r: (r["h"], r["text"]))
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows]), [r["lang"] for r in rows])


def worker_words() -> WordFeatures:
    return remembered("words of toxicity", WordFeatures)


def score_texts(m: Model, texts: list[str], words: WordFeatures) -> np.ndarray:
    """Scores of whole texts. Parts of a long text overlap by the widest filter less one word, and share one maximum."""
    top = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        if waiting:
            np.maximum.at(top, [i for i, _ in waiting], pooled(m, [x for _, x in waiting]))
            waiting.clear()

    for i, text in enumerate(texts):
        tail = np.zeros((0, 4), np.int64)
        for part in slices(text):
            rows = np.concatenate((tail, words.rows(split_words(part)).astype(np.int64)))
            tail = rows[-PAD:]
            waiting.append((i, rows))
            held += len(rows)
            if held > 50_000:
                flush()
                held = 0
    flush()
    return probability(m, top)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds the score, 0 to 1; a column of its name is replaced, all others are kept."""
    kept = [c for c in docs.columns if c != out_col]
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col), F.lit("")).alias(free_name("__text", docs)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, words = shared.value, worker_words()

        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(b.num_columns - 1).to_pylist()
            made = score_texts(m, texts, words) if m.fitted else np.zeros(len(texts))
            return pa.record_batch([*b.columns[:-1], pa.array(made, pa.float64())], [*kept, out_col])

        return part

    return map_parts(base, make, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept] + [f"`{out_col}` double"]))


def toxic(model: Model, score_col: str = "score", lang_col: str = "lang") -> Column:
    """The decision with the language's threshold; other languages and null have the common one."""
    limit = F.lit(model.threshold)
    for lang, t in sorted(model.thresholds.items()):
        limit = F.when(F.col(lang_col) == lang, F.lit(t)).otherwise(limit)
    return F.col(score_col) >= limit


def reject(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that are not toxic (a score at the threshold is), with their own columns."""
    out = free_name("__score", docs)
    return score(docs, model, text_col, out).where(~toxic(model, out, lang_col)).select(*[F.col(f"`{c}`") for c in docs.columns])
