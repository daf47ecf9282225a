"""Toxicity scores by a convolutional text classifier, trained in numpy.

Words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased) are hashed to embeddings, to which that of their first
``STEM`` bytes is added; filters of several widths slide over the whole text, and the maximum of each over all places (of
one-word filters also the second largest, so that one mention differs from two) feeds a logistic layer. The first embedding
dimension starts at the log odds in the training rows, the rest at random; everything is then trained by Adam through
the max pool.
Thresholds are calibrated by language on rows that training hasn't seen: a language's own cut and that of all languages are
mixed, the own weighing the more the more rows of both kinds it has (``SHRINK`` of each halve it). Where the rows held back lack one
kind, as in small samples, each fold is scored by a model of the others instead; where even that is impossible, nothing is rejected. The
language is guessed from the text alone, by a
naive Bayes model over the same hashed words, so that neither lang nor source nor id enters a score. The score maps each
language's threshold to ``THRESHOLD``.

The fit takes a bounded sample of labelled rows: at most ``MOST_TOXIC`` and ``MOST_CLEAN`` of at most ``MOST_WORDS`` words, the
first in a seeded order of ids, one row an id (of rows that repeat an id, that of the smallest words). Scoring covers every whole text, row by row, without a shuffle.

Cases: null or empty text, or one without words, is scored as one word of padding; null labels and null ids aren't
learned from; without labels of both kinds the score is 0 for all; repeated rows score alike; further columns, whatever
their names, are kept, but for those named as a result's, which give way (in the filter all are kept).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import _kernels as K
from textloom.llm._store import bounded_batches, carried, fresh

THRESHOLD = 0.3
MOST_TOXIC, MOST_CLEAN, MOST_WORDS = 1500, 2500, 5000
BITS, STEM, DIM, FILTERS, WIDTHS = 16, 4, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.01, 5
FOLDS = 4
#: Rows of the rarer kind with which a language's own threshold weighs as much as that of all.
SHRINK = 10
#: Weight of specificity in the choice of thresholds, as clean documents are many times the toxic ones.
CLEAN = 4

_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_ids(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In blocks of rows: bucket numbers of all words and of their stems, and each row's first and last place (padding, which
    stands for the word of a row without any)."""
    data, off = K.utf8(column)
    pad = 1 << BITS
    for i, j in K.blocks(off):
        part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
        plain = np.where(_BREAK[part], np.uint8(32), part)
        starts, ends, first = K.word_spans(plain, own)
        both = [K.word_hashes(plain, starts, x) for x in (ends, np.minimum(ends, starts + STEM))]
        ids = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in (both[0], K.mix(both[1] + np.uint64(1)))], axis=1)
        n = np.maximum(np.diff(first), 1)
        at = np.concatenate(([0], np.cumsum(n + 3)))  # three of padding: no filter reaches into the next row
        out = np.full((at[-1], 2), pad, dtype=np.int32)
        row = np.repeat(np.arange(j - i), np.diff(first))
        out[at[row] + np.arange(len(ids)) - first[row]] = ids
        yield out, np.stack([at[:-1], at[:-1] + n + 1], axis=1)


@dataclass
class Model:
    embed: np.ndarray  # words + 1, DIM
    filters: list[np.ndarray]  # for each width: width, DIM, FILTERS
    shift: np.ndarray  # all filters
    out: np.ndarray
    bias: float
    language: np.ndarray  # words + 1, languages: log probabilities
    thresholds: np.ndarray  # by language
    slope: float

    def tables(self) -> list[np.ndarray]:
        """What each word adds to the filters that it stands under, at each offset."""
        return [np.concatenate([self.embed @ w[j] for w in self.filters if len(w) > j], axis=1) for j in range(max(WIDTHS))]

    def responses(self, ids: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        all_ = tables[0][ids[:, 0]] + tables[0][ids[:, 1]]
        for j in range(1, len(tables)):
            own = all_[:-j, -tables[j].shape[1] :]
            own += tables[j][ids[j:, 0]]
            own += tables[j][ids[j:, 1]]
        return all_

    def logits(self, ids: np.ndarray, rows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        r, cut = self.responses(ids, tables), rows.ravel()
        cut = cut[:-1] if cut[-1] == len(r) else cut
        most = np.maximum.reduceat(r, cut, axis=0)[::2]
        one = r[:, :FILTERS]
        n = np.diff(np.append(rows[:, 0], len(r)))
        top = one == np.repeat(most[:, :FILTERS], n, axis=0)
        ties = np.add.reduceat(top, cut, axis=0, dtype=np.int32)[::2]
        one[top] = -np.inf
        second = np.where(ties > 1, most[:, :FILTERS], np.maximum.reduceat(one, cut, axis=0)[::2])
        return np.maximum(np.concatenate([most, second], axis=1) + self.shift, 0) @ self.out + self.bias

    def languages(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.language.shape[1] < 2:
            return np.zeros(len(rows), dtype=np.int64)
        return np.add.reduceat(self.language[ids[:, 0]], np.minimum(rows, len(ids) - 1).ravel(), axis=0)[::2].argmax(axis=1)

    def scores(self, z: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.thresholds[lang]) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def train(docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None]) -> Model:
    """A model of the rows outside one fold, calibrated on that fold, or where it lacks one kind, on all folds."""
    fold = np.arange(len(docs)) % FOLDS
    m = learned(docs, labels, langs, fold == FOLDS - 1)
    held = np.flatnonzero(fold == FOLDS - 1)
    z, lang = judged(m, [docs[i] for i in held])
    if len(np.unique(labels[held])) < 2:
        z, lang, held = np.zeros(len(docs)), judged(m, docs)[1], np.arange(len(docs))
        scored_ = np.zeros(len(docs), dtype=bool)
        for f in range(FOLDS):
            own = np.flatnonzero(fold == f)
            if len(own) and len(np.unique(labels[fold != f])) == 2:
                z[own] = judged(learned(docs, labels, langs, fold == f), [docs[i] for i in own])[0]
                scored_[own] = True
        z, lang, held = z[scored_], lang[scored_], held[scored_]
    calibrate(m, z, labels[held], lang)
    return m


def learned(docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None], fold: np.ndarray) -> Model:
    """A model of the rows that ``fold`` doesn't hold back, without thresholds; languages are learned from all rows."""
    rng, words = np.random.Generator(np.random.PCG64(SEED)), 1 << BITS
    names = sorted({x for x in langs if x is not None}) or [""]
    counts, by_lang = np.full((2, words), 0.5), np.full((words + 1, len(names)), 0.1)
    for d, y, lang, held in zip(docs, labels, langs, fold, strict=True):
        if not held:
            counts[y][np.unique(d[d < words])] += 1  # not the padding of empty texts
        if lang in names:
            np.add.at(by_lang[:, names.index(lang)], d[:, 0], 1)
    n = np.bincount(labels[~fold], minlength=2) + 1
    odds = np.log(counts[1] / n[1]) - np.log(counts[0] / n[0])
    seen = counts.sum(axis=0)
    odds *= seen / (seen + 3)
    embed = rng.normal(0, 0.1, (words + 1, DIM)).astype(np.float32)
    embed[:-1, 0] = odds / 2
    embed[-1] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0, 0] = 1 / len(w)
        w[:, 0, 1] = -1 / len(w)
    language = np.log(by_lang / by_lang.sum(axis=0))
    language[-1] = 0
    total = FILTERS * len(WIDTHS)
    m = Model(embed, filters, np.zeros(total + FILTERS, np.float32), rng.normal(0, 0.1, total + FILTERS).astype(np.float32), 0.0, language.astype(np.float32), np.zeros(len(names)), 1.0)
    m.out[::FILTERS] = 1.0
    params = [m.embed, *m.filters, m.shift, m.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    learn = np.flatnonzero(~fold)
    weight = np.array([len(learn) / 2 / max(1, (labels[learn] == y).sum()) for y in (0, 1)])
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(learn)
        for lo in range(0, len(order), BATCH):
            step += 1
            pick = order[lo : lo + BATCH]
            tables, grads, bias = m.tables(), [np.zeros_like(p) for p in params], 0.0
            for i in pick:
                ids = np.concatenate([docs[i], np.full((3, 2), words, dtype=np.int32)])
                r = m.responses(ids, tables)[: len(docs[i]) + 1]
                at = r.argmax(axis=0)
                one = r[:, :FILTERS].copy()
                one[at[:FILTERS], np.arange(FILTERS)] = -np.inf
                next_ = one.argmax(axis=0)
                pooled = np.concatenate([r[at, np.arange(total)], one[next_, np.arange(FILTERS)]]) + m.shift
                on = np.maximum(pooled, 0)
                g = float(1 / (1 + np.exp(-np.clip(on @ m.out + m.bias, -30, 30))) - labels[i]) * weight[labels[i]] / len(pick)
                grads[-1] += g * on
                bias += g
                back = g * m.out * (pooled > 0)
                grads[-2] += back
                for f, place in [*((f, at[f * FILTERS : (f + 1) * FILTERS]) for f in range(len(WIDTHS))), (-1, next_)]:
                    w, gw = m.filters[max(f, 0)], grads[1 + max(f, 0)]
                    own = slice(f * FILTERS, (f + 1) * FILTERS) if f >= 0 else slice(total, None)
                    for j in range(len(w)):
                        for word in (ids[place + j, 0], ids[place + j, 1]):
                            gw[j] += m.embed[word].T * back[own]
                            np.add.at(grads[0], word, back[own, None] * w[j].T)
            grads[0][-1] = 0
            for p, g, (a, b) in zip(params, grads, moments, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
            m.bias -= RATE * bias
    return m


def judged(m: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Logits and languages."""
    tables, padding = m.tables(), np.full((3, 2), 1 << BITS, dtype=np.int32)
    z, lang = np.zeros(len(docs)), np.zeros(len(docs), dtype=np.int64)
    for k, d in enumerate(docs):
        ids, rows = np.concatenate([d, padding]), np.array([[0, len(d) + 1]])
        z[k], lang[k] = m.logits(ids, rows, tables)[0], m.languages(ids, rows)[0]
    return z, lang


def calibrate(m: Model, z: np.ndarray, y: np.ndarray, lang: np.ndarray) -> None:
    """Sets thresholds and slope by rows that the model (or one like it) hasn't seen; without both kinds nothing is above them."""
    every = threshold(z, y)
    if every is None:
        m.thresholds = np.full(m.language.shape[1], np.inf)
        return
    for k in range(m.language.shape[1]):
        own = threshold(z[lang == k], y[lang == k])
        n = np.bincount(y[lang == k], minlength=2).min()
        m.thresholds[k] = every if own is None else (n * own + SHRINK * every) / (n + SHRINK)
    m.slope = 2.0 / max(float(np.std(z)), 1e-3)


def threshold(z: np.ndarray, y: np.ndarray) -> float | None:
    """The cut with the best sum of recall and ``CLEAN`` times specificity, midway in the gap that it falls in; None without both kinds."""
    if not len(z) or y.min() == y.max():
        return None
    order = np.argsort(z, kind="stable")
    zs, ys = z[order], y[order]
    below = np.concatenate(([0], np.cumsum(ys == 0))) / (ys == 0).sum()
    above = 1 - np.concatenate(([0], np.cumsum(ys == 1))) / (ys == 1).sum()
    edges = np.concatenate(([zs[0] - 1], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 1]))
    ok = np.concatenate(([True], zs[1:] > zs[:-1], [True]))
    return float(edges[np.flatnonzero(ok)[(CLEAN * below + above)[ok].argmax()]])


def fit(docs: DataFrame, labels: DataFrame, learn: str = "pmod(crc32(cast(doc_id as string)), 4) <> 2", label_col: str = "toxic") -> Model | None:
    """A model from a bounded sample of the labelled rows for which ``learn`` holds; None without rows of both kinds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(learn).where(f"doc_id is not null and {label_col} in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    picked = known.where("y = 1").orderBy(order, "doc_id").limit(MOST_TOXIC).union(known.where("y = 0").orderBy(order, "doc_id").limit(MOST_CLEAN))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).join(F.broadcast(picked), "doc_id")  # MOST_TOXIC + MOST_CLEAN rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [ids[a : min(b - 1, a + MOST_WORDS + 1)].tobytes() for ids, rows in word_ids(batch.column("text")) for a, b in rows]
            short = pa.array([len(x) <= 8 * MOST_WORDS for x in held], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("lang"), pa.array(held, pa.binary())], ["doc_id", "y", "lang", "ids"]).filter(short)

    told = rows.mapInArrow(run, "doc_id long, y int, lang string, ids binary")
    told = told.groupBy("doc_id").agg(F.min(F.struct("y", "ids", "lang")).alias("r")).select("doc_id", "r.*")  # one row an id
    got = sorted(told.collect(), key=lambda r: (r.y, r.doc_id))
    labels_ = np.array([r.y for r in got], dtype=np.int64)
    if not len(got) or labels_.min() == labels_.max():
        return None
    return train([np.frombuffer(r.ids, dtype=np.int32).reshape(-1, 2) for r in got], labels_, [r.lang for r in got])


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; a column of ``docs`` with one of these names gives way."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs, names = carried(docs, text_col)
    docs = docs.select(*(c for c, n in names.items() if n.lower() not in (score_col.lower(), predicted_col.lower())))
    columns = [*(names[c] for c in docs.columns), score_col, predicted_col]
    if model is None:
        return docs.select("*", F.lit(0.0), F.lit(0)).toDF(*columns)
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by BITS, DIM and FILTERS, and by the number of languages
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tables = m.tables()
        for batch in batches:
            parts = [m.scores(m.logits(ids, rows, tables), m.languages(ids, rows)) for ids, rows in word_ids(batch.column(at))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score.astype(np.float64)), pa.array((score >= THRESHOLD).astype(np.int32))], [*batch.schema.names, score_col, predicted_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])
    return docs.mapInArrow(run, schema).toDF(*columns)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier, fitted on them and ``labels``, predicts to be toxic."""
    docs, names = carried(docs, "doc_id", "text", "lang")
    score, predicted = fresh(docs.columns, "score", "predicted")
    told = scored(docs, fit(docs, labels), "text", score, predicted)
    return told.where(F.col(predicted) == 0).select(*names).toDF(*names.values())
