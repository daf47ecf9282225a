"""Language identification by interpolated Kneser-Ney character language models.

Texts become lower-case letters with one blank for each run of other characters. For each language, n-grams of up to
``ORDER`` symbols give interpolated Kneser-Ney probabilities (counts at the highest order, continuation counts below, one
discount for each order). The grams of all languages stand in one sorted array of hashes per order, with a row of log
probabilities by language; a second one holds the contexts' back-off weights, for grams that no language has seen. A text
goes to the language of the lowest cross-entropy per symbol. It is rejected (``accepted`` false) if that is above what all
but ``REJECT`` of that language's held-back training texts have.

The fit takes a bounded sample: about ``PER_LANG`` labelled texts of each language, of at most ``MOST_BYTES`` bytes, chosen by
a hash of the id. Prediction covers every whole text, row by row, without a shuffle, and sees nothing but the text.

Cases: null text or one without a letter is ``und`` with score 0; rows with null language or id aren't learned from;
without any labelled row all are ``und``; ties go to the language first in code point order; an empty table gives an
empty result; repeated rows are told alike; further columns are kept, but for those named as a result's, which give way.
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
from textloom.llm._store import bounded_batches, carried

ORDER, BITS = 4, 15
PER_LANG, MOST_BYTES, REJECT, SEED = 250, 65536, 0.002, 11
RESULT = ("lang_pred", "score", "cross_entropy", "accepted")
_UND = "und"
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, folded as the module says, each text between blanks; and where each begins (one more at the end)."""
    parts = [f" {(t or '').lower()} " for t in texts]
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    raw = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    plain = np.where(letters()[raw], raw, 32)
    keep = np.ones(len(plain), dtype=bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    keep[at[:-1]] = True
    return plain[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Packed n-grams that end at each position; before the first stand zeros."""
    out = np.zeros(len(ids), dtype=np.uint64)
    for j in range(n - 1, -1, -1):
        out <<= np.uint64(BITS)
        out[j:] |= ids[: len(ids) - j]
    return out


def _low(packed: np.ndarray, n: int) -> np.ndarray:
    return packed & np.uint64((1 << BITS * n) - 1)


@dataclass
class Model:
    langs: list[str]
    vocab: np.ndarray  # sorted code points; a symbol's number is its place + 1, of others 0
    keys: list[np.ndarray]  # by order: sorted hashes of grams
    rows: list[np.ndarray]  # by order: log probabilities, grams x languages
    contexts: list[np.ndarray]
    backs: list[np.ndarray]  # by order: log back-off weights, contexts x languages
    floor: float
    most: np.ndarray  # by language: highest accepted cross-entropy

    def numbers(self, points: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.vocab, points), len(self.vocab) - 1)
        return np.where(self.vocab[place] == points, place + 1, 0).astype(np.uint64)

    def log_probs(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last symbol after the others, by language."""
        out = np.zeros((len(grams), len(self.langs)), dtype=np.float32)
        todo = np.arange(len(grams))
        for n in range(ORDER, 0, -1):
            g = _low(grams[todo], n)
            h = K.mix(g + np.uint64(n))
            place = np.minimum(np.searchsorted(self.keys[n], h), len(self.keys[n]) - 1)
            hit = self.keys[n][place] == h
            out[todo[hit]] += self.rows[n][place[hit]]
            todo, g = todo[~hit], g[~hit]
            if not len(todo):
                break
            c = K.mix((g >> np.uint64(BITS)) + np.uint64(n))
            place = np.minimum(np.searchsorted(self.contexts[n], c), len(self.contexts[n]) - 1)
            hit = self.contexts[n][place] == c
            out[todo[hit]] += self.backs[n][place[hit]]
        out[todo] += self.floor
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol by language, and the number of symbols, 0 for texts without a letter."""
        points, at = symbols(texts)
        ids = self.numbers(points)
        grams = _grams(ids, ORDER)
        first = at[:-1]
        for j in range(ORDER - 1):  # no context from the text before
            own = first + j
            own = own[own < at[1:]]
            grams[own] = _low(grams[own], j + 1)
        total = np.add.reduceat(self.log_probs(grams), first, axis=0)
        n = np.diff(at)
        return -total / n[:, None], np.where(n > 2 - (points[np.maximum(at[1:] - 1, 0)] != 32), n, 0)


def fit(texts: list[str], langs: list[str]) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    fold = np.arange(len(texts)) % 5 == 4
    each = {x: [t for t, y, f in zip(texts, langs, fold, strict=True) if y == x and not f] or [t for t, y in zip(texts, langs, strict=True) if y == x] for x in names}
    folded = {x: symbols(each[x]) for x in names}
    points, count = np.unique(np.concatenate([p for p, _ in folded.values()]), return_counts=True)
    vocab = np.sort(points[np.argsort(-count, kind="stable")[: (1 << BITS) - 2]])
    m = Model(names, vocab, [], [], [], [], 0.0, np.zeros(0))
    size = len(vocab) + 1
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by language and order
    for x in names:
        points, at = folded[x]
        ids = m.numbers(points)
        top = _grams(ids, ORDER)
        for j in range(ORDER - 1):
            own = (at[:-1] + j)[at[:-1] + j < at[1:]]
            top[own] = _low(top[own], j + 1)
        by = [np.unique(top, return_counts=True)]
        for n in range(ORDER - 1, 0, -1):
            by.append(np.unique(_low(by[-1][0], n), return_counts=True))
        counts.append([(np.zeros(0), np.zeros(0)), *by[::-1]])
    m.keys, m.rows, m.contexts, m.backs = ([np.zeros(0)] for _ in range(4))
    lower: tuple[np.ndarray, np.ndarray] | None = None  # packed grams of the order below, their probabilities
    flat = np.zeros(len(names))
    for n in range(1, ORDER + 1):
        grams = np.unique(np.concatenate([c[n][0] for c in counts]))
        ctx = np.unique(grams >> np.uint64(BITS))
        p, back = np.zeros((len(grams), len(names))), np.ones((len(ctx), len(names)))
        below = np.full((len(grams), len(names)), 1 / size) if lower is None else lower[1][np.searchsorted(lower[0], _low(grams, n - 1))]
        where = np.searchsorted(ctx, grams >> np.uint64(BITS))
        for k in range(len(names)):
            g, c = counts[k][n]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            place = np.searchsorted(ctx, g >> np.uint64(BITS))
            total, kinds = np.bincount(place, c, len(ctx)), np.bincount(place, minlength=len(ctx))
            seen = total > 0
            back[seen, k] = d * kinds[seen] / total[seen]
            own = np.zeros(len(grams))
            own[np.searchsorted(grams, g)] = c - d
            p[:, k] = np.divide(own, total[where], out=np.zeros(len(grams)), where=total[where] > 0) + back[where, k] * below[:, k]
            flat[k] = back[0, k] if n == 1 else flat[k]
        for held, values, packed in ((m.keys, m.rows, grams), (m.contexts, m.backs, ctx)):
            h = K.mix(packed + np.uint64(n))
            order = np.argsort(h)
            held.append(h[order])
            values.append(np.log(p if held is m.keys else back)[order].astype(np.float32))
        lower = (grams, p)
    m.floor = float(np.log(1 / size))
    m.most = np.full(len(names), np.inf)
    held = [i for i in np.flatnonzero(fold)]
    if held:
        ce, n = m.entropies([texts[i] for i in held])
        best = ce.argmin(axis=1)
        for k, x in enumerate(names):
            own = ce[(best == k) & (n > 0) & np.array([langs[i] == x for i in held]), k]
            if len(own) >= 20:
                m.most[k] = np.quantile(own, 1 - REJECT) * 1.1
    return m


def trained(docs: DataFrame, learn: str = "pmod(crc32(cast(doc_id as string)), 4) <> 2") -> Model | None:
    """A model from a bounded sample of the rows for which ``learn`` holds."""
    known = docs.where(learn).where("text is not null and lang is not null and doc_id is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, PER_LANG / n))))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    some = known.where(draw < F.try_element_at(share, "lang")).where(F.octet_length("text") <= MOST_BYTES)
    rows = sorted({(r.lang, r.doc_id, r.text) for r in some.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(2 * PER_LANG * len(sizes)).collect()}, key=lambda r: (hash_of(r[1]), r))
    return fit([t for _, _, t in rows], [x for x, _, _ in rows])


def hash_of(i: int) -> int:
    return int(K.mix(np.array([i & (1 << 64) - 1], dtype=np.uint64))[0])


def predicted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1: the posterior, over at most 40 symbols' evidence), ``cross_entropy``, ``accepted``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs, names = carried(docs, text_col)
    docs = docs.select(*(c for c, n in names.items() if n.lower() not in RESULT))
    shared = spark.sparkContext.broadcast(model)  # its size is bounded by the training sample's
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, score, entropy, ok = [], [], [], []
            data, off = K.utf8(batch.column(at))
            for i, j in K.blocks(off):
                texts = batch.column(at).slice(i, j - i).to_pylist()
                if m is None:
                    ce, n = np.zeros((len(texts), 1)), np.zeros(len(texts), dtype=np.int64)
                else:
                    ce, n = m.entropies(texts)
                best = ce.argmin(axis=1)
                low = ce.min(axis=1)
                post = 1 / np.exp(-(ce - low[:, None]) * np.minimum(n, 40)[:, None]).sum(axis=1)
                lang += [m.langs[b] if k else _UND for b, k in zip(best.tolist(), n.tolist(), strict=True)]
                score += np.where(n > 0, post, 0.0).tolist()
                entropy += [float(x) if k else None for x, k in zip(low, n, strict=True)]
                ok += [bool(k and x <= m.most[b]) for x, k, b in zip(low, n, best, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(ok, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "cross_entropy", "accepted"])

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    told = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(RESULT, kinds, strict=True))]))
    return told.toDF(*(names[c] for c in docs.columns), *RESULT)
