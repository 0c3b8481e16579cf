"""Language identification by prediction by partial matching.

For each language a byte context tree of up to three bytes of context is counted on a
bounded sample of labelled rows.  The counts are then frozen into one table: for every
kept context and next byte the exact code length in bits, escapes included (a symbol new
to a context costs the escape and its code length in the next shorter context, with the
symbols seen already excluded).  A text costs the sum of its bytes' code lengths and the
code length of the language itself; the cheapest language wins.

Bytes are folded before they are coded: A-Z to a-z, digits to 0, white space and control
bytes to a blank; bytes never met in the sample share one class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pedigraph.llm.common import enter, pick, text_slices, trimmed

DOCS_PER_LANGUAGE = 2000
MAX_CELLS = 1 << 23
MIN_CONTEXT = 4
MAX_LANGUAGES = 1000
FITTING = 0.25
_WINDOW = 1 << 19
_PAD = b"   "
_LETTERS = re.compile(r"[^\W\d_]+")


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[48:58] = 48
    table[:33] = 32
    table[127] = 32
    return table


_FOLD = _fold()


@dataclass(frozen=True)
class Model:
    """Frozen statistics: byte classes, context rows, and code lengths [row * classes + class, language]."""

    languages: tuple[str, ...]
    classes: np.ndarray  # byte -> class, 0 for bytes outside the sample
    rows: np.ndarray  # class of the three bytes before, oldest first -> row
    bits: np.ndarray
    prior: np.ndarray  # code length of each language
    uniform: float  # bits of a byte without any model

    @property
    def size(self) -> int:
        return int(self.classes.max()) + 1


def training_rows(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> tuple[DataFrame, dict[str, int]]:
    """(lang, text) of a bounded sample, and the counts of labelled rows outside the held-out fold.

    A row is drawn by a hash of its id, at a rate of ``per_language`` over its language's
    count, so the sample's expected size is that many rows per language at any corpus size.
    """
    usable = pick(docs, "doc_id", "lang", "text").where("lang is not null and text is not null and pmod(crc32(cast(doc_id as string)), 4) <> 2")
    counts = dict(usable.groupBy("lang").agg(F.count(F.lit(1))).limit(MAX_LANGUAGES + 1).collect())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language")), 11) / F.lit(float(1 << 53))
    rate = F.lit(None).cast("double")
    for lang, n in sorted(counts.items()):
        rate = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(rate)
    return usable.where(draw < rate).select("lang", "text"), counts


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Four-byte windows (three bytes of context and the next) of folded texts, counted per language."""
    enter("langid")
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
            for text in texts:
                for part in _slices(text.encode("utf-8", "surrogatepass")):
                    b = _FOLD[np.frombuffer(part, np.uint8)].astype(np.int64)
                    g, n = np.unique(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:], return_counts=True)
                    grams, counts = np.concatenate((grams, g)), np.concatenate((counts, n))
                if len(grams) > 1 << 20:
                    grams, counts = _merge(grams, counts)
            grams, counts = _merge(grams, counts)
            yield pd.DataFrame({"lang": lang, "gram": grams, "n": counts})
    trimmed()


def _merge(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g, at = np.unique(grams, return_inverse=True)
    return g, np.bincount(at, weights=counts, minlength=len(g)).astype(np.int64)


def _slices(data: bytes) -> Iterator[bytes]:
    """The padded bytes of a text in windows that overlap by the context."""
    data = _PAD + data
    for i in range(3, len(data), _WINDOW):
        yield data[i - 3:i + _WINDOW]


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): summed window counts of the sample."""
    return sample.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _predict(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities per context row from its counts and those of its next shorter context."""
    total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
    seen = n > 0
    left = 1.0 - np.where(seen, shorter, 0.0).sum(axis=1, keepdims=True)
    full = kinds == n.shape[1]
    escape = np.where(full, 0.0, kinds / np.maximum(total + kinds, 1))
    own = n / np.maximum(np.where(full, total, total + kinds), 1)
    return np.where(total == 0, shorter, np.where(seen, own, escape * shorter / np.maximum(left, 1e-12)))


def freeze(counts: pd.DataFrame, documents: dict[str, int], max_cells: int = MAX_CELLS) -> Model:
    """The code-length table of counted windows (lang, gram, n).

    Rows are all contexts of one byte and the heaviest of two and three bytes, as many as
    ``max_cells`` code lengths allow for the byte classes and languages met; other contexts
    use the row of their longest kept suffix.
    """
    languages = tuple(sorted(documents))
    grams, n = counts["gram"].to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=float)
    lang = counts["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy(dtype=float)
    met = np.unique(np.concatenate([grams >> s & 255 for s in (24, 16, 8, 0)] + [np.array([32])]))
    classes = np.zeros(256, dtype=np.int64)
    classes[met] = np.arange(1, len(met) + 1)
    a = len(met) + 1
    c = [classes[grams >> s & 255] for s in (24, 16, 8, 0)]
    two, three = c[1] * a + c[2], (c[0] * a + c[1]) * a + c[2]
    weight = np.concatenate([np.bincount(two, weights=n, minlength=a * a), np.bincount(three, weights=n, minlength=a ** 3)])
    kept = np.argsort(-weight, kind="stable")[: max(0, max_cells // (a * max(1, len(languages))) - a)]
    kept = np.sort(kept[weight[kept] >= MIN_CONTEXT])
    kept2, kept3 = kept[kept < a * a], kept[kept >= a * a] - a * a
    row2 = np.tile(np.arange(a), a)  # the row of a two-byte context: its own, or that of its last byte
    row2[kept2] = a + np.arange(len(kept2))
    rows = np.tile(row2, a)
    own3 = np.full(a ** 3, -1)
    own3[kept3] = np.arange(len(kept3))
    rows[kept3] = a + len(kept2) + np.arange(len(kept3))
    bits = np.empty((a + len(kept), a, len(languages)), dtype=np.float32)
    for i in range(len(languages)):
        mine = lang == i
        m, sym = n[mine], c[3][mine]

        def table(at: np.ndarray, count: int) -> np.ndarray:
            ok = at >= 0
            return np.bincount(at[ok] * a + sym[ok], weights=m[ok], minlength=count * a).reshape(count, a)

        p = _predict(table(np.zeros(len(m), np.int64), 1), np.full((1, a), 1.0 / a))
        p1 = _predict(table(c[2][mine], a), np.repeat(p, a, axis=0))
        p2 = _predict(table(two[mine], a * a), np.tile(p1, (a, 1)))
        p3 = _predict(table(own3[three[mine]], len(kept3)), p2[kept3 % (a * a)])
        bits[:, :, i] = -np.log2(np.concatenate([p1, p2[kept2], p3]))
    seen = np.array([documents[v] for v in languages], dtype=float)
    return Model(languages, classes[_FOLD], rows.astype(np.int32), bits.reshape((a + len(kept)) * a, len(languages)),
                 -np.log2(seen / max(1.0, seen.sum())), float(np.log2(a)))


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, max_cells: int = MAX_CELLS) -> Model:
    """Frozen statistics of the labelled rows outside the held-out fold.

    The sample is bounded by ``per_language`` rows per language (expected), the table by
    ``max_cells``; without labelled rows the model knows no language.
    """
    sample, counts = training_rows(docs, per_language)
    return freeze(gram_counts(sample).toPandas(), counts, max_cells)


def code_lengths(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty text and language: its bits, without the language's own code length, and
    how many of its bytes are coded shorter than without a model."""
    a, total = model.size, np.zeros((2 * len(texts), len(model.languages)))
    short = np.zeros_like(total)
    if not texts:
        return total, short
    data = np.frombuffer(_PAD + _PAD.join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = 3 + np.concatenate(([0], np.cumsum(sizes[:-1] + 3)))
    edges = np.stack((starts, starts + sizes), axis=1).ravel()  # text, pad, text, pad ...
    for lo in range(3, len(data), _WINDOW):
        hi = min(len(data), lo + _WINDOW)
        c = model.classes[data[lo - 3:hi]]
        at = model.rows[(c[:-3] * a + c[1:-2]) * a + c[2:-1]] * np.int64(a) + c[3:]
        first, last = np.searchsorted(edges, lo, side="right") - 1, np.searchsorted(edges, hi, side="left")
        cut = np.maximum(edges[first:last] - lo, 0)
        for i in range(len(model.languages)):
            bits = model.bits[:, i][at].astype(np.float64)
            total[first:last, i] += np.add.reduceat(bits, cut)
            short[first:last, i] += np.add.reduceat(bits < model.uniform, cut, dtype=np.int64)
    return total[::2], short[::2]


def _has_letter(text: str) -> bool:
    return any(any(map(str.isalpha, m.group())) for m in _LETTERS.finditer(text))


def classify(model: Model, texts: list[str | None]) -> pd.DataFrame:
    """Language, score, bits per byte and whether no language fits, for each text.

    ``und`` with score 0 for null texts and texts without a letter; the score is the
    posterior of the winner; a tie goes to the first language by name.  A text is rejected
    when the best language codes under a quarter of its bytes shorter than no model would,
    so one secret or table in a short text does not cost it its place.
    """
    known = [i for i, t in enumerate(texts) if t and model.languages and _has_letter(t)]
    lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
    per_byte, rejected = np.full(len(texts), np.nan), np.ones(len(texts), dtype=bool)
    if known:
        data = [texts[i].encode("utf-8", "surrogatepass") for i in known]
        bits, short = code_lengths(model, data)
        cost = bits + model.prior
        best = cost.argmin(axis=1)
        lang[known] = np.array(model.languages, dtype=object)[best]
        each = np.arange(len(known))
        score[known] = 1.0 / np.exp2(np.maximum(cost[each, best][:, None] - cost, -1000.0)).sum(axis=1)
        size = np.array([len(d) for d in data])
        per_byte[known] = bits[each, best] / size
        rejected[known] = short[each, best] < FITTING * size
    return pd.DataFrame({"lang_pred": lang, "score": score, "bits_per_byte": per_byte, "rejected": rejected})


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct column (lang_pred, score, bits_per_byte, rejected); only the text is read."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, bits_per_byte double, rejected boolean")
    def run(texts: pa.Array) -> pa.Array:
        enter("langid")
        found = pd.concat([classify(shared.value, part) for part in text_slices(texts)] or [classify(shared.value, [])])
        trimmed()
        return pa.StructArray.from_arrays([pa.array(found[c], k) for c, k in zip(found.columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))],
                                          names=list(found.columns))

    return run(text)


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned outside the held-out fold."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    model = train(docs)
    held = F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2"), F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), predict(spark, model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")
