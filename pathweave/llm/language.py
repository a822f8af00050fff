"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code point. An n-gram
is bound from its letters: the vector of each is permuted (rotated) by its distance from the
end and the rotated vectors are multiplied. A text is the bundle (sum) of its n-grams, a
language the bundle of its labelled texts at unit length, and a text is given the language
with the largest cosine.

Texts are lower-cased; a run of other characters than letters is one blank, and so are both
ends. As n-grams repeat, they are counted first and their vectors are weighed by the counts.

The prototypes are fitted on a bounded sample of labelled rows (about ``per_language`` rows of each
language, chosen by a hash of the id): a thousand numbers per language, which are sent to all
tasks. More than ``max_languages`` languages aren't learned, but those with the most rows. Prediction reads every text whole.

Cases: null text or text without letters is ``und`` with score 0; ties go to the language
first by code point; without labelled rows everything is ``und``; rows are predicted one by
one, so repeated rows and empty tables need no care; only the named columns are read, and a
column ``prediction`` that is there already gives way to the result. The score is the cosine,
at least 0.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
GRAM = 3
#: Code points handled in one go; a longer text is a chunk of its own.
CHUNK = 300_000
#: n-grams whose vectors are kept for a chunk.
KEPT_GRAMS = 16_384


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=8192)
def letter_vector(code: int, seed: int) -> np.ndarray:
    return (np.random.default_rng([seed, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def _grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the chunk (code points), the n-gram of each place as a number in that alphabet, and its text."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f"\0{t}\0" for t in lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(lowered)), [len(t) + 2 for t in lowered])
    symbol = np.where(_letters()[codes], codes, 0)
    keep = np.ones(len(symbol), dtype=bool)
    keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0) | (owner[1:] != owner[:-1])
    symbol, owner = symbol[keep], owner[keep]
    seen = np.zeros(0x110000, dtype=bool)
    seen[symbol] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(0x110000, dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    s = place[symbol]
    n = max(0, len(s) - GRAM + 1)
    number = np.zeros(n, dtype=np.int64)
    for i in range(GRAM):
        number = number * len(alphabet) + s[i : n + i]
    inside = owner[:n] == owner[GRAM - 1 :] if n else np.zeros(0, dtype=bool)
    return alphabet, number[inside], owner[:n][inside]


def _bound(alphabet: np.ndarray, numbers: np.ndarray, seed: int) -> np.ndarray:
    """The vectors of n-grams given as numbers in the alphabet."""
    letters = np.stack([letter_vector(int(c), seed) for c in alphabet])
    out = None
    for i in range(GRAM):  # the last letter isn't rotated
        rows = np.roll(letters, i, axis=1)[numbers // len(alphabet) ** i % len(alphabet)]
        out = rows if out is None else out * rows
    return out


def bundles(texts: Sequence[str], seed: int) -> np.ndarray:
    """A row per text: the sum of the vectors of its n-grams (zero without letters)."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    alphabet, number, owner = _grams(texts)
    if len(alphabet) ** GRAM <= 1 << 22:
        seen = np.zeros(len(alphabet) ** GRAM, dtype=bool)
        seen[number] = True
        distinct = np.flatnonzero(seen)
        place = np.zeros(len(seen), dtype=np.int32)
        place[distinct] = np.arange(len(distinct))
        index = place[number]
    else:
        distinct, index = np.unique(number, return_inverse=True)
    kept = _bound(alphabet, distinct, seed) if 0 < len(distinct) <= KEPT_GRAMS else None
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        own = index[edges[i] : edges[i + 1]]
        if not len(own):
            continue
        if len(own) * 16 > len(distinct):
            count = np.bincount(own, minlength=len(distinct))
            which = np.flatnonzero(count)
            count = count[which]
        else:
            which, count = np.unique(own, return_counts=True)
        for a in range(0, len(which), 4096):
            part = which[a : a + 4096]
            rows = kept[part] if kept is not None else _bound(alphabet, distinct[part], seed)
            out[i] += count[a : a + 4096].astype(np.float32) @ rows.astype(np.float32)
    # a text without letters holds at most one n-gram of blanks, which says nothing
    return out


def _chunks(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 2
    if begin < len(texts):
        yield begin, len(texts)


def unit_bundles(texts: Sequence[str], seed: int) -> np.ndarray:
    rows = [bundles(texts[a:b], seed) for a, b in _chunks(texts)]
    out = np.concatenate(rows) if rows else np.zeros((0, DIMENSIONS), dtype=np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def in_training(id_col: Column) -> Column:
    """Whether a row may be learned from: crc32 of its id as text, modulo 5, isn't 0."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 != 0


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 3000, max_languages: int = 10_000, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """The languages by code point, and a row of unit length for each."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & in_training(F.col("id")))
    sizes = d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    rates = [(r["lang"], min(1.0, per_language / r["count"])) for r in sizes.collect()]
    if not rates:
        return [], np.zeros((0, DIMENSIONS))
    rate = F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate double"))
    lot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    sample = d.join(rate, "lang").filter(lot < F.col("rate")).select("lang", "text")

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors = unit_bundles(batch["text"].tolist(), seed)
            for lang, rows in batch.groupby("lang").indices.items():
                sums[lang] = sums.get(lang, 0) + vectors[rows].astype(np.float64).sum(axis=0)
        for lang, total in sums.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(DIMENSIONS), "value": np.round(total, 6)})

    # a row per task, language and dimension; sums of rounded decimals come out the same in any order
    total = sample.mapInPandas(add_up, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("value"))
    table = total.toPandas()
    langs = sorted(table["lang"].unique())
    prototypes = np.zeros((len(langs), DIMENSIONS))
    prototypes[table["lang"].map({x: i for i, x in enumerate(langs)}), table["dim"]] = table["value"]
    norm = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return langs, prototypes / np.where(norm == 0, 1, norm)


def predictor(langs: list[str], prototypes: np.ndarray, seed: int = 11):
    """A column function ``text -> struct(lang, score)``."""
    if not langs:
        return lambda text: F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    across = prototypes.T.astype(np.float32)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if t is not None else "" for t in batch]
            cosine = unit_bundles(texts, seed) @ across
            best = cosine.argmax(axis=1) if len(texts) else np.zeros(0, dtype=int)
            score = np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0).astype(float)
            some = np.array([any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)) for t in texts], dtype=bool)
            yield pd.DataFrame({"lang": np.where(some, np.array(langs, dtype=object)[best], "und"), "score": np.where(some, score, 0.0)})

    return predict


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``docs`` with ``prediction``: struct(lang, score), fitted on its own labelled rows."""
    predict = predictor(*fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options), seed=options.get("seed", 11))
    return docs.withColumn("prediction", predict(F.col(text_col)))
