"""Language proportions of documents by expectation-maximisation over trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscope.llm.tables import unused
from labelscope.llm.text import runs, tidy

#: Trigrams are counted in this many buckets.
BUCKET_BITS = 14
#: Documents per language that the model is fitted on, about.
FIT_ROWS = 4000
#: The model is sent to every task: of more labels than this only the most
#: frequent ones are learned, and rows with the others count as unlabelled.
MOST_LANGUAGES = 1000
#: Trigrams times languages that are worked on at a time, about.
RUN_CELLS = 2_000_000
#: Trigrams overlap, so three of them count as one observation.
OVERLAP = 3.0
#: Count that every bucket of every language has before the first document.
PRIOR = 0.5
#: Shares at which the slope of the likelihood is taken to bound its gain.
STEPS = (0.0, *(2.0**-i for i in range(14, -1, -1)))

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point the lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every trigram, where each text's begin, and whether it has a letter.

    Letters are lower-cased, and other characters in a row are one space; a
    text has a space on either side. The second array has one more entry.
    """
    joined = "".join("\n" + (t or "") for t in texts) + "\n"
    letters = _letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    keep = letters > 0
    counted = np.concatenate([[0], np.cumsum(keep)])
    lettered = counted[bounds[1:]] > counted[bounds[:-1]]
    keep[1:] |= letters[:-1] > 0
    keep[bounds] = True
    first = np.concatenate([[0], np.cumsum(keep)])[bounds]
    s = letters[keep]
    h = s[:-2] * np.uint32(0x9E3779B1) + s[1:-1] * np.uint32(0x85EBCA77)
    h += s[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    buckets = (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
    # a trigram may end on the space that begins the next text, and no later
    n = np.maximum(np.diff(first) - 1, 0)
    inside = np.arange(n.sum()) + np.repeat(first[:-1] - np.cumsum(n) + n, n)
    return buckets[inside], np.concatenate([[0], np.cumsum(n)]), lettered


@dataclass(frozen=True)
class LanguageModel:
    """Trigram probabilities: a row per bucket, a column per language."""

    languages: tuple[str, ...]
    logs: np.ndarray


def fitted(
    labelled: DataFrame,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """The model of the languages that non-null labels of non-null texts name.

    It is fitted on about ``fit_rows`` documents of each language, chosen by a
    hash of id and text. Of more than ``MOST_LANGUAGES`` labels the most
    frequent ones are learned. What reaches the driver is one number per
    language and bucket, however large the table.
    """
    rows = labelled.select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.col(f"`{text_col}`").alias("text"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"),
    ).where("lang is not null and text is not null")
    by_size = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    sizes = by_size.limit(MOST_LANGUAGES).collect()
    languages = tuple(sorted(r["lang"] for r in sizes))
    if not languages:
        return LanguageModel((), np.zeros((1 << BUCKET_BITS, 0), np.float32))
    limits = {r["lang"]: min(1.0, fit_rows / r["n"]) for r in sizes}
    number = {name: i for i, name in enumerate(languages)}
    share = F.coalesce(
        *[F.when(F.col("lang") == name, F.lit(limit)) for name, limit in limits.items()]
    )
    sample = rows.where(F.col("h").cast("double") / 2.0**64 + 0.5 < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            own = [number[x] for x in batch.column("lang").to_pylist()]
            for low, high in runs(batch.column("text")):
                texts = batch.column("text").slice(low, high - low).to_pylist()
                buckets, bounds, _ = trigrams(texts)
                key = np.repeat(own[low:high], np.diff(bounds)) << BUCKET_BITS
                totals += np.bincount(key + buckets, minlength=totals.size).reshape(totals.shape)
        lang, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang), pa.array(bucket), pa.array(totals[lang, bucket])],
            names=["lang", "bucket", "n"],
        )

    counted = sample.mapInArrow(tidy(count), "lang bigint, bucket bigint, n bigint")
    counts = np.full((1 << BUCKET_BITS, len(languages)), PRIOR)
    total = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = total.select(F.col("lang").cast("smallint"), F.col("bucket").cast("int"), "n").toArrow()
    lang, bucket, n = (np.asarray(found.column(c)) for c in ("lang", "bucket", "n"))
    counts[bucket, lang] += n
    logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return LanguageModel(languages, logs)


def mixture(counts: np.ndarray, logs: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Shares of the languages, and the log likelihood, by expectation-maximisation.

    ``counts`` are those of a document's distinct buckets, ``logs`` the rows of
    the model for them and the columns of the languages to choose from.
    """
    peak = logs.max(axis=1, keepdims=True)
    likelihood = np.exp(logs - peak)
    shares = np.full(logs.shape[1], 1.0 / logs.shape[1])
    value = -np.inf
    for _ in range(rounds):
        joint = likelihood * shares
        total = joint.sum(axis=1)
        before, value = value, float(counts @ np.log(total))
        if value - before < 1e-3:
            break
        shares = counts @ (joint / total[:, None]) / counts.sum()
    return shares, value + float(counts @ peak[:, 0])


def penalty(n: float) -> float:
    """What a language must add to the log likelihood of ``n`` overlapping trigrams."""
    return 0.5 * float(np.log(max(n / OVERLAP, np.e)))


def may_gain(logs: np.ndarray, start: int, least: float) -> bool:
    """Whether a second language could raise the log likelihood by more than ``least``.

    False is proven. With the share s of the other language the likelihood is
    concave, so its slope falls: it is never above the slope at the step of
    ``STEPS`` before, and once that is not positive nothing more is gained.
    """
    excess = np.exp((logs - logs[:, [start]]).astype(np.float64)) - 1
    slope = excess.sum(axis=0)
    slope[start] = 0.0
    # the likelihood itself is compared in double precision
    least -= 1e-6 * (1 + len(logs))
    for k in np.flatnonzero(slope > -1e-6 * len(logs)):
        if k == start:
            continue
        own, bound = excess[:, k], max(slope[k], 0.0) * STEPS[1]
        for s, to in zip(STEPS[1:-1], STEPS[2:], strict=True):
            if bound > least:
                return True
            now = float((own / (1 + s * own)).sum())
            if now <= 0:
                break
            bound += now * (to - s)
        if bound > least:
            return True
    return False


def language_set(buckets: np.ndarray, logs: np.ndarray, start: int) -> dict[int, float]:
    """Language -> share for one document, by penalised likelihood.

    From the likeliest single language on, the language that raises the
    likelihood most joins while the gain is above half the logarithm of the
    number of observations (the Bayesian information criterion).
    """
    places, counts = np.unique(buckets, return_counts=True)
    own, counts = logs[places].astype(float), counts.astype(float)
    least = penalty(counts.sum())
    chosen, shares = [start], np.ones(1)
    value = float(counts @ own[:, start])
    while len(chosen) < logs.shape[1]:
        others = [k for k in range(logs.shape[1]) if k not in chosen]
        fits = [mixture(counts, own[:, [*chosen, k]]) for k in others]
        best = max(range(len(others)), key=lambda i: fits[i][1])
        if (fits[best][1] - value) / OVERLAP <= least:
            break
        chosen.append(others[best])
        shares, value = fits[best]
    return dict(zip(chosen, shares.tolist(), strict=True))


def infer(texts: list[str | None], model: LanguageModel) -> list[dict[str, float]]:
    """Language -> share for each text; empty without a letter or a model."""
    buckets, bounds, lettered = trigrams(texts)
    out: list[dict[str, float]] = [{} for _ in texts]
    rows = np.flatnonzero(lettered)
    if not model.languages or not len(rows):
        return out
    own = model.logs[buckets]
    sums = np.add.reduceat(own, bounds[rows], axis=0, dtype=np.float64)
    if len(rows) < len(texts):  # the rest have trigrams of spaces, which reduceat adds
        sums = np.stack([own[bounds[r] : bounds[r + 1]].sum(axis=0, dtype=np.float64) for r in rows])
    best = sums.argmax(axis=1)
    for row, a in zip(rows.tolist(), best.tolist(), strict=True):
        part = own[bounds[row] : bounds[row + 1]]
        if may_gain(part, a, penalty(len(part)) * OVERLAP):
            shares = language_set(buckets[bounds[row] : bounds[row + 1]], model.logs, a)
        else:
            shares = {a: 1.0}
        out[row] = {model.languages[k]: s for k, s in shares.items()}
    return out


def with_languages(
    docs: DataFrame, model: LanguageModel, text_col: str = "text"
) -> tuple[DataFrame, str, str, str]:
    """``docs`` with three columns more, and their names: language, score, shares.

    The language is that with the largest share, the score its share; equal
    shares go to the first name. Without a letter the language is ``und``, the
    score 0 and there are no shares.
    """
    names: list[str] = []
    for name in ("lang_pred", "score", "shares"):
        names.append(unused([*docs.columns, *names], name))
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField(names[0], T.StringType()),
            T.StructField(names[1], T.DoubleType()),
            T.StructField(names[2], T.MapType(T.StringType(), T.DoubleType())),
        ]
    )
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            for low, high in runs(column, RUN_CELLS // max(1, len(model.languages))):
                found = infer(column.slice(low, high - low).to_pylist(), model)
                top = [max(sorted(s), key=s.__getitem__) if s else UNKNOWN for s in found]
                new = [
                    pa.array(top, pa.string()),
                    pa.array([min(1.0, s.get(t, 0.0)) for s, t in zip(found, top)], pa.float64()),
                    pa.array([list(s.items()) for s in found], pa.map_(pa.string(), pa.float64())),
                ]
                old = [c.slice(low, high - low) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*old, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(tidy(predict), schema), *names


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of ids that the model must not learn from; a null id is in none."""
    rest = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def identified(
    docs: DataFrame,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per document: the id, ``held_out, lang_pred, score, shares``.

    The model learns from the documents that aren't held out and have a
    language; predictions see the text only. Rows with a null id are predicted
    and not learned from. Null, empty and letterless texts are ``und``, as is
    everything when nothing can be learned. Repeated rows get equal results.
    Texts of any length are used whole; other columns may have any name.
    """
    known = docs.where(F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
    model = fitted(known, fit_rows, id_col, text_col, lang_col)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        held_out(id_col).alias("held_out"),
        F.col(f"`{text_col}`").alias("text"),
    )
    predicted, *names = with_languages(rows, model)
    return predicted.select(F.col("id").alias(id_col), "held_out", *names)


def kept_languages(
    docs: DataFrame,
    least_share: float = 0.5,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` in which one learned language has ``least_share`` or more.

    Rows whose text is null, empty or without letters go, as do all when nothing
    can be learned. Rows that repeat are kept or go together; null ids matter
    only to which rows the model is fitted on. Columns may have any name, texts
    are taken whole, and an empty table stays empty.
    """
    model = fitted(docs, fit_rows, id_col, text_col, lang_col)
    predicted, lang, score, _ = with_languages(docs, model, text_col)
    good = (F.col(lang) != UNKNOWN) & (F.col(score) >= least_share)
    return predicted.where(good).select(*[F.col(f"`{c}`") for c in docs.columns])
