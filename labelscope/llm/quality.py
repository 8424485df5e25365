"""Quality rules of documents, and of the hosts they come from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.tables import stored

from labelscope.llm.text import as_bytes, mix, runs, span_hashes, window_hashes, word_spans

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: Rule -> SQL condition over the measures of one document that fails it. The
#: first two make a document fail by itself, all of them count for its host.
BASE_RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
}
HOST_RULES = {
    **BASE_RULES,
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "odd_words": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}
#: A host whose shrunk failure rate is above this, by any rule, is rejected.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1e6
#: More hosts than this are joined by a shuffle.
BROADCAST_HOSTS = 100_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeated(groups: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the times its hash occurs in its group, and whether it is the first."""
    keys = mix(hashes + groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, which, times = np.unique(
        keys, return_index=True, return_inverse=True, return_counts=True
    )
    leads = np.zeros(len(keys), bool)
    leads[first] = True
    return times[which] if len(keys) else times, leads


def measures(column: pa.Array) -> Iterator[np.ndarray]:
    """For each run of texts a row of :data:`MEASURES` per text."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for low, high in runs(column):
        data, bounds = as_bytes(column.slice(low, high - low))
        n = high - low

        def total(mask: np.ndarray, at: np.ndarray = bounds) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[at])

        starts, ends, firsts = word_spans(data, bounds)
        n_words = np.diff(firsts)
        word_bytes = np.zeros(len(data) + 1, np.int8)
        word_bytes[starts] += 1
        word_bytes[ends] -= 1
        in_word = np.cumsum(word_bytes[:-1], dtype=np.int8).astype(bool)
        word_chars = total(in_word & ((data & 0xC0) != 0x80))

        begins = np.zeros(len(data) + 1, bool)
        begins[1:] = data == 10
        begins[bounds] = True
        line_starts = np.flatnonzero(begins)
        line_ends = line_starts[1:]
        line_starts = line_starts[:-1]
        doc_of = np.searchsorted(bounds, line_starts, "right") - 1
        # the line break is not part of its line
        breaks = data[line_ends - 1] == 10 if len(line_ends) else np.zeros(0, bool)
        line_ends = line_ends - breaks
        worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        spans = line_starts[worded], line_ends[worded]
        groups = doc_of[worded]
        _, leads = _repeated(groups, span_hashes(data, *spans))
        n_lines = np.bincount(groups, minlength=n)
        n_dup_lines = np.bincount(groups[~leads], minlength=n)

        words = span_hashes(data, starts, ends)
        windows = window_hashes(words, 3)
        owner = np.repeat(np.arange(n), n_words)
        inside = np.flatnonzero(owner[: len(windows)] == owner[2:]) if len(windows) else []
        at = np.asarray(inside, np.int64)
        times, _ = _repeated(owner[at], windows[at])
        covered = np.zeros(len(words) + 1, np.int64)
        again = at[times > 1] if len(at) else at
        np.add.at(covered, again, 1)
        np.add.at(covered, again + 3, -1)
        n_repeat = total(np.cumsum(covered[:-1]) > 0, firsts)
        yield np.stack([n_words, word_chars, total(symbol[data]), n_lines, n_dup_lines, n_repeat])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(measures(batch.column("text")))
        numbers = np.concatenate(found, axis=1) if found else np.zeros((len(MEASURES), 0), int)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("host"),
                *[pa.array(row, pa.int64()) for row in numbers],
            ],
            names=["id", "host", *MEASURES],
        )


def _fails(condition: str) -> Column:
    return F.expr(condition).cast("bigint")


def host_rates(measured: DataFrame, rules: dict[str, str] = HOST_RULES) -> DataFrame:
    """One row per host: ``host, n_docs`` and the shrunk failure rate of each rule.

    Hosts are draws from a beta distribution whose mean is the rate over all
    documents and whose weight follows from the variance between hosts beyond
    the binomial one (method of moments). A host's rate is that of its
    documents and of the prior together: few documents prove little. Documents
    without a host are in no host.
    """
    counted = [F.sum(_fails(c)).alias(f"failed_{r}") for r, c in rules.items()]
    hosts = stored(
        measured.where("host is not null")
        .groupBy("host")
        .agg(F.count("*").alias("n_docs"), *counted),
        "hosts",
    )
    sums = hosts.agg(
        F.sum("n_docs").alias("n"),
        F.count("*").alias("hosts"),
        F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("squares"),
        *[F.sum(f"failed_{r}").alias(r) for r in rules],
        *[
            F.sum(F.col(f"failed_{r}").cast("double") * F.col(f"failed_{r}") / F.col("n_docs")).alias(
                f"spread_{r}"
            )
            for r in rules
        ],
    ).first()
    rates = []
    for rule in rules:
        mean = (sums[rule] or 0) / sums["n"] if sums["n"] else 0.0
        weight = prior_weight(
            mean, sums[f"spread_{rule}"] or 0.0, sums["n"] or 0, sums["hosts"], sums["squares"] or 0.0
        )
        rate = (F.col(f"failed_{rule}") + mean * weight) / (F.col("n_docs") + weight)
        rates.append(rate.alias(f"rate_{rule}"))
    return hosts.select("host", "n_docs", *rates)


def prior_weight(mean: float, spread: float, n: int, hosts: int, squares: float) -> float:
    """alpha + beta of the prior, from the sum of failed * failed / n_docs over hosts."""
    room = n - squares / n if n else 0.0
    if room <= 0 or not 0 < mean < 1:
        return MOST_WEIGHT
    between = (spread - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / room
    if between <= 0:
        return MOST_WEIGHT
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, mean * (1 - mean) / between - 1))


def judged(
    docs: DataFrame,
    host: Column | str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: dict[str, str] = HOST_RULES,
    limit: float = HOST_LIMIT,
) -> DataFrame:
    """One row per document: the id, host, measures, ``base_failed, host_kept, kept``.

    A document fails by itself when it is short or repetitive. Otherwise the
    verdict is that of its host: rejected if by any rule its shrunk failure
    rate is above ``limit``. ``host`` is a column or an expression, such as the
    host of a URL.

    Null and empty texts have no words and fail. A null host has no verdict
    against it. Repeated rows count as often as they occur. Whole texts are
    measured; other columns may have any name. An empty table gives an empty
    result. A host with any share of the documents is summed in parts, and its
    verdict comes back by a broadcast when there are few hosts.
    """
    where = F.col(f"`{host}`") if isinstance(host, str) else host
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        where.cast("string").alias("host"),
        F.col(f"`{text_col}`").alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {id_type}", "host string", *[f"{m} bigint" for m in MEASURES]])
    measured = stored(rows.mapInArrow(_measure, schema), "measures")
    rates = host_rates(measured, rules)
    worst = F.greatest(*[F.col(f"rate_{r}") for r in rules], F.lit(0.0))
    verdicts = stored(rates.select("host", (worst <= limit).alias("host_kept")), "host-verdicts")
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    failed = F.expr(" or ".join(f"({c})" for c in BASE_RULES.values()))
    return (
        measured.join(verdicts, "host", "left")
        .withColumn("base_failed", failed)
        .withColumn("host_kept", F.coalesce(F.col("host_kept"), F.lit(True)))
        .select(
            F.col("id").alias(id_col),
            "host",
            *MEASURES,
            "base_failed",
            "host_kept",
            (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
        )
    )
