"""Exact duplicates: a tree of merges of sorted digest runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.tables import folded, maybe_among, one_row_each, unused
from labelscope.sources import materialize

#: Runs that are merged at a time. There are at least and at most so many runs, a
#: power of that, of about so many rows.
FAN_IN = 8
RUNS, MOST_RUNS = FAN_IN**2, FAN_IN**5
RUN_ROWS = 250_000


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, the digest of the normalised text and two facts that verify it."""
    text = folded(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    return rows.select(
        "id",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").alias("n_bytes"),
        F.xxhash64("text").alias("check"),
    )


def _run_count(rows: int) -> int:
    """A power of the fan-in, so that a run has about ``RUN_ROWS`` rows."""
    runs = RUNS
    while runs < MOST_RUNS and rows > runs * RUN_ROWS:
        runs *= FAN_IN
    return runs


def merged_runs(
    digests: DataFrame, keep: str = "smallest", runs: int | None = None, fan_in: int = FAN_IN
) -> DataFrame:
    """One row per distinct text: ``digest, n_bytes, check, keep_id, group_size, keep_rows``.

    ``keep_rows`` is how many rows the one with the retained id stands for; it
    is null where all ids are null.

    Rows are dealt to ``runs`` runs by their id. In every round ``fan_in``
    neighbouring runs, or what they have become, exchange their rows: a
    partition receives one range of digests of the group of runs, sorts it and
    merges equal digests, so after r rounds there is a sorted run for each group
    of ``fan_in ** r`` runs, in that many ranges. There are as many partitions
    in every round as there are runs, none of them the root of all. A digest on
    any share of the rows is dealt over all runs first and one row per group
    after each round.

    Digests count as equal only if a second hash and the length agree too, so an
    identifier that is retained at a level has been verified there. A column
    ``rows`` tells how many rows a row stands for; ids are then counted before.
    """
    runs = _run_count(digests.count()) if runs is None else runs
    best = {"smallest": F.min, "largest": F.max}[keep]
    key = ["digest", "n_bytes", "check"]
    rows = F.col("rows") if "rows" in digests.columns else F.lit(1).cast("bigint")
    level = digests.select(
        F.pmod(F.xxhash64("id", "check"), F.lit(runs)).alias("run"),
        *key,
        # a struct sorts nulls first, so a null id must not be the smallest
        F.when(F.col("id").isNotNull(), F.struct("id", rows.alias("rows"))).alias("kept"),
        rows.alias("n"),
    )
    # the digest as a number below 2 ** 32, in the order of the digests
    place = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint")
    ranges = 1
    for _ in range(max(1, math.ceil(round(math.log(runs, fan_in), 9)))):
        ranges *= fan_in
        groups = -(-runs // ranges)
        group = F.floor(F.col("run") / ranges)
        own = group * ranges + F.floor(place * ranges / 2**32)
        # what is left of a run is known by the first of its runs
        level = (
            level.select((group * ranges).alias("run"), *key, "kept", "n", own.cast("int").alias("part"))
            .repartitionById(groups * ranges, F.col("part"))
            .sortWithinPartitions("part", "run", *key)
            .groupBy("part", "run", *key)
            .agg(best("kept").alias("kept"), F.sum("n").alias("n"))
        )
    return level.select(
        *key,
        F.col("kept.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("kept.rows").alias("keep_rows"),
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    runs: int | None = None,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z. Of a group
    the row with the smallest (or largest) id is kept. A null text is empty,
    and all empty texts are one group. Null ids never win against others; a
    group of null ids only keeps them all. Rows that repeat an id and its text
    are the same document and get the same verdict. Other columns of ``docs``
    may have any name. An empty table gives an empty result.

    The texts are read once and stay where they are: digests are stored and
    shuffled. The verdict
    returns to the rows by a join on the digest, whose partitions Spark may
    split where one digest is frequent.
    """
    digests = materialize(_digested(docs, id_col, text_col), "digests")
    key = ["digest", "n_bytes", "check"]
    groups = merged_runs(digests, keep, runs, fan_in).drop("keep_rows")
    marked = digests.join(groups, key, "left")
    return marked.select(
        F.col("id").alias(id_col),
        F.col("keep_id"),
        F.col("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    one_row: bool = False,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`exact_duplicates` keeps.

    With ``one_row`` just one row of each group stays, also where several rows
    have the retained id or all ids are null. Rows whose text cannot have a
    copy, which a filter of bounded size tells in the scan, pass by; only the
    others are joined with the groups, and those without an entry stay too.
    Nulls, ties, long texts, clashing names and empty tables are as described
    there.
    """
    digests = materialize(_digested(docs, id_col, text_col), "digests")
    if one_row:
        # rows of one id and text are counted, so that the retained id tells how many it has
        digests = digests.groupBy(*digests.columns).agg(F.count("*").alias("rows"))
    copies = merged_runs(digests, keep).where("group_size > 1")
    tied = F.coalesce(F.col("keep_rows") > 1, F.lit(True))
    copies = copies.withColumn("tied", tied if one_row else F.lit(False))
    copies = materialize(copies.drop("group_size", "keep_rows"), "copies")
    names: dict[str, str] = {}
    for name in ("digest", "n_bytes", "check", "keep_id", "tied", "copied"):
        names[name] = unused([*docs.columns, *names.values()], name)
    key = list(names.values())[:3]
    text = folded(docs[f"`{text_col}`"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumn(names["check"], F.xxhash64(text))
    marked = maybe_among(hashed, names["check"], copies.select("check"), names["copied"])
    rows = marked.where(F.col(names["copied"])).withColumns(
        {key[0]: F.unhex(F.sha2(text, 256)), key[1]: F.octet_length(text)}
    )
    copies = copies.withColumnsRenamed(names)
    best, tied = F.col(names["keep_id"]), F.col(names["tied"])
    # a group whose ids are all null has a null keep_id, as has a row without copies
    kept = best.isNull() | F.col(f"`{id_col}`").eqNullSafe(best)
    joined = rows.join(copies, key, "left")
    result = marked.where(~F.col(names["copied"])).select(*columns)
    result = result.unionByName(
        joined.where(kept & ~F.coalesce(tied, F.lit(False))).select(*columns)
    )
    if one_row and not copies.where(tied).isEmpty():
        several = rows.join(copies.where(tied), key).where(kept).select(*key, *columns)
        result = result.unionByName(one_row_each(several, key).select(*columns))
    return result
