"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.tables import word_count
from labelscope.sources import materialize

#: Cells of the seeded order at each of two levels.
CELLS = 4096


def filled_targets(sizes: DataFrame, total: float, epochs: float = 2.0) -> DataFrame:
    """``source, source_size, weight`` with each source's ``target`` added.

    The total is shared by weight. A source is clamped at ``epochs`` times its
    size, and what it can't take is shared among the others by weight, until
    none is above. Sources in the order of (cap / weight) are clamped exactly
    up to the first whose share fits, so the end of that repetition is found
    with one running sum over the sources. A source of size 0 or without a
    positive weight takes nothing. If all are clamped, each takes its cap.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0)), F.lit(0)).cast("double")
    rows = sizes.select("source", "source_size", "weight", cap.alias("cap"), weight.alias("w"))
    tie = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    # one row per source: a small table, ordered as a whole
    before = Window.orderBy(*tie).rowsBetween(Window.unboundedPreceding, -1)
    live = rows.where("w > 0 and cap > 0").select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("clamped"),
        F.sum("w").over(Window.orderBy(*tie).rowsBetween(0, Window.unboundedFollowing)).alias("free"),
    )
    level = (F.lit(float(total)) - F.col("clamped")) / F.col("free")
    # the level at which the water stands: that of the first source that isn't clamped
    water = live.where(F.col("w") * level <= F.col("cap")).agg(
        F.min(F.struct(F.col("cap") / F.col("w"), level.alias("level")))["level"]
    )
    height = water.first()[0]
    share = F.least(F.col("cap"), F.col("w") * F.lit(float("inf") if height is None else height))
    target = F.when((F.col("w") > 0) & (F.col("cap") > 0), share).otherwise(0.0)
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _seeded(id_col: str, seed: int) -> Column:
    """24 bits of a digest of the id and the seed: a place in the seeded order."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


def sized(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
) -> DataFrame:
    """``id, source, size, place``: the words of a text and its place in the seeded order."""
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        _seeded(f"`{id_col}`", seed).alias("place"),
    )


def ranked_weights(sources: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """``source, weight``: the weights in turn over sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(w) for w in cycle])
    ranked = sources.select("source").distinct().select("source", rank.alias("rank"))
    return ranked.select("source", F.get(values, F.col("rank") % len(cycle)).alias("weight"))


def _crossing(sums: DataFrame, cell: str) -> DataFrame:
    """Per source the cell in which the running size passes ``rest``."""
    order = Window.partitionBy("source").orderBy(cell)
    upto = F.sum("cell_size").over(order)
    running = sums.withColumn("before", F.col("start") + upto - F.col("cell_size"))
    inside = (F.col("before") <= F.col("rest")) & (
        F.col("rest") < F.col("before") + F.col("cell_size")
    )
    return running.where(inside)


def mixing_plan(
    rows: DataFrame, weights: DataFrame | None = None, share: float = 1.5, epochs: float = 2.0
) -> DataFrame:
    """One row per source: target, whole repetitions, and where the fractional one ends.

    ``rows`` are those of :func:`sized`, stored, since they are read three
    times. The fractional repetition takes documents in the seeded order until
    the rest of the target is reached. Where that is, is found by counting: the
    sizes of 4,096 cells of the order per source, and of 4,096 cells within the
    one in which the rest is reached. Nothing is gathered by source but cells.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weights = ranked_weights(sizes)
    total = sizes.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    same = sizes["source"].eqNullSafe(weights["source"])
    weighted = sizes.join(weights, same, "left").select(sizes["*"], weights["weight"])
    target = F.col("target")
    # a share that misses a whole number by rounding only is that number
    whole = F.floor(target / F.col("source_size") + 1e-12)
    plan = filled_targets(weighted, total * share, epochs).select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, whole).otherwise(0).alias("whole"),
    )
    rest = F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    plan = materialize(plan.withColumn("rest", rest), "mixing-targets")

    first, second = F.shiftright("place", 12), F.col("place").bitwiseAND(CELLS - 1)
    cells = rows.groupBy("source", first.alias("cell")).agg(F.sum("size").alias("cell_size"))
    same = cells["source"].eqNullSafe(plan["source"])
    sums = cells.join(plan, same).select(
        cells["source"], "cell", "cell_size", "rest", F.lit(0).cast("bigint").alias("start")
    )
    outer = materialize(_crossing(sums, "cell"), "mixing-cells")
    same = rows["source"].eqNullSafe(outer["source"]) & (first == outer["cell"])
    inner = (
        rows.join(outer, same)
        .groupBy(rows["source"], outer["cell"], "rest", "before", second.alias("inner"))
        .agg(F.sum("size").alias("cell_size"))
        .withColumnRenamed("before", "start")
    )
    ends = _crossing(inner, "inner").select(
        "source",
        (F.col("cell") * CELLS + F.col("inner")).alias("end_place"),
        F.col("before").alias("end_before"),
        F.col("cell_size").alias("end_size"),
    )
    same = plan["source"].eqNullSafe(ends["source"])
    return materialize(
        plan.join(ends, same, "left").select(
            plan["*"], ends["end_place"], ends["end_before"], ends["end_size"]
        ),
        "mixing-plan",
    )


#: More sources than this are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``source_size, target`` and ``taken``: the words the mix takes of each.

    A document is taken ``whole`` times, and once more if its place is before the
    end of the fractional repetition. What lies at the end is taken or left as a
    whole, whichever comes nearer to the target, so no text is cut and rows that
    share a place agree.
    """
    small = plan.count() <= BROADCAST_SOURCES
    names = [c for c in plan.columns if c != "source"]
    side = plan.select(F.col("source").alias("plan_source"), *names)
    joined = rows.join(
        F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("plan_source"))
    )
    nearer = 2 * (F.col("rest") - F.col("end_before")) > F.col("end_size")
    once_more = (F.col("place") < F.col("end_place")) | (
        (F.col("place") == F.col("end_place")) & nearer
    )
    extra = F.when(once_more, F.col("size")).otherwise(0)
    words = (F.col("whole") * F.col("size") + extra).cast("bigint")
    return joined.withColumn("taken", words).drop(
        "plan_source", *[n for n in names if n not in ("source_size", "target")]
    )


def mixed(
    docs: DataFrame,
    weights: DataFrame | None = None,
    share: float = 1.5,
    epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken.

    Sizes are words; a null text has none and takes nothing. A null source is
    a source. Sources missing in ``weights`` (``source, weight``) take nothing;
    without ``weights`` 3, 1, 2 go round. Ties in the seeded order are rows
    that share a place; they are treated alike, whatever their order or
    partition. An empty table gives an empty result.
    """
    rows = materialize(sized(docs, id_col, text_col, source_col, seed), "mixing-sizes")
    result = taken(rows, mixing_plan(rows, weights, share, epochs))
    return result.select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken"
    )


def repeated(
    docs: DataFrame,
    weights: DataFrame | None = None,
    share: float = 1.5,
    epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: rows of ``docs``, whole, as often as :func:`mixed` takes them.

    A text without words takes nothing, so it has no row. Null ids and sources,
    ties, repeated rows and empty tables are as described there; columns may
    have any name, and texts of any length stay as they are.
    """
    rows = materialize(sized(docs, id_col, text_col, source_col, seed), "mixing-sizes")
    plan = mixing_plan(rows, weights, share, epochs)
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{source_col}`").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        _seeded(f"`{id_col}`", seed).alias("place"),
    )
    counted = taken(wide, plan).where("taken > 0")
    times = (F.col("taken") / F.col("size")).cast("int")
    copies = counted.select("row", F.explode(F.sequence(F.lit(1), times)))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
