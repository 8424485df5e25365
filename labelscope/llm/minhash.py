"""Near duplicates: HyperMinHash registers, bands, corrected estimates, full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.components import components
from labelscope.llm.tables import maybe_among, one_row_each, stored, unused
from labelscope.llm.text import mix, runs, shingle_sets, tidy

#: Registers of a document: 2 ** P buckets.
P = 7
BUCKETS = 1 << P
#: Bits of a register that hold the mantissa; the others hold the leading zeros.
MANTISSA = 10
#: Registers in a band: two documents of similarity 0.8 share one of the 32
#: bands but for 1 pair in 20 million.
BAND = 4
BANDS = BUCKETS // BAND
#: Documents that are compared at a time, on either side, and their shingles.
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
#: An estimate this many standard deviations below the threshold is a rejection.
DEVIATIONS = 6.0

_ORDER = np.argsort(
    mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, BUCKETS),
    axis=1,
)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def registers(minima: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the first one, of the least hash of each bucket.

    ``minima`` has a row per document and a column per bucket; an empty bucket
    takes the register of the first filled one in its own fixed order.
    """
    filled = minima != _EMPTY
    # 52 bits go into a double without rounding
    rest = (minima << np.uint64(P)) >> np.uint64(12)
    zeros = 52 - np.frexp(rest.astype(np.float64))[1]
    tail = (rest << zeros.astype(np.uint64)) >> np.uint64(51 - MANTISSA)
    found = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (
        tail & np.uint64((1 << MANTISSA) - 1)
    )
    found = found.astype(np.uint16)
    for row in np.flatnonzero(~filled.all(axis=1)):
        place = filled[row][_ORDER].argmax(axis=1)
        borrowed = found[row][_ORDER[np.arange(BUCKETS), place]]
        found[row] = np.where(filled[row], found[row], borrowed)
    return found


_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - P)


def bucket_minima(shingles: np.ndarray) -> np.ndarray:
    """The least hash in each bucket (the first bits), of ascending hashes."""
    at = np.searchsorted(shingles, _EDGES)
    least = np.append(shingles, _EMPTY)[at]
    inside = (least >> np.uint64(64 - P)) == np.arange(BUCKETS, dtype=np.uint64)
    return np.where(inside & (at < len(shingles)), least, _EMPTY)


def _sketcher(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), k)
            for low, high in runs(batch.column("text")):
                sizes, nodes, minima = [], [], []
                for _ in range(low, high):
                    shingles = next(sets)
                    sizes.append(len(shingles))
                    if len(shingles):
                        nodes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                        minima.append(bucket_minima(shingles))
                    else:
                        nodes.append(None)
                signs = iter(registers(np.array(minima)) if minima else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(low, high - low),
                        batch.column("row_key").slice(low, high - low),
                        pa.array(sizes, pa.int64()),
                        pa.array(nodes, pa.binary()),
                        pa.array([next(signs).tobytes() if n else None for n in nodes], pa.binary()),
                    ],
                    names=["id", "row_key", "n_shingles", "node", "registers"],
                )

    return sketch


def _setter(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(batch.column("text"), k)
            for low, high in runs(batch.column("text")):
                own = [next(found) for _ in range(low, high)]
                total = np.cumsum([0, *map(len, own)]).astype(np.int32)
                values = np.concatenate(own).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").slice(low, high - low),
                        pa.ListArray.from_arrays(pa.array(total), pa.array(values)),
                    ],
                    names=["node", "shingles"],
                )

    return sets


#: Fixed value of the expected number of registers equal by chance.
_COLLISIONS = 0.169919487159739 * 4


def corrected_estimate(matches: Column, size_a: Column, size_b: Column) -> Column:
    """Similarity from the number of equal registers, without those equal by chance.

    The number that two unrelated sets share by chance follows from the ratio
    of their sizes, as HyperMinHash gives it for sets larger than the buckets.
    """
    low, high = F.least(size_a, size_b), F.greatest(size_a, size_b)
    ratio = high / low
    chance = _COLLISIONS * 2.0 ** (P - MANTISSA) * ratio / F.pow(1 + ratio, F.lit(2.0))
    return (matches - chance) / (BUCKETS - chance)


def corrected_share(matches: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """:func:`corrected_estimate` of arrays: equal registers, smaller and larger size."""
    ratio = high / low
    chance = _COLLISIONS * 2.0 ** (P - MANTISSA) * ratio / (1 + ratio) ** 2
    return (matches - chance) / (BUCKETS - chance)


def plausible(matches: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    """Whether the estimate doesn't rule out a similarity of ``percent``.

    Sizes alone bound the similarity too. Small sets fill few buckets, so their
    estimates vary with their size and not with the number of buckets.
    """
    j = percent / 100
    smaller = F.least(size_a, size_b)
    spread = F.sqrt(F.lit(j * (1 - j)) / F.least(smaller, F.lit(BUCKETS)))
    estimate = corrected_estimate(matches, size_a, size_b)
    by_size = 100 * smaller >= percent * F.greatest(size_a, size_b)
    return by_size & (estimate >= j - DEVIATIONS * spread)


def _equal_registers(a: str, b: str) -> Column:
    same = f"if(substring({a}, 2 * i + 1, 2) = substring({b}, 2 * i + 1, 2), 1, 0)"
    return F.expr(f"aggregate(sequence(0, {BUCKETS - 1}), 0, (n, i) -> n + {same})")


def _compare(rows: pa.Table, percent: int, link: bool) -> tuple[list, list]:
    """Outsiders of one band against all its members in this block.

    A pair counts only in the first band that it shares, if it lies in two
    components and its registers don't rule it out. Without ``link`` the
    documents of such pairs are returned, each once. With ``link`` pairs are
    verified on the full sets, and links are returned that connect what isn't
    connected yet: fewer than there are documents.
    """
    side = np.asarray(rows.column("outsider"))
    comp = np.asarray(rows.column("comp").combine_chunks().dictionary_encode().indices).copy()
    nodes = rows.column("node").to_pylist()
    size = np.asarray(rows.column("n_shingles"), np.float64)
    signs = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16)
    signs = signs.reshape(len(nodes), BUCKETS)
    bands = signs.view(np.uint64)
    sets = rows.column("shingles").to_pylist() if link else None
    every, out = np.flatnonzero(~side), np.flatnonzero(side)
    # a power of two, so this holds for negative keys too
    band = rows.column("key")[0].as_py() % BANDS
    j = percent / 100
    marked: set[bytes] = set()
    found: list[tuple[bytes, bytes]] = []
    for o in out:
        near = every[comp[every] != comp[o]]
        if not len(near):
            continue
        shared = bands[near] == bands[o]
        matches = (signs[near] == signs[o]).sum(axis=1)
        low = np.minimum(size[near], size[o])
        high = np.maximum(size[near], size[o])
        spread = np.sqrt(j * (1 - j) / np.minimum(low, BUCKETS))
        estimate = corrected_share(matches, low, high)
        good = (100 * low >= percent * high) & (estimate >= j - DEVIATIONS * spread)
        good &= shared[:, band] & (shared.argmax(axis=1) == band)
        near, matches = near[good], matches[good]
        if not link:
            if len(near):
                marked.update(nodes[i] for i in (o, *near))
            continue
        for i in near[np.argsort(-matches, kind="stable")]:
            if comp[i] == comp[o]:
                continue
            common = len(np.intersect1d(sets[o], sets[i], assume_unique=True))
            if 100 * common >= percent * (len(sets[o]) + len(sets[i]) - common):
                found.append((nodes[o], nodes[i]))
                comp[comp == comp[o]] = comp[i]
    if not link:
        return list(marked), []
    return [a for a, _ in found], [b for _, b in found]


def _blocks(percent: int, link: bool):
    """:func:`_compare` for every block of rows sorted by ``key, part_all, part_out``.

    One block is at most some hundred documents, or some million shingles, on
    either side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            table = pa.Table.from_batches(waiting)
            a, b = _compare(table, percent, link)
            if a and link:
                arrays = [pa.array(a, pa.binary()), pa.array(b, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])
            elif a:
                key = pa.array([table.column("key")[0].as_py()] * len(a), pa.int64())
                arrays = [key, pa.array(a, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "node"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack(
                [np.asarray(batch.column(c)) for c in ("key", "part_all", "part_out")], axis=1
            )
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if last is not None and (keys[0] != last).any():
                change = np.concatenate([[0], change])
            last = keys[-1]
            at = 0
            for to in change:
                if to > at:
                    waiting.append(batch.slice(at, to - at))
                yield from flushed()
                waiting, at = [], to
            waiting.append(batch.slice(at))
        yield from flushed()

    return run


def _shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles`` of the wanted ``node, row_key``, stored."""
    # texts that nobody wants are left out in the scan and not shuffled
    near = maybe_among(docs, "row_key", wanted.select("row_key"), "wanted").where("wanted")
    texts = near.join(wanted, "row_key").select("node", "text")
    sets = texts.mapInArrow(tidy(_setter(shingle)), "node binary, shingles array<bigint>")
    # rows that repeat an id and its text give the same set again
    return stored(sets, "shingle-sets").dropDuplicates(["node"])


def _verified(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, percent: int
) -> DataFrame:
    """Those of the distinct pairs ``a, b`` whose full sets are similar enough, stored."""
    about = classes.select("node", "registers", "n_shingles", "row_key")
    sides = [
        about.select(*[F.col(c).alias(f"{c}_{side}") for c in about.columns]) for side in ("a", "b")
    ]
    joined = pairs.join(sides[0], F.col("a") == F.col("node_a")).join(
        sides[1], F.col("b") == F.col("node_b")
    )
    matches = _equal_registers("registers_a", "registers_b")
    likely = joined.where(
        plausible(matches, F.col("n_shingles_a"), F.col("n_shingles_b"), percent)
    )
    likely = stored(likely.select("a", "b", "row_key_a", "row_key_b"), "likely-pairs")
    wanted = (
        likely.select(F.col("a").alias("node"), F.col("row_key_a").alias("row_key"))
        .union(likely.select("b", "row_key_b"))
        .distinct()
    )
    wanted = stored(wanted, "wanted-texts")
    sets = _shingle_sets(docs, wanted, shingle)
    both = likely.join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a"
    ).join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    linked = both.where(100 * common >= percent * union).select("a", "b")
    return stored(linked, "linked-pairs")


def _open_members(rows: DataFrame, least: int) -> DataFrame:
    """Those of the band members ``key, node, comp, n_shingles`` whose band is open.

    That is one with several components and at least ``least`` members. Each
    row says whether it is outside the largest component of its band, and into
    how many parts all members and those outside are dealt.
    """
    per_comp = rows.groupBy("key", "comp").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")
    )
    load = F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)
    bands = (
        per_comp.select("key", "comp", "n", load.alias("load"))
        .groupBy("key")
        .agg(
            F.count("*").alias("n_comps"),
            F.sum("n").alias("n_all"),
            F.sum("load").alias("load"),
            F.max(F.struct("n", "comp", "load")).alias("major"),
        )
        .where((F.col("n_comps") > 1) & (F.col("n_all") >= least))
        .select(
            "key",
            F.col("major.comp").alias("major"),
            F.ceil("load").cast("int").alias("parts_all"),
            F.ceil(F.greatest(F.col("load") - F.col("major.load"), F.lit(0.01)))
            .cast("int")
            .alias("parts_out"),
        )
    )
    return rows.join(bands, "key").select(
        *rows.columns, (F.col("comp") != F.col("major")).alias("is_out"), "parts_all", "parts_out"
    )


def _dealt(rows: DataFrame, more: Sequence[str]) -> DataFrame:
    """Members of open bands, with the columns ``more``, dealt to sorted blocks.

    In each band the outsiders, the members outside its largest component, meet
    all members: what is in the largest component already isn't compared within.
    """
    shared = ["key", "node", "comp", "n_shingles", *more]
    rows = rows.withColumn("h", F.xxhash64("node", "key"))
    own_all = F.pmod(F.col("h"), F.col("parts_all")).cast("int")
    own_out = F.pmod(F.col("h"), F.col("parts_out")).cast("int")
    every = rows.select(
        *shared,
        F.lit(False).alias("outsider"),
        own_all.alias("part_all"),
        F.explode(F.sequence(F.lit(0), F.col("parts_out") - 1)).alias("part_out"),
    )
    out = rows.where("is_out").select(
        *shared,
        F.lit(True).alias("outsider"),
        F.explode(F.sequence(F.lit(0), F.col("parts_all") - 1)).alias("part_all"),
        own_out.alias("part_out"),
    )
    place = ["key", "part_all", "part_out"]
    return every.unionByName(out).repartition(*place).sortWithinPartitions(*place)


def _late_links(
    found: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int
) -> DataFrame:
    """Links between different components that share a band, enough to connect them.

    Registers, and then sets, are fetched for members of open bands only.
    """
    comp = F.coalesce(F.col("comp"), F.col("node")).alias("comp")
    slim = ["key", "node", "n_shingles"]
    rows = found.join(classes.select("node", "n_shingles"), "node").join(comps, "node", "left")
    rows = stored(rows.select(*slim, comp), "band-components")
    # in a band of two one is the hub: they have been compared
    open_rows = stored(_open_members(rows, 3), "open-members")
    wide = open_rows.join(classes.select("node", "registers"), "node")
    marked = _dealt(wide, ["registers"]).mapInArrow(tidy(_blocks(percent, False)), "key bigint, node binary")
    marked = stored(marked.distinct(), "marked-members")
    left = marked.join(rows, ["key", "node"])
    keys = classes.select("node", "row_key").join(marked.select("node").distinct(), "node")
    sets = _shingle_sets(docs, stored(keys, "wanted-texts"), shingle)
    left = stored(_open_members(left.select(*slim, "comp"), 2), "marked-in-open-bands")
    left = left.join(classes.select("node", "registers"), "node").join(sets, "node")
    links = _dealt(left, ["registers", "shingles"])
    return stored(links.mapInArrow(tidy(_blocks(percent, True)), "a binary, b binary"), "late-links")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    one_row: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles, component_id, kept``.

    Two documents are linked when their sets of ``shingle``-word shingles have
    a similarity of ``percent`` / 100 or more, and documents that links connect
    are a component, named by its smallest id. Only the document with that id
    is kept.

    Every shingle is hashed once; the first 7 bits name a bucket, and the least
    hash of a bucket becomes a register of leading zeros and 10 bits of
    mantissa. Equal shingle sets are one node from here on, however many rows
    have them. Bands of four registers bring candidates together. In a band
    nothing is paired with everything: each member is compared with the hub,
    the member with the largest bands overall. Where a band still holds
    several components after that, the members outside its largest one are
    compared with all others by their registers, in blocks of bounded size, and
    the blocks give back links that connect components, never all pairs; so no
    connection over a shared band is missed. Candidates whose estimate,
    corrected for registers equal by chance, is far below the threshold are
    rejected; all others are verified on the full sets.

    Whole texts are taken, however long; memory follows the longest one. An
    empty table gives an empty result. A null text, or one without words, has no
    shingles, is linked with nothing and kept. A null id takes part, but never names a component while there is
    another id; in a component of null ids all are kept. Rows that repeat an id
    are kept together. With ``one_row`` just one row of a component is kept in
    either case. Other columns of ``docs`` may have any name.
    """
    marked = _marked(docs, id_col, text_col, shingle, percent, one_row)
    return marked.drop("row_key", "in_company").withColumnRenamed("id", id_col)


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    one_row: bool = False,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`near_duplicates` keeps.

    Rows that surely stay, which a filter of bounded size tells in the scan, are
    not shuffled. Nulls, ties, repeated rows, long texts, clashing names and
    empty tables are as described there; with ``one_row`` rows that repeat an id
    and its text leave one.
    """
    marked = _marked(docs, id_col, text_col, shingle, percent, one_row)
    names: dict[str, str] = {}
    for name in ("row_key", "id", "own_key", "near"):
        names[name] = unused([*docs.columns, *names.values()], f"gone_{name}")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if one_row:
        # of rows that repeat an id and its text one may be kept and the others not
        texts = marked.where("in_company").groupBy("row_key", "id")
        texts = texts.agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
        gone = stored(texts.where("not kept or n > 1"), "near-copies")
    else:
        gone = stored(marked.where("not kept").select("row_key", "id", "kept").distinct(), "near-copies")
    hashed = docs.withColumn(names["own_key"], F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    near = maybe_among(hashed, names["own_key"], gone.select("row_key"), names["near"])
    may = near.where(F.col(names["near"]))
    same = (F.col(names["own_key"]) == F.col(names["row_key"])) & may[f"`{id_col}`"].eqNullSafe(
        F.col(names["id"])
    )
    keyed = gone.select("row_key", "id").withColumnsRenamed(names)
    result = near.where(~F.col(names["near"])).select(*columns)
    result = result.unionByName(may.join(keyed, same, "left_anti").select(*columns))
    tied = gone.where("kept").select("row_key", "id")
    if one_row and not tied.isEmpty():
        several = may.join(tied.withColumnsRenamed(names), same)
        result = result.unionByName(
            one_row_each(several, [names["row_key"], names["id"]]).select(*columns)
        )
    return result


def _marked(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, one_row: bool
) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("id", "text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, row_key bigint, n_shingles bigint, node binary, registers binary"
    sketches = rows.select("id", "row_key", "text")
    sketches = sketches.mapInArrow(tidy(_sketcher(shingle)), schema)
    sketches = stored(sketches.withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = stored(
        sketches.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("registers").alias("registers"),
            F.max("n_shingles").alias("n_shingles"),
            F.min("row_key").alias("row_key"),
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("least"),
            F.count("*").alias("n_rows"),
        ),
        "classes",
    )

    # the last bits of a key name its band
    band = f"xxhash64(b, substring(registers, b * {2 * BAND} + 1, {2 * BAND}))"
    key = f"({band} & {-BANDS}) | b"
    keys = F.expr(f"explode(transform(sequence(0, {BANDS - 1}), b -> {key}))")
    bands = classes.select("node", keys.alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = stored(bands.join(shared, "key"), "band-members")
    degree = found.groupBy("node").agg(F.sum("n").alias("degree"))
    members = found.join(degree, "node")
    hubs = members.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("hub"))
    spokes = (
        found.join(hubs, "key")
        .where(F.col("node") != F.col("hub"))
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .distinct()
    )
    links = _verified(spokes, rows, classes, shingle, percent)
    late = _late_links(found, components(links), classes, rows, shingle, percent)
    comps = components(links.union(late))

    joined = classes.join(comps, "node", "left").select(
        "node", "least", "n_rows", F.coalesce(F.col("comp"), F.col("node")).alias("comp")
    )
    least = joined.groupBy("comp").agg(
        F.min("least").alias("least_of_all"), F.sum("n_rows").alias("n")
    )
    # documents without company are left out of the join
    company = joined.join(least.where("n > 1"), "comp").select("node", "least_of_all")
    result = sketches.join(company, "node", "left")
    in_company = F.col("least_of_all").isNotNull()
    own = F.when(F.col("least_of_all.id").isNotNull(), F.col("least_of_all.id")).otherwise(F.col("id"))
    if one_row:
        kept = ~in_company | F.coalesce(F.col("row") == F.col("least_of_all.row"), F.lit(False))
    else:
        kept = F.col("id").eqNullSafe(own)
    return result.select(
        "id",
        "row_key",
        "n_shingles",
        own.alias("component_id"),
        kept.alias("kept"),
        in_company.alias("in_company"),
    )
