"""Near-duplicate detection by bottom-k sketches of word shingles, with exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm.arrow import slices
from textloom.llm.common import store, whole, with_ids
from textloom.llm.hashing import buffers, mix, sequence_hash, word_hashes, words
from textloom.session import BROADCAST_LIMIT

WIDTH = 5
SKETCH = 64
AGREE = 27  # of 64: fewer agree with a chance below 1e-8 if the similarity is 0.75
SMALL = 48  # sets below this size: partners at 0.75 have at most 64 members, so both sketches are complete


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct hashes, non-negative, of its runs of ``width`` words.

    A text with fewer words has one hash for all of them, a text without words none.
    """
    data, ends = buffers(texts)
    starts, stops = words(data, ends)
    if not len(starts):
        return [np.zeros(0, np.int64)] * (len(ends) - 1)
    h = word_hashes(data, starts, stops)
    cuts = np.searchsorted(starts, ends)
    full = sequence_hash(h, width) if len(h) >= width else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= width:
            found = full[a : b - width + 1]
        elif b > a:
            found = mix(sequence_hash(h[a:b], int(b - a)) + np.uint64(b - a))
        else:
            found = full[:0]
        out.append(np.unique((found >> np.uint64(1)).astype(np.int64)))
    return out


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        sets = shingle_sets(part.column("_text"))
        yield pa.RecordBatch.from_arrays(
            [
                part.column("_id"), part.column("_sum"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.binary()), _lists([s[:SKETCH] for s in sets]),
            ],
            ["_id", "_sum", "n", "key", "sketch"],
        )


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        sets = shingle_sets(part.column("_text"))
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), _lists(sets)], ["key", "members"])


def similar(n: str, m: str) -> Column:
    """Sizes that allow a similarity of 0.75."""
    return 4 * F.least(n, m) >= 3 * F.greatest(n, m)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as ``id_col, n_shingles, component_id, kept``; components link at a Jaccard similarity of 0.75.

    One hash function: the 64 smallest hashes of a text's five-word shingles are its sketch. Texts
    with the same shingle set become one class first. Inverted lists hold, per class, the rarest
    values of its sketch: as a linked pair agrees in 27 of the 64 values of the union sketch (all
    but one pair in 10^8), two linked classes share one of their 38 rarest. Each list compares its
    members with its smallest member: union sketches filter these pairs and the exact similarity of
    the whole sets decides. Where a list still spans several components, its classes are joined on
    their whole sets by prefix and position: first with the class of each list that shares most, then
    all that are still in different components. So copies of one text are not paired with each
    other, and a passage that many texts share yields no pairs.

    Words are runs of other bytes than ASCII white space, A-Z lowered; a text with one to four words
    is one shingle. Null texts count as empty; texts without words have no shingles and are their
    own component. ``component_id`` is the smallest identifier of the component. One row of a
    component is kept, that with the smallest identifier, nulls last; rows that repeat an identifier
    are told apart. An empty table gives an empty result. Other columns are not read. ``text_sum``,
    Spark's xxhash64 of the text, tells rows with the same identifier apart.
    """
    slim = with_ids(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = store(
        slim.withColumn("_sum", F.xxhash64("_text"))
        .mapInArrow(_sketched, f"_id {kind}, _sum bigint, n bigint, key binary, sketch array<bigint>")
        .withColumn("_row", F.monotonically_increasing_id()),
        "sketches",
    )
    classes = store(
        rows.filter("n > 0").groupBy("key").agg(F.min("_row").alias("rep"), F.min("_id").alias("_id")), "classes",
    )
    reps = store(
        rows.join(classes.select(F.col("rep").alias("_row")), "_row", "left_semi")
        .select(F.col("_row").alias("rep"), "n", "sketch"),
        "class-sketches",
    )
    lists = store(inverted_lists(reps), "inverted-lists")

    pivot = lists.groupBy("value").agg(F.min(F.struct("rep", "n")).alias("p"))
    first = (
        lists.join(pivot, "value").filter((F.col("p.rep") != F.col("rep")) & similar("n", "p.n"))
        .select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct()
    )
    first = store(first, "pairs")
    links = store(_linked(first, reps, classes, slim), "links")
    roots = components(links)

    sets = _sets(_crowded(lists, roots), classes, slim)
    prefixes = store(_prefixes(sets), "prefixes")
    for pairs in (_stars, _crossing):
        found = store(_exact(pairs(_rooted(prefixes, roots)), sets), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
    return _result(rows, classes, roots, id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns unchanged.

    Rows that repeat both identifier and text of a kept row stay with it; drop exact copies first.
    The dropped identifiers are broadcast if they are proven small, so that texts stay where they are.
    """
    found = store(near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("_id"), "text_sum", "kept"), "kept")
    drops = found.groupBy("_id", "text_sum").agg(F.max("kept").alias("kept")).filter("not kept").select("_id", "text_sum")
    drops = F.broadcast(drops) if drops.count() * 64 <= BROADCAST_LIMIT else drops
    same = docs[id_col].eqNullSafe(drops["_id"]) & (F.xxhash64(whole(text_col)) == drops["text_sum"])
    return docs.join(drops, same, "left_anti")


def inverted_lists(reps: DataFrame) -> DataFrame:
    """``value, rep, n``: the rarest values of each sketch that occur in another one as well."""
    values = reps.select("rep", "n", F.explode("sketch").alias("value"))
    counts = values.groupBy("value").count().filter("count > 1")
    shared = values.join(counts, "value")
    one = Window.partitionBy("rep")
    size = F.least("n", F.lit(SKETCH))
    agree = F.when(F.col("n") < SMALL, F.ceil(F.col("n") * 3 / 4)).otherwise(AGREE)
    rank = F.row_number().over(one.orderBy("count", "value")) + size - F.count("*").over(one)
    return shared.withColumn("rank", rank).filter(F.col("rank") <= size - agree + 1).select("value", "rep", "n")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    known = roots.select(F.col("node").alias("rep"), "root")
    return rows.join(known, "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _crowded(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes in lists that span several components."""
    rooted = _rooted(lists, roots)
    mixed = rooted.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return rooted.join(mixed.select("value"), "value", "left_semi").select("rep").distinct()


def _prefixes(sets: DataFrame) -> DataFrame:
    """``value, rep, n, rest``: the members of whole sets at which a pair may be due, rarest first.

    With sizes n and m a pair at 0.75 needs 3 (n + m) / 7 common members. ``rest`` counts a class's
    members from this one on, so the pair is due at its rarest common member only if both rests
    reach that.
    """
    values = sets.select("rep", F.size("members").cast("long").alias("n"), F.explode("members").alias("value"))
    counts = values.groupBy("value").count().filter("count > 1")
    one = Window.partitionBy("rep")
    at = F.col("n") - F.count("*").over(one) + F.row_number().over(one.orderBy("count", "value")) - 1
    due = values.join(counts, "value").withColumn("rest", F.col("n") - at).filter("4 * rest >= 3 * n")
    return due.select("value", "rep", "n", "rest")


def _sided(t: DataFrame, mark: str) -> DataFrame:
    return t.select("value", *[F.col(c).alias(c + mark) for c in t.columns if c != "value"])


def _due() -> Column:
    return 7 * F.least("rest_a", "rest_b") >= 3 * (F.col("n_a") + F.col("n_b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def _stars(members: DataFrame) -> DataFrame:
    """Pairs of each list's classes with the one that shares most, if in another component."""
    centre = members.groupBy("value").agg(F.max(F.struct("rest", -F.col("rep"), "rep", "root", "n")).alias("c"))
    centre = centre.select("value", *[F.col(f"c.{x}").alias(f"{x}_b") for x in ("rest", "rep", "root", "n")])
    met = _sided(members, "_a").join(centre, "value").filter((F.col("root_a") != F.col("root_b")) & _due() & similar("n_a", "n_b"))
    return _ordered(met)


def _crossing(members: DataFrame) -> DataFrame:
    """All pairs of different components that are due, by way of the pairs of components."""
    members = store(members, "prefixes")
    held = members.groupBy("value", "root").agg(F.min("n").alias("n"), F.max("rest").alias("rest"), F.count("*").alias("c"))
    # The side with fewer members is opened first, so that a large component meets single classes one by one.
    smaller = (F.col("c_a") < F.col("c_b")) | ((F.col("c_a") == F.col("c_b")) & (F.col("root_a") < F.col("root_b")))
    met = _sided(held, "_a").join(_sided(held, "_b"), "value").filter((F.col("root_a") != F.col("root_b")) & smaller & _due())
    both = (
        met.select("value", "root_a", "root_b").join(_sided(members, "_a"), ["value", "root_a"])
        .join(_sided(members, "_b"), ["value", "root_b"]).filter(_due() & similar("n_a", "n_b"))
    )
    return _ordered(both)


def _linked(pairs: DataFrame, reps: DataFrame, classes: DataFrame, slim: DataFrame) -> DataFrame:
    """The pairs with a similarity of 0.75: union sketches filter, whole sets decide."""
    side = lambda c, s: reps.select(F.col("rep").alias(c), F.col("sketch").alias(s))
    met = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    agree = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    likely = F.when(F.size(union) == SKETCH, agree >= AGREE).otherwise(4 * agree >= 3 * F.size(union))
    passed = store(met.filter(likely).select("a", "b"), "likely-pairs")
    nodes = passed.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    return _exact(passed, _sets(nodes, classes, slim))


def _sets(nodes: DataFrame, classes: DataFrame, slim: DataFrame) -> DataFrame:
    """``rep, members``: the whole shingle sets of the classes ``nodes``, from a second look at their texts.

    Identifiers proven to be small are broadcast, so that the other texts stay where they are.
    """
    wanted = store(classes.join(nodes, "rep", "left_semi"), "wanted")
    ids = wanted.select(F.col("_id").alias("wanted")).distinct()
    ids = F.broadcast(ids) if wanted.count() * 64 <= BROADCAST_LIMIT else ids
    texts = slim.join(ids, F.col("_id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = texts.mapInArrow(_whole_sets, "key binary, members array<bigint>").join(wanted.select("key", "rep"), "key")
    return store(sets.dropDuplicates(["rep"]).select("rep", "members"), "sets")


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    # ``a`` is often a pivot with many partners, so its set is joined last and travels once.
    one = pairs.join(sets.select(F.col("rep").alias("b"), F.col("members").alias("mb")), "b")
    two = one.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("ma")), "a")
    common = F.size(F.array_intersect("ma", "mb"))
    return two.filter(100 * common >= 75 * (F.size("ma") + F.size("mb") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``: alternating large and small stars until nothing changes."""
    edges = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store(small.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "stars")
        last, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select("v", "v").distinct())


def _result(rows: DataFrame, classes: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    named = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "key", F.coalesce("root", "rep").alias("root")
    )
    known = store(rows.select("_id", "_row", "_sum", "n", "key").join(named, "key", "left"), "rooted")
    alone = F.coalesce("root", "_row")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first")
    best = known.groupBy(alone.alias("root")).agg(first).select("root", "first.*")
    out = known.withColumn("root", alone).join(
        best.select("root", F.col("_id").alias("component_id"), F.col("_row").alias("_best")), "root"
    )
    return out.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        (F.col("_row") == F.col("_best")).alias("kept"), F.col("_sum").alias("text_sum"),
    )
