"""Jaccard self-join of documents on word n-grams: subsets for small sets, inverted lists for large ones.

Text is lower-cased in A-Z and cut into words at ASCII white space. A document's set holds its distinct shingles of
``SHINGLE`` words, as 64-bit hashes; with fewer words, the whole sequence as one; without words nothing. Two documents
are linked when ``100 * |A and B| >= 90 * |A or B|``; a component is what links reach, named by its smallest id. The
join is exact: every step below passes on each pair that can be linked.

1. Equal sets become one class. A set of ``n`` shingles linked to another one holds at most ``missing(n)`` shingles that
   no other class holds. How many classes hold a shingle is asked for a quarter of all shingles (by value): classes
   that have more than ``missing(n)`` lone ones in that quarter are alone. That leaves copies, more or less.
2. For the others all shingles are counted. Each set is put in order of falling rarity, lone shingles first.
3. Small sets, up to a boundary: two sets of sizes ``a`` and ``b`` are linked when they share a subset of the fixed size
   ``needed(a, b)``. Each set lists its subsets of that size for every size of partner, by what it leaves out: lone
   shingles always, and further ones in all ways. Equal subsets meet by key; a star of links stands for a key.
4. Large sets: two linked sets share one of their ``missing(n) + 1`` rarest shingles. These go to inverted lists, cut by
   bands of size. A list's member with the fewest rarer shingles is its pivot; all others that sizes and places
   admit are compared with the pivot. Lists that now lie in one component are done. In the rest, members outside
   the list's largest component are compared with all that are in other components. No pair within a component is formed.
5. The boundary is the size at which listing subsets, counted exactly, costs more than scanning lists does.
6. All pairs are confirmed on whole sets; components of the links are written back to classes and documents.

Counting goes by chunks: a chunk sends its distinct shingles, dealt by value, and hears which of them others
hold too, so a shingle of all documents is one number per chunk.

Defined results: null or wordless text has size 0 and links with nothing. Rows without an id keep their size, are
linked with nothing and have no component. Rows that repeat an id with another text are nodes of their own that share the
id. Repeated rows share a class. An empty table gives an empty one. Other columns do not matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptledger.llm.arrow import with_columns
from apptledger.llm.components import components
from apptledger.llm.neardup import checked_broadcast, digest, shingles
from apptledger.operators.joins import BROADCAST_LIMIT_CONF, rows_per_key, spread_join
from apptledger.session import materialized

SHINGLE = 3
PERCENT = 90
#: Smaller sets are linked with equal ones only.
LEAST = next(n for n in range(1, 1000) if 100 * n >= PERCENT * (n + 1))
#: One shingle in so many is counted first.
SAMPLED = 4
#: Shingles of a chunk, and of the values that one task counts.
CHUNK, PART = 1 << 19, 1 << 21
#: Sizes up to which subsets are considered.
SMALL = 64

SKETCH = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("class", T.BinaryType()),
    T.StructField("sample", T.ArrayType(T.LongType()))])
ANSWERS = "chunk long, found array<long>, codes array<int>"


def needed(a: int, b: int) -> int:
    """The least intersection of linked sets of sizes ``a`` and ``b``."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def missing(n: int) -> int:
    """How many shingles of a set of ``n`` a linked one may lack."""
    return n - -(-PERCENT * n // 100)


def partners(n: int) -> range:
    """Sizes that a set linked to one of ``n`` may have."""
    return range(-(-PERCENT * n // 100), 100 * n // PERCENT + 1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.sort(shingles(text, SHINGLE).view(np.int64))


def sketched(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the size and digest of each set, and the sampled shingles of sets that may have a partner."""

    def make():
        def compute(texts: pa.Array) -> list[list]:
            sizes, classes, samples = [], [], []
            for value in texts:
                found = shingle_set(value.as_py())
                sizes.append(len(found))
                classes.append(digest(found) if len(found) else None)
                samples.append(found[found % SAMPLED == 0] if len(found) >= LEAST else None)
            return [sizes, classes, samples]

        return compute

    return with_columns(df, text, SKETCH, make)


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The rows of an Arrow list column as arrays."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def chunk_ids(classes: list[bytes], sizes: list[int]) -> list[int]:
    """A number for each row; rows in a row share it while they hold no more than CHUNK shingles."""
    ids, held, own = [], 0, 0
    for name, size in zip(classes, sizes, strict=True):
        if not ids or held + size > CHUNK:
            held, own = 0, int.from_bytes(name[:8], "little", signed=True)
        held += size
        ids.append(own)
    return ids


def with_chunks(sets: DataFrame) -> DataFrame:
    """``sets`` (class, shingles, ...) with ``chunk``."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), *sets.schema.fields])
    at, shingles_at = sets.columns.index("class"), sets.columns.index("shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = chunk_ids(batch.column(at).to_pylist(), batch.column(shingles_at).value_lengths().to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *batch.columns], names=schema.fieldNames())

    return sets.mapInArrow(run, schema)


def held_elsewhere(sets: DataFrame) -> DataFrame:
    """Per chunk the shingles that more than one set holds, each with a code that grows with their number."""
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    parts = max(-(-total // PART), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, found = batch.column(0).to_numpy(), rows_of(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                values, counts = np.unique(np.concatenate(found[start:end]), return_counts=True)
                part = ((values >> 8) & 0xFFFFFFFF) * parts >> 32
                order = np.argsort(part, kind="stable")
                numbers, at = np.unique(part[order], return_index=True)
                ends = np.append(at, len(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, pa.int64()), pa.array(np.full(len(numbers), chunk[start]), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order])),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts[order].astype(np.int32)))],
                    names=["part", "chunk", "found", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        found, counts = (table.column(c).chunk(0) for c in ("found", "counts"))
        flat = found.flatten().to_numpy()
        values, place = np.unique(flat, return_inverse=True)
        number = np.bincount(place, weights=counts.flatten().to_numpy(), minlength=len(values))
        codes = np.where(number > 1, 1 + np.minimum(16 * np.log2(np.maximum(number, 2) / 2), 254), 0).astype(np.int32)[place]
        several = codes > 0
        ends = np.concatenate([[0], np.cumsum(several)])[np.append(0, np.cumsum(found.value_lengths().to_numpy()))]
        return pa.table({"chunk": table.column("chunk"),
                         "found": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[several])),
                         "codes": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes[several]))})

    asked = sets.select("chunk", "shingles").mapInArrow(ask, "part long, chunk long, found array<long>, counts array<int>")
    return asked.groupBy("part").applyInArrow(answer, ANSWERS)


def coded(sets: pa.Table, answers: pa.Table) -> list[np.ndarray]:
    """For each set of a chunk the codes of its shingles; 0 for lone ones."""
    found = [r for c in answers.column("found").chunks for r in rows_of(c)] or [np.zeros(0, np.int64)]
    codes = [r for c in answers.column("codes").chunks for r in rows_of(c)] or [np.zeros(0, np.int32)]
    values, codes = np.concatenate(found), np.concatenate(codes)
    order = np.argsort(values, kind="stable")
    values, codes = values[order], codes[order]
    result = []
    for own in [r for c in sets.column("shingles").chunks for r in rows_of(c)]:
        if not len(values):
            result.append(np.zeros(len(own), np.int32))
            continue
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        result.append(np.where(values[at] == own, codes[at], 0))
    return result


def not_alone(classes: DataFrame) -> DataFrame:
    """Of ``classes`` (class, member, n, shingles: the sampled ones) those that may have a partner."""
    sets = materialized(with_chunks(classes), "samples")

    def keep(own: pa.Table, answers: pa.Table) -> pa.Table:
        lone = [int((codes == 0).sum()) for codes in coded(own, answers)]
        kept = [alone <= missing(n) for alone, n in zip(lone, own.column("n").to_pylist(), strict=True)]
        return own.select(["class", "member", "n"]).filter(pa.array(kept, pa.bool_()))

    return sets.groupBy("chunk").cogroup(held_elsewhere(sets).groupBy("chunk")).applyInArrow(
        keep, sets.select("class", "member", "n").schema)


def sets_of(texts: DataFrame) -> DataFrame:
    """(chunk, class, n, shingles) of texts, equal ones of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            made = {digest(s): s for s in (shingle_set(v.as_py()) for v in batch.column(0)) if len(s) >= LEAST}
            made = {name: own for name, own in made.items() if name not in seen}
            seen.update(made)
            sizes = [len(s) for s in made.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk_ids(list(made), sizes), pa.int64()), pa.array(list(made), pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(list(made.values()), pa.list_(pa.int64()))], names=["chunk", "class", "n", "shingles"])

    return texts.mapInArrow(run, "chunk long, class binary, n long, shingles array<long>")


def left_out(n: int, lone: int) -> Iterator[tuple[int, int]]:
    """(size of partner, further shingles that a subset leaves out) for a set with ``lone`` lone shingles."""
    for size in partners(n):
        fixed = needed(n, size)
        if fixed <= min(n, size) and n - fixed >= lone:
            yield size, n - fixed - lone


def by_rarity(sets: DataFrame) -> DataFrame:
    """Sets that may have a partner, their shingles in order of rarity: ``lone`` ones only as a number, of the
    others those that lists or subsets need; and what subsets or lists would cost."""

    def order(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        shingle_rows = [r for c in own.column("shingles").chunks for r in rows_of(c)]
        names, sizes = own.column("class").to_pylist(), own.column("n").to_pylist()
        for name, n, held, codes in zip(names, sizes, shingle_rows, coded(own, answers), strict=True):
            lone = int((codes == 0).sum())
            if lone > missing(n):
                continue
            ranked = np.lexsort((held, codes))[lone:]
            first = ranked[:missing(n) + 1 - lone]
            subsets = float(sum(math.comb(n - lone, k) for _, k in left_out(n, lone))) if n <= SMALL else math.inf
            rows.append((name, n, lone, held[ranked if n <= SMALL else first], subsets, float((2 ** (codes[first] / 16)).sum())))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                        names=["class", "n", "lone", "ranked", "subset_cost", "list_cost"])

    return sets.groupBy("chunk").cogroup(held_elsewhere(sets).groupBy("chunk")).applyInArrow(
        order, "class binary, n long, lone long, ranked array<long>, subset_cost double, list_cost double")


def boundary(ordered: DataFrame) -> int:
    """The greatest size whose sets list subsets: all costs together are least there."""
    sizes = ordered.where(F.col("n") <= SMALL).groupBy("n").agg(F.sum("subset_cost").alias("s"), F.sum("list_cost").alias("l"))
    costs = {r["n"]: (r["s"], r["l"]) for r in sizes.collect()}
    return min(range(LEAST - 1, SMALL + 1), key=lambda x: sum(s if n <= x else lists for n, (s, lists) in costs.items()))


def subset_rows(made: list[tuple[bytes, int, int, np.ndarray]]) -> pa.RecordBatch:
    names, sizes, others, keys = zip(*made, strict=True)
    counts = [len(k) for k in keys]
    n, m = np.repeat(sizes, counts), np.repeat(others, counts)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(n, m), pa.int64()), pa.array(np.maximum(n, m), pa.int64()), pa.array(np.concatenate(keys)),
         pa.array(list(names), pa.binary()).take(pa.array(np.repeat(np.arange(len(names)), counts))), pa.array(n <= m), pa.array(n >= m)],
        names=["low", "high", "subset", "class", "is_low", "is_high"])


def subset_stars(ordered: DataFrame, most: int) -> DataFrame:
    """Links (a, b) between sets of at most ``most`` shingles that share a subset of the size needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, lone = (batch.column(i).to_pylist() for i in range(3))
            made: list[tuple[bytes, int, int, np.ndarray]] = []
            waiting = 0
            for name, n, alone, held in zip(names, sizes, lone, rows_of(batch.column(3)), strict=True):
                for size, more in left_out(n, alone):
                    ways = math.comb(len(held), more)
                    if size > most or not ways:
                        continue
                    out = np.array(list(itertools.combinations(held, more)), np.int64).reshape(ways, more)
                    made.append((name, n, size, held.sum(dtype=np.int64) - out.sum(axis=1, dtype=np.int64)))
                    waiting += ways
                if waiting > CHUNK:
                    yield subset_rows(made)
                    made, waiting = [], 0
            if made:
                yield subset_rows(made)

    small = ordered.where(F.col("n") <= most).select("class", "n", "lone", "ranked")
    keys = materialized(small.mapInArrow(
        run, "low long, high long, subset long, class binary, is_low boolean, is_high boolean"), "subsets")
    on = ["low", "high", "subset"]
    pivots = keys.groupBy(*on).agg(
        F.min(F.when(F.col("is_low"), F.col("class"))).alias("low_pivot"),
        F.min(F.when(F.col("is_high"), F.col("class"))).alias("high_pivot"), F.count(F.lit(1)).alias("_rows"),
    ).where("_rows > 1 and low_pivot is not null and high_pivot is not null")
    met = spread_join(keys, pivots.drop("_rows"), on, spread_by=["class"], counts=pivots.select(*on, "_rows"))
    # Each side hangs on the other side's pivot, so the two stars are one.
    return met.select(F.col("class").alias("a"), F.when(F.col("is_low"), F.col("high_pivot")).otherwise(F.col("low_pivot")).alias("b")).union(
        met.where("is_low and is_high").select("class", "low_pivot"))


def may_link(left: str, right: str, most: int) -> Column:
    """Sizes and places of a shared shingle admit a link, and not both sets are small."""
    n, m, i, j = (F.col(f"{side}.{name}") for name in ("n", "at") for side in (left, right))
    fixed = F.ceil(F.lit(PERCENT) * (n + m) / F.lit(100 + PERCENT))
    return (
        (F.col(f"{left}.class") != F.col(f"{right}.class")) & (F.greatest(n, m) > most) & (F.least(n - i, m - j) >= fixed)
        & (F.col(f"{left}.home") | F.col(f"{right}.home")))


def inverted_lists(ordered: DataFrame, most: int) -> DataFrame:
    """(shingle, band, class, n, at, home): large sets, and small ones that a large one may need, by rare shingles.

    Linked sets lie in one band of sizes or in neighbouring ones, so each set is a guest in the next band."""
    allowed = F.col("n") - F.ceil(F.lit(PERCENT) * F.col("n") / F.lit(100)) + 1 - F.col("lone")
    band = F.floor(F.log("n") / F.lit(math.log(100 / (PERCENT - 1)))).cast("int")
    listed = ordered.where(F.col("n") >= -(-PERCENT * (most + 1) // 100)).select(
        "class", "n", "lone", F.posexplode(F.slice("ranked", F.lit(1), allowed.cast("int"))).alias("at", "shingle"),
        band.alias("own"))
    return listed.select(
        "shingle", "class", "n", (F.col("lone") + F.col("at")).alias("at"), "own",
        F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("band"),
    ).select("shingle", "band", "class", "n", "at", (F.col("own") == F.col("band")).alias("home"))


def pivot_pairs(lists: DataFrame, most: int) -> DataFrame:
    """(a, b): members of a list with its pivot, where a link is possible."""
    on = ["shingle", "band"]
    lead = F.struct("at", "class", "n", "home")
    pivots = lists.groupBy(*on).agg(F.min(F.when(F.col("home"), lead)).alias("pivot"), F.count(F.lit(1)).alias("_rows")).where(
        "_rows > 1 and pivot is not null")
    member = F.struct("class", "n", "at", "home")
    met = spread_join(lists.select(*on, member.alias("own"), F.col("class").alias("_id")), pivots.drop("_rows"), on,
                      spread_by=["_id"], counts=pivots.select(*on, "_rows"))
    return met.where(may_link("own", "pivot", most)).select(F.col("own.class").alias("a"), F.col("pivot.class").alias("b"))


def other_pairs(lists: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(a, b): members of a list that lie in different components, where a link is possible."""
    on = ["shingle", "band"]
    rooted = lists.join(roots, lists["class"] == roots["node"], "left").withColumn("root", F.coalesce("root", "class")).drop("node")
    sizes = rooted.groupBy(*on, "root").count()
    mixed = sizes.groupBy(*on).agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.sum("count").alias("_rows"),
                                   F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    member = F.struct("class", "n", "at", "home", "root")
    met = materialized(spread_join(
        rooted.select(*on, member.alias("own"), F.col("class").alias("_id")), mixed.drop("_rows"), on, spread_by=["_id"],
        counts=mixed.select(*on, "_rows")).select(*on, "own", (F.col("own.root") == F.col("largest")).alias("central")), "mixed")
    outer = met.where("not central").select(*on, F.col("own").alias("left"))
    pairs = outer.join(met.select(*on, F.col("own").alias("right"), "central"), on).where(may_link("left", "right", most))
    pairs = pairs.where("left.root <> right.root and (central or left.class < right.class)")
    return pairs.select(F.col("left.class").alias("a"), F.col("right.class").alias("b"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) whose whole sets are linked."""
    pairs = materialized(pairs.where("a <> b").distinct(), "pairs")
    held = sets.select("class", F.col("shingles"))
    left = held.join(checked_broadcast(pairs), held["class"] == pairs["a"]).select("a", "b", F.col("shingles").alias("left"))
    second = held.join(checked_broadcast(pairs.select("b").distinct()), held["class"] == F.col("b"), "left_semi").select(
        F.col("class").alias("b"), F.col("shingles").alias("right"))
    limit = int(sets.sparkSession.conf.get(BROADCAST_LIMIT_CONF, str(32 << 20)))
    if (second.agg(F.sum(F.size("right") * 8 + 100)).first()[0] or 0) <= limit:
        both = left.join(F.broadcast(second), "b")
    else:
        both = spread_join(left, second, ["b"], spread_by=["a"], counts=rows_per_key(pairs, ["b"]))
    shared = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - shared
    return both.where(100 * shared >= PERCENT * union).select("a", "b").distinct()


def links(docs: DataFrame, sketches: DataFrame, id_column: str, text: str) -> DataFrame:
    """(a, b) class digests, enough of them to connect every component of classes."""
    classes = sketches.where(F.col("sample").isNotNull() & F.col(f"`{id_column}`").isNotNull()).groupBy("class").agg(
        F.min(id_column).alias("member"), F.any_value("n_shingles").alias("n"), F.any_value("sample").alias("shingles"))
    wanted = materialized(not_alone(classes), "not-alone")
    members = checked_broadcast(wanted.select(F.col("member").alias(id_column)).distinct())
    sets = materialized(sets_of(docs.join(members, id_column, "left_semi").select(F.col(f"`{text}`").alias("text"))), "sets")
    ordered = materialized(by_rarity(sets), "ordered")
    most = boundary(ordered)
    lists = materialized(inverted_lists(ordered, most), "lists")
    found = materialized(confirmed(subset_stars(ordered, most).union(pivot_pairs(lists, most)), sets), "links")
    roots = materialized(components(found), "roots")
    return found.union(confirmed(other_pairs(lists, roots, most), sets))


def linked_documents(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, ``n_shingles`` and ``component_id``."""
    docs = df.select(df[f"`{id_column}`"], df[f"`{text}`"])
    sketches = materialized(sketched(docs, text).drop(text), "sketches")
    roots = materialized(components(links(docs, sketches, id_column, text)), "roots")
    rows = sketches.select(id_column, "n_shingles", "class")
    # Of each class its smallest id; of classes in a component the smallest of all.
    classes = materialized(rows.where(f"class is not null and `{id_column}` is not null").groupBy("class").agg(
        F.min(id_column).alias("member"), F.count(F.lit(1)).alias("_rows")), "classes")
    named = classes.join(roots, classes["class"] == roots["node"]).select("class", "member", "root")
    names = named.groupBy("root").agg(F.min("member").alias("name"))
    renamed = named.join(names, "root").select("class", "name")
    members = classes.join(renamed, "class", "left").select("class", F.coalesce("name", "member").alias("component_id"))
    joined = spread_join(rows, members, ["class"], "left", spread_by=[id_column], counts=classes.select("class", "_rows"))
    own = F.col(f"`{id_column}`")
    return joined.select(own, "n_shingles", F.when(own.isNotNull(), F.coalesce("component_id", own)).alias("component_id"))
