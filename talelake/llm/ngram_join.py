"""Jaccard join of documents on word n-grams by grouped prefix join.

1. Every document becomes its set of hashed shingles. One order of all shingles
   (those that are frequent in the corpus last, else by hash) gives each set its
   prefix: two sets that link share a shingle of their prefixes.
2. Documents with the same prefix and set size form one group, and only groups
   are listed under the shingles of their prefixes. Pairs of groups under one
   shingle pass the size and the position filter.
3. Pairs of small groups expand into pairs of members. Signatures (counts of the
   shingles by hash bucket) bound each pair's intersection from above, and what
   may link is verified exactly.
4. A shingle with many groups, or a group with many different sets, is dealt into
   units of about UNIT sets, so that no list and no group is gathered in one task.
   Pairs of units are verified exactly by products of incidence matrices, and
   return a spanning forest of their links and not their pairs.

Equal sets are one set from the start, so that copies cost nothing. Sets are
compared by 64-bit hashes of their shingles. Nulls, empty texts and texts
without words have the empty set, which links with nothing. Rows that share
doc_id and text are copies of each other. Extra columns are ignored.

The only thing that is broadcast is a table of 2**SLOTS half bytes: how frequent the
shingles of a slot are, as a power of two. It is as large for any input, takes in every
shingle that occurs OFTEN times or more, and decides about speed alone: any order that
all sets share gives the same links, also one in which rare shingles share a slot with
frequent ones. It is made in tasks, and comes to the driver as it is broadcast.

A document of any length is one set; sets are gathered in units of about UNIT sets and
ITEMS shingles at most, or of one set that is larger. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talelake.llm import textblocks as tb
from talelake.llm.common import components, cut, table

#: Slots of the table of frequencies (a power of two), its parts, and occurrences from which a shingle counts.
SLOTS, PART, OFTEN = 25, 15, 4
#: Shingles in a unit.
ITEMS = 1 << 18
#: Groups under one shingle up to which their pairs are listed, sets in a unit, and
#: pairs of members of two groups up to which they are listed.
SHORT, UNIT, FEW = 64, 256, 16


def _frequent(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Level of each slot: the power of two below the occurrences of its most frequent shingle, 0 below OFTEN, 15 at most.

    Shingles that a batch holds once are not counted there.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {len(s) and int(s[0]) ^ int(s[-1]) ^ len(s): s for s in tb.shingles(*tb.utf8(batch.column(0)), size)}
            if sum(map(len, sets.values())):
                found, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                found, n = found[n > 1].view(np.int64), n[n > 1]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["shingle", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            slot, level = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in np.unique(slot >> PART).tolist():
                own = slot >> PART == part
                parts.setdefault(part, np.zeros(1 << PART, np.uint8))[slot[own] & ((1 << PART) - 1)] = level[own]
        packed = [(x[::2] << 4 | x[1::2]).tobytes() for x in parts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array(packed, pa.binary())], ["part", "levels"])

    counts = docs.select(text).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    level = F.least(F.lit(15), F.floor(F.log2(F.col("n"))).cast("int")).cast("byte")
    slots = counts.select(F.shiftrightunsigned("shingle", 64 - SLOTS).alias("slot"), level.alias("level")).groupBy("slot").agg(F.max("level").alias("level"))
    dealt = slots.repartition(F.shiftright("slot", PART)).select("slot", "level")
    table = np.zeros(1 << SLOTS - 1, np.uint8)
    for row in dealt.mapInArrow(gather, "part long, levels binary").toLocalIterator():
        half = 1 << PART - 1
        table[row.part * half : (row.part + 1) * half] = np.frombuffer(row.levels, np.uint8)
    return table


def levels(table: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Level of each shingle by its slot in the packed table."""
    slot = (shingles >> np.uint64(64 - SLOTS)).astype(np.int64)
    packed = table[slot >> 1]
    return np.where(slot & 1, packed & 15, packed >> 4)


def _documents(docs: DataFrame, text: str, size: int, percent: int, frequent, keep_sets: bool) -> DataFrame:
    """rk, id, cls (the set's hash), gid (its prefix's), n and the prefix of each row, or else its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = tb.shingles(*tb.utf8(part.column(2)), size)
                lengths = np.array([len(s) for s in sets], np.int64)
                ends = np.cumsum(lengths)
                whole = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                sums = np.zeros(len(whole) + 1, np.uint64)
                np.cumsum(tb.mix(whole ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
                cls = tb.mix(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64)).view(np.int64)
                if keep_sets:
                    items = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(whole.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(cls), items, part.column(3)], ["cls", "items", "units"])
                    continue
                rank = levels(frequent.value, whole)
                prefixes, gid = [], []
                for s, end, n in zip(sets, ends.tolist(), lengths.tolist(), strict=True):
                    p = n + (-percent * n) // 100 + 1 if n else 0
                    prefix = s[np.argsort(rank[end - n : end], kind="stable")[:p]]
                    prefixes.append(prefix)
                    gid.append(np.bitwise_xor.reduce(tb.mix(prefix)) ^ np.uint64(n) if n else np.uint64(0))
                columns = [
                    part.column(0),
                    part.column(1),
                    pa.array(cls),
                    pa.array(tb.mix(np.array(gid, np.uint64)).view(np.int64)),
                    pa.array(lengths),
                    pa.array([x.view(np.int64) for x in prefixes], pa.list_(pa.int64())),
                    pa.array([signature(s) for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["rk", "id", "cls", "gid", "n", "prefix", "signature"])

    if keep_sets:
        return docs.select("rk", "id", text, "units").mapInArrow(run, "cls long, items array<long>, units array<struct<kind: int, key: long, block: int>>")
    return docs.select("rk", "id", text).mapInArrow(run, "rk long, id long, cls long, gid long, n long, prefix array<long>, signature binary")


def signature(items: np.ndarray) -> bytes:
    """How many items fall in each of 2**k buckets, about as many buckets as items; 4 bits each; empty if a count needs more."""
    k = max(6, int(len(items)).bit_length())
    counts = np.bincount((items >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return (counts[::2] << 4 | counts[1::2]).astype(np.uint8).tobytes() if counts.max(initial=0) < 16 else b""


def most_common(one: bytes, two: bytes) -> int | None:
    """Upper bound of the intersection of two sets, from their signatures; None if unknown."""
    if not one or not two:
        return None
    packed = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (one, two))
    a, b = sorted((np.stack((x >> 4, x & 15), 1).ravel() for x in packed), key=len)
    return int(np.minimum(a, b.reshape(len(a), -1).sum(1)).sum())


def _filter_signatures(pairs: DataFrame, seen: DataFrame, percent: int) -> DataFrame:
    """The pairs c1, c2 of sets that their signatures let link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = (batch.column(k).to_numpy() for k in (2, 4))
            one, two = (batch.column(k).to_pylist() for k in (3, 5))
            most = [most_common(x, y) for x, y in zip(one, two, strict=True)]
            keep = [m is None or (100 + percent) * m >= percent * (x + y) for m, x, y in zip(most, n1.tolist(), n2.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["c1", "c2"]).filter(pa.array(keep, pa.bool_()))

    used = pairs.select(F.col("c1").alias("cls")).union(pairs.select("c2")).distinct()
    known = cut(seen.join(used, "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("signature").alias("s")))
    one, two = (known.select(F.col("cls").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("s").alias(f"s{k}")) for k in (1, 2))
    return pairs.join(one, "c1").join(two, "c2").select("c1", "c2", "n1", "s1", "n2", "s2").mapInArrow(run, "c1 long, c2 long")


def _group_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """g1 < g2 for groups under one shingle that size and positions let link. lists: token, gid, n, pos."""
    one, two = (lists.select("token", *(F.col(c).alias(f"{c}{k}") for c in ("gid", "n", "pos"))) for k in (1, 2))
    size = 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")
    # at most the shingles before both places, and at and after both places, are common
    reach = F.least("pos1", "pos2") + F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"))
    fit = size & ((100 + percent) * reach >= percent * (F.col("n1") + F.col("n2")))
    pairs = one.join(two, (one["token"] == two["token"]) & (one["gid1"] < two["gid2"]) & fit)
    return pairs.select(F.col("gid1").alias("g1"), F.col("gid2").alias("g2")).distinct()


def forest(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as the bipartite links: each linked node and its smallest label."""
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    links, top = mask[np.ix_(rows, cols)], np.iinfo(np.int64).max
    a, b = left[rows].copy(), right[cols].copy()
    while True:
        new_a = np.minimum(a, np.where(links, b[None, :], top).min(1, initial=top))
        new_b = np.minimum(b, np.where(links, new_a[:, None], top).min(0, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            return np.concatenate((left[rows], right[cols])), np.concatenate((a, b))
        a, b = new_a, new_b


def common_items(one: list[np.ndarray], two: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of incidence matrices over the shared items."""
    shared = np.intersect1d(np.concatenate(one), np.concatenate(two))
    if len(one) == len(two) == 1:
        return np.array([[len(shared)]])
    found = np.zeros((len(one), len(two)), np.int64)

    def places(sets):
        at = [np.searchsorted(shared, s) for s in sets]
        return [x[(x < len(shared)) & (shared[np.minimum(x, len(shared) - 1)] == s)] for x, s in zip(at, sets, strict=True)]

    if not len(shared):
        return found
    a, b = places(one), places(two)
    for low in range(0, len(shared), columns):
        wide = min(columns, len(shared) - low)
        parts = []
        for sets in (a, b):
            m = np.zeros((len(sets), wide), np.float32)
            for k, x in enumerate(sets):
                m[k, x[np.searchsorted(x, low) : np.searchsorted(x, low + wide)] - low] = 1
            parts.append(m)
        found += (parts[0] @ parts[1].T).astype(np.int64)
    return found


def _families(in_lists: DataFrame) -> DataFrame:
    """token, cls of the long lists, with those that hold much the same sets made one.

    Near copies of one text meet under many shingles. Lists are put together by the
    set with the smallest hash that they hold, which is the same for most lists of
    the same copies; if that makes fewer pairs than the lists do one by one, they
    become one list under a key of its own. Every pair of a list is one of that, too.
    """
    by_hash = F.min(F.struct(F.xxhash64("cls").alias("h"), "cls"))
    lead = in_lists.groupBy("token").agg(by_hash.alias("lead"), F.count(F.lit(1)).alias("k")).select("token", F.xxhash64(F.lit("family"), "lead.cls").alias("family"), "k")
    placed = cut(in_lists.join(lead.select("token", "family"), "token"))
    apart = lead.groupBy("family").agg(F.sum(F.col("k").cast("double") ** 2).alias("apart"))
    sets = placed.select("family", "cls").distinct()
    joint = sets.groupBy("family").agg(F.count(F.lit(1)).alias("k")).join(apart, "family").where("cast(k as double) * k <= apart").select("family")
    joint = cut(joint)
    return placed.join(joint, "family", "left_anti").select("token", "cls").unionByName(sets.join(joint, "family", "left_semi").select(F.col("family").alias("token"), "cls"))


def _verify(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links of each pair of units (arrays of struct<cls, items>)."""

    def members(value) -> tuple[np.ndarray, list[np.ndarray]]:
        flat = value.values
        items = flat.field(1)
        return flat.field(0).to_numpy(), [items[k].values.to_numpy().view(np.uint64) for k in range(len(items))]  # ascending as unsigned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                (left, x), (right, y) = members(one), members(two)
                common = common_items(x, y)
                union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - common
                mask = (100 * common >= percent * union) & (left[:, None] != right[None, :])
                if mask.any():
                    node, label = forest(mask, left, right)
                    a.append(node)
                    b.append(label)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return pairs.select("one", "two").mapInArrow(run, "a long, b long")


def _row_components(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """rk (hash of id and text), id, n, component_id and comp (a key of the component; null if the row is alone) of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select(F.xxhash64("id", "text").alias("rk"), "id", "text")
    frequent = spark.sparkContext.broadcast(_frequent(rows, "text", size))

    seen = cut(_documents(rows, "text", size, percent, frequent, False))
    members = cut(seen.where("n > 0").groupBy("gid", "cls").agg(F.min(F.struct("rk", "id")).alias("row"), F.first("n").alias("n")))
    # u: units of a group or a list, by its sets and their shingles; never more than sets
    units_of = F.least(F.count(F.lit(1)), F.greatest(F.ceil(F.count(F.lit(1)) / UNIT), F.ceil(F.sum("n") / ITEMS))).cast("int").alias("u")
    groups = members.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), units_of)
    prefixes = seen.where("n > 0").groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    posted = prefixes.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    # one shuffle: the length of each list is counted where its groups meet
    lists = cut(posted.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("k > 1"))

    short = lists.where(f"k <= {SHORT}").select("token", "gid", "n", F.col("pos").cast("long").alias("pos"))
    sizes = [groups.select(F.col("gid").alias(f"g{k}"), F.col("m").alias(f"m{k}"), F.col("u").alias(f"u{k}")) for k in (1, 2)]
    near = cut(_group_pairs(short, percent).join(sizes[0], "g1").join(sizes[1], "g2"))

    # few members: their pairs, less those whose signatures rule a link out; a verified pair is two units of one set
    few = f"m1 * m2 <= {FEW}"
    one, two = (members.select(F.col("gid").alias(f"g{k}"), F.col("cls").alias(f"c{k}")) for k in (1, 2))
    inner = members.join(groups.where(f"m > 1 and m * m <= {FEW}"), "gid")
    inner = inner.select("gid", F.col("cls").alias("c1")).join(inner.select("gid", F.col("cls").alias("c2")), "gid").where("c1 < c2")
    listed_pairs = near.where(few).join(one, "g1").join(two, "g2").select("c1", "c2").unionByName(inner.select("c1", "c2"))
    alone = cut(_filter_signatures(cut(listed_pairs.distinct()), seen, percent))

    # many members: units are (kind, key, block); a group's or a list's sets are dealt into blocks by hash
    between = (
        near.where(f"not ({few})")
        .select(F.lit(0).alias("kind"), F.col("g1").alias("k1"), F.col("g2").alias("k2"), F.explode(F.sequence(F.lit(0), F.col("u1") - 1)).alias("b1"), "u2")
        .select("kind", "k1", "k2", "b1", F.explode(F.sequence(F.lit(0), F.col("u2") - 1)).alias("b2"))
    )

    def within(kind, sized):
        first = sized.select(F.lit(kind).alias("kind"), F.col("key").alias("k1"), F.col("key").alias("k2"), F.explode(F.sequence(F.lit(0), F.col("u") - 1)).alias("b1"), "u")
        return first.select("kind", "k1", "k2", "b1", F.explode(F.sequence(F.col("b1"), F.col("u") - 1)).alias("b2"))

    many = groups.where(f"m * m > {FEW}")
    in_lists = cut(lists.where(f"k > {SHORT}").select("token", "gid").join(members.select("gid", "cls"), "gid").select("token", "cls").distinct())
    in_lists = cut(_families(in_lists))
    long_lists = in_lists.join(members.select("cls", "n").distinct(), "cls").groupBy("token").agg(units_of)
    single = alone.select(F.lit(2).alias("kind"), F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.lit(0).alias("b1"), F.lit(0).alias("b2"))
    pairs = cut(
        between.unionByName(within(0, many.withColumnRenamed("gid", "key"))).unionByName(within(1, long_lists.withColumnRenamed("token", "key"))).unionByName(single)
    )

    def dealt(kind, dealt_rows, key):
        return dealt_rows.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.pmod(F.xxhash64("cls"), F.col("u")).cast("int").alias("block"), "cls")

    wide = near.where(f"not ({few})")
    in_groups = wide.select(F.col("g1").alias("gid")).union(wide.select("g2")).union(many.select("gid")).distinct()
    apart = alone.select(F.col("c1").alias("cls")).union(alone.select("c2")).distinct()
    belongs = (
        dealt(0, members.join(in_groups, "gid", "left_semi").join(groups, "gid"), "gid")
        .unionByName(dealt(1, in_lists.join(long_lists, "token"), "token"))
        .unionByName(apart.select(F.lit(2).alias("kind"), F.col("cls").alias("key"), F.lit(0).alias("block"), "cls"))
    )
    # a set's units travel with the row that it is made of, so that sets are shuffled once
    first_rows = members.groupBy("cls").agg(F.min("row").alias("row"))
    where = cut(belongs.groupBy("cls").agg(F.collect_list(F.struct("kind", "key", "block")).alias("units")).join(first_rows, "cls").select(F.col("row.rk").alias("_rk"), F.col("row.id").alias("_id"), "units"))
    # id and hash together name a row
    chosen = rows.join(where, (rows["rk"] == where["_rk"]) & rows["id"].eqNullSafe(where["_id"])).dropDuplicates(["rk", "id"])
    sets = _documents(chosen, "text", size, percent, None, True)
    units = sets.select("cls", "items", F.explode("units").alias("u")).groupBy("u.kind", "u.key", "u.block").agg(F.collect_list(F.struct("cls", "items")).alias("sets"))
    units = cut(units)
    left = units.select("kind", F.col("key").alias("k1"), F.col("block").alias("b1"), F.col("sets").alias("one"))
    right = units.select("kind", F.col("key").alias("k2"), F.col("block").alias("b2"), F.col("sets").alias("two"))
    links = _verify(pairs.join(left, ["kind", "k1", "b1"]).join(right, ["kind", "k2", "b2"]), percent)

    # the classes' components, by the smallest document id of each
    labels = components(links)
    ids = cut(seen.where("n > 0").groupBy("cls").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies")))
    labelled = ids.join(labels.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "low", "copies", F.coalesce("comp", "cls").alias("comp"), F.col("comp").isNotNull().alias("linked"))
    lowest = labelled.where("linked").groupBy("comp").agg(F.min("low").alias("least"))
    final = cut(labelled.where("linked or copies > 1").join(lowest, "comp", "left").select("cls", F.coalesce("least", "low").alias("component_id"), "comp"))
    found = seen.select("rk", "id", "n", "cls").where("n > 0").join(final, "cls", "left").select("rk", "id", "n", "component_id", "comp")
    found = found.unionByName(seen.where("n = 0").select("rk", "id", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("comp")))
    return found.withColumn("component_id", F.coalesce("component_id", "id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """id_col, n_shingles and component_id (smallest id reachable by links) of each row.

    Two rows link when 100 * intersection >= percent * union of their sets of
    distinct ``size``-word shingles.
    """
    found = _row_components(docs, id_col, text_col, size, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, less all but the smallest id of each component.

    Rows go by id and text, and those that share both stay or go together. A null
    id comes after all others; of different texts under one smallest id, one stays.
    """
    found = cut(_row_components(docs, id_col, text_col, size, percent).where("comp is not null").select("rk", "id", "component_id", "comp"))
    first = found.where("id <=> component_id").select("rk", "id", "comp")
    ties = first.groupBy("comp").agg(F.min("rk").alias("least"), F.max("rk").alias("most")).where("least < most").select("comp", "least")
    lost = first.join(ties, "comp").where("rk <> least").select("rk", "id")
    gone = cut(found.where("not (id <=> component_id)").select("rk", "id").unionByName(lost).select(F.col("rk").alias("_rk"), F.col("id").alias("_gone")).distinct())
    key = docs[id_col].cast("long")
    return docs.join(gone, (F.xxhash64(key, docs[text_col]) == gone["_rk"]) & key.eqNullSafe(gone["_gone"]), "left_anti")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a Jaccard similarity of 0.85 over 4-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))
