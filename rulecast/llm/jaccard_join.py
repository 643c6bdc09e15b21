"""N-gram Jaccard join: T-occurrence search with DivideSkip, and its link components.

Documents with equal shingle sets are one class, represented by its smallest doc_id. Sets
of sizes n and m link (p * |union| <= q * |intersection|, similarity p/q) only with at
least T shared shingles, so of each set's inverted lists the longest T-1 are skipped: the
pair must meet in the others, the short ones. Spark groups the short lists by shingle.

* Lists of up to ``LIST_SIZE`` classes give candidate pairs. A class and its candidates are
  a block (pairs whose two sides have the same smallest candidate meet there anyway). In a
  block, for each set, its short lists are heap-merged and the skipped long ones are probed
  by binary search (DivideSkip).
* A longer list (a large group of near copies, or a very common passage) gets a centre, the
  shingles of most of a few members, and each member's difference to it. |x ^ y| = |dx| + |dy| -
  2 |dx & dy|, so with w(x) = (p+q)|dx| - (q-p)|x| two members link exactly if they share
  at least (w(x) + w(y)) / (2(p+q)) differences. Members for which this is at most 0 with
  the member of least w link with it at once. The others must share differences: again
  short inverted lists, of the differences within the group. This repeats until no list
  is long. It ends: what most members looked at have is in the centre, so no list of
  differences holds them all, and every group is smaller than the one it came from.

So no pair is lost, no list is cut, and a group of n near copies makes about n rows. At the
first level lists are split by size bands, and prefixes are a few tokens longer than they
must be: a pair then meets in as many short lists (SPARE), which drops chance encounters.

Lists are ordered by frequency, as counted over all texts in ``CELLS`` cells of hashes (shingles
of one cell count together), then by hash. The order has no influence on the result.

Edges: texts without words (or null) have no shingles and are alone; of fewer words than a
shingle, the whole sequence is one. Rows that share a doc_id are one document: their
links are united, and its n_shingles is that of each row. Null ids join the component of
their copies but represent nothing. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, HASHES, ascii_words, keep_ids, shingles, small_batches, stored, stored_alone
from .components import connected_components

LIST_SIZE = 16
SPARE = 4  # short lists in which a pair must meet, if its sets are large enough
CELLS = 1 << 23  # bytes: the frequencies that all tasks know, by hash
SLICE = 1 << 16

BLOCK_SIZE = 1000  # classes that DivideSkip takes in one block,
BLOCK_TOKENS = 1_000_000  # and their shingles; larger groups get a centre first
LOOKED = 8  # members of a long list that give its centre
FILTER_BITS = 1 << 26  # of the table that says which lists have several members (8 MB)
LISTS_SENT = 300_000  # rows of list sizes that may be broadcast
OWN_IDS = 1 << 62  # from here on, a name for each further text of a doc_id


def text_shingles(text: str | None, k: int) -> np.ndarray:
    return shingles(HASHES.of(ascii_words(text)), k)


# -- order of the lists ----------------------------------------------------


def shingle_levels(docs: DataFrame, k: int, cells: int = CELLS) -> np.ndarray:
    """How often shingles occur, in ``cells`` cells of hashes: 8 * log2(1 + texts) in a byte.
    A task counts all its texts in a table of fixed size, tables are added up slice by slice."""
    width = min(cells, SLICE)

    def count(batches):
        table = np.zeros(cells, np.uint32)
        for batch in batches:
            held = [text_shingles(text, k) for text in batch.column(0).to_pylist()]
            if held:
                np.add.at(table, np.concatenate(held) & (cells - 1), np.uint32(1))
        if table.any():
            parts = [pa.compress(part.tobytes(), "zstd", asbytes=True) for part in table.reshape(-1, width)]
            for i in range(0, len(parts), 16):
                yield pa.RecordBatch.from_arrays([pa.array([*range(i, i + len(parts[i:i + 16]))], pa.int32()), pa.array(parts[i:i + 16], pa.binary())],
                                                 names=["slice", "counts"])

    def add(batches):
        now, total = None, None
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != now:
                    if now is not None:
                        yield level(now, total)
                    now, total = number, np.zeros(width, np.int64)
                total += np.frombuffer(pa.decompress(packed, 4 * width, "zstd", asbytes=True), np.uint32)
        if now is not None:
            yield level(now, total)

    def level(number, total):
        levels = np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["slice", "levels"])

    counted = docs.selectExpr("cast(text AS string) text").mapInArrow(count, "slice int, counts binary")
    summed = counted.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, levels binary")
    levels = np.zeros(cells, np.uint8)
    for row in summed.toLocalIterator():  # ``cells`` bytes in all, whatever the corpus
        levels[row["slice"] * width:(row["slice"] + 1) * width] = np.frombuffer(row["levels"], np.uint8)
    return levels


def in_list_order(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """``tokens`` (sorted) with those of rare lists first."""
    return tokens[np.argsort(levels[tokens & (len(levels) - 1)], kind="stable")]


# -- one block: DivideSkip ---------------------------------------------------


def divide_skip(ids: list[int], sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Links among the sets of one block, without those that follow from others: for each
    set the lists of its tokens are divided, the short ones heap-merged and the long ones
    probed for every candidate; sets already connected are not compared again."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
    tokens, place, sizes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(order)), [len(sets[i]) for i in order])
    by_token = np.argsort(place, kind="stable")
    starts = np.r_[0, np.cumsum(sizes)]
    postings = owner[by_token]
    root = [*range(len(order))]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links, begin = [], 0
    for x, i in enumerate(order):
        mine, n = sets[i], len(sets[i])
        lists = place[begin:begin + n]
        begin += n
        least = -(-p * n // q)  # T for the smallest partner; partners here are not larger
        by_length = np.argsort(sizes[lists], kind="stable")
        long = mine[by_length[n - least + 1:]] if least > 1 else mine[:0]
        short = [postings[starts[t]:starts[t + 1]].tolist() for t in lists[by_length[:n - least + 1]] if sizes[t] > 1]
        for y, run in groupby(heapq.merge(*short)):
            if y >= x:
                break
            other = sets[order[y]]
            if q * len(other) < p * n or find(x) == find(y):
                continue
            shared = sum(1 for _ in run)
            at = np.minimum(np.searchsorted(other, long), len(other) - 1)
            shared += int((other[at] == long).sum())
            if q * shared >= p * (n + len(other) - shared):
                root[find(x)] = find(y)
                if ids[i] != ids[order[y]]:
                    links.append((ids[i], ids[order[y]]))
    return links


def per_block(members: DataFrame, sets: DataFrame, work, schema: str) -> DataFrame:
    """``work(block, ids, token sets)`` -> result columns, for each block of ``members``
    (block, id) with ``sets`` (id, tokens). Blocks are small; sorted rows are streamed."""
    rows = members.join(sets, "id").select("block", "id", "tokens")
    rows = rows.repartition("block").sortWithinPartitions("block")

    def run(batches):
        block, ids, held = None, [], []
        for batch in batches:
            blocks, names, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            done = []
            for i, name in enumerate(blocks):
                if name != block:
                    if ids:
                        done.append(work(block, ids, held))
                    block, ids, held = name, [], []
                ids.append(names[i])
                held.append(values[offsets[i]:offsets[i + 1]].copy())
            if done:
                yield table(done)
        if ids:
            yield table([work(block, ids, held)])

    def table(done):
        columns = [[x for part in done for x in part[c]] for c in (0, 1)]
        kind = pa.list_(pa.int64()) if "array" in schema else pa.int64()
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], kind)], names=names)

    return rows.mapInArrow(run, schema)


def search_blocks(members: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Links (a, b) within blocks."""

    def work(_, ids, held):
        found = divide_skip(ids, held, p, q) if len(ids) > 1 else []
        return [x for x, _ in found], [y for _, y in found]

    return per_block(members, sets, work, "a bigint, b bigint")


def centres(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """gid, lead: the tokens that at least half of about LOOKED members have (the member of
    smallest id is always looked at)."""
    sizes = groups.groupBy("gid").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    draw = F.pmod(F.xxhash64("id", "gid"), F.lit(1_000_000)) * F.col("size") < 1_000_000 * LOOKED
    some = groups.join(sizes, "gid").where(draw | (F.col("id") == F.col("first"))).select(F.col("gid").alias("block"), "id")

    def work(block, ids, held):
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        return [block], [tokens[2 * counts >= len(held)]]

    return per_block(some, sets, work, "gid bigint, lead array<bigint>")


# -- short lists -------------------------------------------------------------


def in_some_list(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """key, id, about of each token in ``rows`` (mask, id, about, prefix) that may be the key of
    one of ``lists``, by a table of FILTER_BITS bits that all tasks know. Most tokens occur
    once and need not be shuffled; a wrong hit costs a row, the join with the lists is exact."""
    place = F.expr(f"key & {FILTER_BITS - 1}L")
    words = lists.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 AS int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = lists.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            mask, ids, about = (batch.column(c).to_numpy() for c in range(3))
            prefix = batch.column(3)
            offsets = prefix.offsets.to_numpy()
            owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
            keys = prefix.values.to_numpy()[offsets[0]:offsets[-1]] ^ mask[owner]
            some = shared.value[(keys & (FILTER_BITS - 1)) >> 6] >> (keys & 63) & 1 == 1
            owner = owner[some]
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(ids[owner]), pa.array(about[owner])], names=["key", "id", "about"])

    return rows.select("mask", "id", "about", "prefix").mapInArrow(run, "key bigint, id bigint, about bigint")


def short_lists(rows: DataFrame, p: int, q: int, first: bool) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (gid, id, n, least, open, component, prefix): candidate pairs (a, b) that
    meet in enough lists of up to LIST_SIZE classes, and members (gid, id, n) of longer lists.
    At the ``first`` level lists with the same smallest id are one group, later lists with
    the same members. A pair that meets in a longer list is searched there. Lists without an
    open member, or of one component, have nothing to find."""
    about = F.expr("shiftleft(n, 8) + least * 2 + cast(open AS int)").alias("about")
    rows = rows.select(F.xxhash64("gid").alias("mask"), "id", about, "component", "prefix")
    each = rows.select(F.explode("prefix").alias("token"), "mask", "id", "about", "component").select(
        F.expr("token ^ mask").alias("key"), "id", "about", "component")
    lists = stored(each.groupBy("key").agg(F.count("*").alias("size"), (
        F.min("id") if first else F.xxhash64(F.count("*"), F.min("id"), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64("id", F.lit(1))))).alias("group"), F.max(F.col("about") % 2).alias("some"),
                     F.min("component").alias("lo"), F.max("component").alias("hi"))
                   .where("size > 1 AND some = 1 AND lo < hi").drop("some", "lo", "hi"), "lists")
    met = stored(in_some_list(rows, lists).join(F.broadcast(lists) if lists.count() <= LISTS_SENT else lists, "key"), "met")
    long = met.where(F.col("size") > LIST_SIZE).select(
        F.col("group").alias("gid"), "id", F.expr("shiftright(about, 8)").alias("n")).distinct()
    short = met.where(F.col("size") <= LIST_SIZE).groupBy("key").agg(F.collect_set(F.struct("id", "about")).alias("xs"))
    one, two = F.explode("xs"), F.explode("xs")
    pairs = short.select("xs", one.alias("x")).select("x", two.alias("y")).where("x.id < y.id").selectExpr(
        "x.id a", "y.id b", "shiftright(x.about, 8) n", "shiftright(y.about, 8) m",
        "least(shiftright(x.about & 255, 1), shiftright(y.about & 255, 1)) least", "(x.about | y.about) & 1 some")
    pairs = pairs.where(f"some = 1 AND {q}L * least(n, m) >= {p}L * greatest(n, m)")
    pairs = pairs.groupBy("a", "b", "least").agg(F.count("*").alias("met")).where("met >= least").select("a", "b")
    return pairs, long


def blocks_of(pairs: DataFrame) -> DataFrame:
    """Members (block, id) of blocks in which all ``pairs`` (a < b) meet."""
    smallest = pairs.groupBy("b").agg(F.min("a").alias("with"))
    marked = pairs.join(smallest, "b").join(smallest.select(F.col("b").alias("a"), F.col("with").alias("same")), "a", "left")
    pairs = marked.where("same IS NULL OR same <> with").select("a", "b")
    return pairs.select(F.col("a").alias("block"), F.col("b").alias("id")).union(pairs.select("a", F.col("a").alias("b")).distinct())


def differences(groups: DataFrame, sets: DataFrame, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """One round in long lists: links (a, b) with the member of least weight, and the rows
    (gid, id, n, w, least, open, delta) of the remaining search."""
    both = groups.select("gid", "id").join(sets, "id").join(stored(centres(groups, sets), "centres"), "gid").select("gid", "id", "tokens", "lead")

    def subtract(batches):
        for batch in batches:
            out, weight, sizes = [], [], []
            for mine, lead in zip(batch.column(2), batch.column(3)):
                x, y = mine.values.to_numpy(), lead.values.to_numpy()
                out.append(np.setxor1d(x, y, assume_unique=True))
                weight.append((p + q) * len(out[-1]) - (q - p) * len(x))
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(weight, pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                names=["gid", "id", "n", "w", "delta"])

    members = stored(both.mapInArrow(subtract, "gid bigint, id bigint, n bigint, w bigint, delta array<bigint>"), "differences")
    nearest = members.groupBy("gid").agg(F.min(F.struct("w", "id", "delta")).alias("near"))
    members = members.join(nearest, "gid").withColumn("open", F.expr("w + near.w > 0"))
    shared = F.expr(f"{2 * (p + q)}L * size(array_intersect(delta, near.delta)) >= w + near.w")
    links = members.where(F.col("id") != F.col("near.id")).where(~F.col("open") | shared)
    return links.select(F.col("id").alias("a"), F.col("near.id").alias("b")), members.select(
        "gid", "id", "n", "w", F.col("near.w").alias("least"), "open", "delta")


def in_parts(groups: DataFrame, labels: DataFrame, *some: str) -> tuple[DataFrame, DataFrame]:
    """Of ``groups`` (gid, id, n, ...) those with several components in ``labels`` (an id
    without one is its own) and a row with each of ``some``: the small ones as members
    (block, id), and the rows of the others, with their component."""
    named = groups.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = named.groupBy("gid").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"), F.min("component").alias("lo"),
                                     F.max("component").alias("hi"), *[F.max(c).alias(c) for c in some])
    apart = apart.where(" AND ".join(["lo < hi", *some])).select(
        "gid", F.expr(f"size <= {BLOCK_SIZE} AND tokens <= {BLOCK_TOKENS}").alias("small"))
    named = stored(named.join(apart, "gid"), "parts")
    return named.where("small").select(F.col("gid").alias("block"), "id", "n"), named.where("NOT small").drop("small")


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` (block, id, n) as (block, id), those with the same smallest member as one
    block unless that is too large: then they stay as they are. Pairs that meet still do,
    and a pair that meets in many overlapping blocks is searched once."""
    lowest = blocks.groupBy("block").agg(F.min("id").alias("lo"))
    marked = stored(blocks.join(lowest, "block").distinct(), "marked")
    union = marked.select("lo", "id", "n").distinct()
    fit = stored(union.groupBy("lo").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
                 .where(f"size <= {BLOCK_SIZE} AND tokens <= {BLOCK_TOKENS}").select("lo"), "merged")
    return union.join(fit, "lo", "left_semi").select(F.col("lo").alias("block"), "id").union(
        marked.join(fit, "lo", "left_anti").select("block", "id"))


def prefixes_of(members: DataFrame, shared, p: int, q: int) -> DataFrame:
    """Rows for ``short_lists``: of each member's differences the rare ones that it must have
    in common with a partner."""

    def prefixes(batches):
        for batch in batches:
            out = []
            for w, delta, least, is_open in zip(*(batch.column(c) for c in ("w", "delta", "least", "open"))):
                w, least, d = w.as_py(), least.as_py(), delta.values.to_numpy()
                # A partner of an open member is any, of another one an open member.
                need = w + least if is_open.as_py() else w - least + 1
                shortest = -(-need // (2 * (p + q)))  # differences that such a pair shares at least
                out.append(in_list_order(d, shared.value)[:max(0, len(d) + 1 - shortest)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("gid", "id", "n")), pa.array([1] * len(out), pa.int64()), batch.column("open"),
                 batch.column("component"), pa.array(out, pa.list_(pa.int64()))],
                names=["gid", "id", "n", "least", "open", "component", "prefix"])

    return members.mapInArrow(
        prefixes, "gid bigint, id bigint, n bigint, least bigint, open boolean, component bigint, prefix array<bigint>")


# -- the join ------------------------------------------------------------------


def class_links(docs: DataFrame, classes: DataFrame, shared, k: int, p: int, q: int) -> DataFrame:
    """Links (a, b) among ``classes`` (class, id, n, prefix), enough for their components."""
    # Size bands by powers of two; a set also enters the band of its largest partner.
    bands = F.array_distinct(F.expr(f"array(floor(log2(n)), floor(log2(n * {q}L div {p}L)))"))
    level = classes.select(F.explode(bands).alias("gid"), "id", "n", F.expr(f"least({SPARE}L, ceil({p}L * n / {q}L))").cast("bigint").alias("least"),
                           F.lit(True).alias("open"), F.col("id").alias("component"), "prefix")
    pairs, groups = short_lists(level, p, q, True)
    pairs, groups = [stored(pairs, "pairs")], stored(groups, "groups")
    ids = pairs[0].select("a").union(pairs[0].select("b")).union(groups.select("id"))
    ids = stored(ids.distinct().select(F.col("a").alias("doc_id")), "candidates")

    def tokens(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([text_shingles(t, k) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))],
                names=["id", "tokens"])

    sets = stored(keep_ids(docs, ids).mapInArrow(tokens, "id bigint, tokens array<bigint>"), "tokens")
    links, blocks, labels = [], [], None
    while not groups.isEmpty():
        found, members = differences(groups, sets, p, q)
        links.append(stored(found.distinct(), "near"))
        labels = connected_components(reduce(DataFrame.union, links))
        small, members = in_parts(members, labels, "open")
        more, groups = short_lists(stored(prefixes_of(members, shared, p, q), "level"), p, q, False)
        pairs.append(stored(more, "pairs"))
        less, groups = in_parts(groups, labels)
        blocks += [small, less]
    every = reduce(DataFrame.union, pairs).distinct()
    if labels is not None:
        at = [labels.select(F.col("id").alias(c), F.col("component").alias("of_" + c)) for c in "ab"]
        every = every.join(at[0], "a", "left").join(at[1], "b", "left").where(
            "coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    # One number for a block of pairs and one of groups makes a larger block.
    members = blocks_of(stored(every, "pairs"))
    if blocks:
        members = members.union(merged_blocks(reduce(DataFrame.union, blocks)))
    links.append(search_blocks(stored(members.distinct(), "blocks"), sets, p, q))
    return reduce(DataFrame.union, links).distinct()


def jaccard_components(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text): distinct
    ``k``-word shingles, and the smallest doc_id reachable by links of similarity p/q."""
    small_batches(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id AS bigint) doc_id", "cast(text AS string) text")
    shared = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, k))

    def describe(batches):
        for batch in batches:
            sizes, digests, prefixes = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = text_shingles(text, k)
                n = len(tokens)
                least = -(-p * n // q)
                sizes.append(n)
                digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if n else None)
                prefixes.append(in_list_order(tokens, shared.value)[:n - least + min(SPARE, least)] if n else tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "n", "class", "prefix"])

    rows = stored(docs.mapInArrow(describe, "doc_id bigint, n bigint, class binary, prefix array<bigint>"), "sets")
    classes = stored(rows.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "classes")

    found = stored_alone(docs.sparkSession, lambda: class_links(docs, classes, shared, k, p, q), "found")
    shared.unpersist()
    # One doc_id with several texts joins their classes.
    own = rows.where("class IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "class")
    several = own.groupBy("doc_id").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("doc_id")
    links = found.union(own.join(several, "doc_id").join(classes.select("class", "id"), "class")
                 .select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b"))
    joined = connected_components(links)
    labels = classes.select("class", "id").join(joined, "id", "left").select("class", F.coalesce("component", "id").alias("component"))
    return rows.join(labels, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """``docs`` (all columns) with one document of each component, that of smallest id. A
    document is a doc_id and a text: of a doc_id with several texts each is judged on its
    own, and all but one of them come after every plain doc_id. Rows equal in both stay or go
    together, rows without a doc_id stay."""
    spark = docs.sparkSession
    key, text = F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string"))
    texts = stored(docs.select(key.alias("id"), text.alias("th")).groupBy("id").agg(F.min("th").alias("least"), F.max("th").alias("most"))
                   .where("id IS NOT NULL AND least <> most").select("id", "least"), "several-texts")
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")
    rows = docs.select(key.alias("id"), text.alias("th"), row)
    met = rows.join(F.broadcast(texts) if texts.count() <= BROADCAST_IDS else texts, "id", "left")
    own = F.xxhash64("id", "th").bitwiseAND(F.lit(OWN_IDS - 1)).bitwiseOR(F.lit(OWN_IDS))
    named = met.select(F.when(F.col("th") > F.col("least"), own).otherwise(F.col("id")).alias("doc_id"), "row")

    def copies() -> DataFrame:
        plain = named.select("doc_id", F.col("row.text").alias("text"))
        return jaccard_components(plain, k, p, q).where("doc_id <> component_id").select("doc_id").distinct()

    gone = stored_alone(spark, copies, "near-copies")
    return keep_ids(named, gone, "left_anti").select("row.*")
