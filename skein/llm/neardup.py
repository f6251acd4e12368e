"""Records that say nearly the same: all pairs whose word sets have a Jaccard similarity of at least ``least``.

1. A record's words are a set; records with equal sets are a class, and one of each class (the smallest id) is compared.
2. Sets of a and b words with similarity s differ in at most D = t * (a + b) words, t = (1 - s) / (1 + s). Records are put in bands by
   their number of words, so that D has one bound for every pair of bands that can hold similar records.
3. For a pair of bands all words are spread over m = D // 2 + 1 blocks, and a block's sketch is the XOR of its words' 64-bit hashes, in
   which words that occur an even number of times between two records cancel. By the pigeonhole principle some block of two similar records
   differs in at most one word. So each record emits the sketch of every block, and that sketch without each one of the block's
   words: two similar records have one of these in common, and meet there.
4. Words that stand in many records are dealt to the blocks by rank, so that every block gets its share of telling words; the others
   go by hash. Which word goes where only decides how many records meet for nothing, never which pairs are found.
5. Where two records meet, the Hamming distance of the 128-bit parity sketches of all their words (one bit flipped per word), which is
   never more than the words they differ in, must be at most D for their sizes. Few other pairs are left, and their words decide.

Nothing is missed: no key, bucket or partner is capped. Buckets are processed as sorted arrays, one offset between neighbours at a time.
A bucket of more than ``HOT`` sketches (counted over all records first) is split into chunks, and every two chunks meet in a cell
of their own, so that no task holds a bucket whole. Words are taken as 64-bit hashes until the last step, which compares the words.

Cases: null columns count as empty; a record without words is in no pair and a class of its own; rows repeated under one id count
once (by its first columns in an arbitrary copy); records of one or two words are similar only to equal ones, through
their class; an empty table gives an empty result. Null ids are dropped, other columns ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.components import components
from skein.plans.cut import cut

#: Share of the records above which a word is dealt by rank; so there can be no more such words than words per record over FREQUENT.
FREQUENT = 0.02
#: Upper end of a band over that of the one before. Narrower bands let fewer records meet for nothing, wider ones make fewer sketches.
RATIO = 1.43
#: Sketches of a bucket above which it is split, and of each chunk.
HOT = 50_000
#: Rows of sketches that a task should get.
TASK_ROWS = 600_000


def word_set(columns: list[Column]) -> Column:
    """The distinct maximal runs of a-z and 0-9 of the lower-cased columns, sorted."""
    text = F.lower(F.concat_ws(" ", *columns))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))))


def _most_differing(total: int, least: float) -> int:
    """Words in which sets of so many words together may differ."""
    return int((1 - least) / (1 + least) * total + 1e-9)


def band_ends(most: int) -> list[int]:
    """Upper ends of the bands of sizes up to one that holds ``most``."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, int(ends[-1] * RATIO)))
    return ends


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads nearby ones."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Plan:
    """What every task must know to emit the same keys: the words dealt by rank, the bands in use, and the buckets that are split."""

    def __init__(self, least: float, frequent: np.ndarray, ends: list[int], used: list[int]) -> None:
        """frequent: hashes, the most frequent first."""
        self.least, self.ends, self.used = least, np.asarray(ends), used
        order = np.argsort(frequent)
        self.frequent, self.rank = frequent[order], order.astype(np.uint64)
        self.hot, self.chunks = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def combinations(self) -> Iterator[tuple[int, int, int]]:
        """Lower band, higher band and blocks of the pairs of bands that can hold similar records."""
        for i in self.used:
            for j in self.used:
                lowest = int(self.ends[j - 1]) + 1 if j else 1
                if i <= j and lowest * self.least <= self.ends[i] + 1e-9:
                    upper = min(int(self.ends[j]), int(self.ends[i] / self.least + 1e-9))
                    differing = _most_differing(int(self.ends[i]) + upper, self.least)
                    if differing:
                        yield i, j, differing // 2 + 1

    def spread(self, hashes: np.ndarray) -> np.ndarray:
        """A number per word whose remainder is its block."""
        number = _mix(hashes) >> np.uint64(20)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            number = np.where(self.frequent[at] == hashes, self.rank[at], number)
        return number


def _keyed(x: np.ndarray, side: np.ndarray | int, reduced: np.ndarray | int) -> np.ndarray:
    """A key with its kind in the three lowest bits, so that in key order the higher side of a bucket comes first, and in each side the
    sketches that lack a word."""
    kind = (2 - np.asarray(side)) * 2 + 1 - np.asarray(reduced)
    return (x & ~np.uint64(7)) | kind.astype(np.uint64)


def _kind(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, side, and whether a word is lacking."""
    low = (keys & np.uint64(7)).astype(np.int64)
    return keys >> np.uint64(3), 2 - (low >> 1), 1 - (low & 1)


def sketches(sizes: np.ndarray, hashes: np.ndarray, plan: Plan, reduced: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and rows (positions in sizes), for records of sizes > 0; hashes are theirs in a row.

    Sides: 0 meets all of its bucket, 2 (a record of the higher band) and 1 (of the lower band) meet each other.
    """
    record, spread = np.repeat(np.arange(len(sizes)), sizes), plan.spread(hashes)
    band = np.searchsorted(plan.ends, sizes)
    for i, j, m in plan.combinations():
        here = np.nonzero((band == i) | (band == j))[0]
        if not len(here):
            continue
        new = np.full(len(sizes), -1)
        new[here] = np.arange(len(here))
        of = new[record] >= 0
        rec, words = new[record[of]], hashes[of]
        block = (spread[of] % np.uint64(m)).astype(np.int64)
        cell = rec * m + block
        order = np.argsort(cell, kind="stable")
        sorted_cell = cell[order]
        begin = np.ones(len(order), dtype=bool)
        begin[1:] = sorted_cell[1:] != sorted_cell[:-1]
        xors = np.zeros(len(here) * m, dtype=np.uint64)
        xors[sorted_cell[begin]] = np.bitwise_xor.reduceat(words[order], np.nonzero(begin)[0])
        salt = _mix(np.arange(m, dtype=np.uint64) + np.uint64((i * 1009 + j) * 100_003 + 1))
        side = np.zeros(len(here), dtype=np.int64) if i == j else np.where(band[here] == j, 2, 1)
        yield _keyed(_mix(xors ^ np.tile(salt, len(here))), np.repeat(side, m), 0), np.repeat(here, m)
        if reduced:
            yield _keyed(_mix(xors[cell] ^ words ^ salt[block]), side[rec], 1), here[rec]


def split_hot(keys: np.ndarray, rows: np.ndarray, ids: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows, those of hot buckets replaced by one for each cell in which their chunk meets a chunk."""
    if not len(plan.hot):
        return keys, rows
    bucket, side, reduced = _kind(keys)
    at = np.minimum(np.searchsorted(plan.hot, bucket), len(plan.hot) - 1)
    is_hot = plan.hot[at] == bucket
    if not is_hot.any():
        return keys, rows
    n = plan.chunks[at[is_hot]]
    row, bucket, side, reduced = (np.repeat(x[is_hot], n) for x in (rows, bucket, side, reduced))
    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    own = (_mix(ids.view(np.uint64)[row]) % np.repeat(n, n).astype(np.uint64)).astype(np.int64)
    lone = side == 0
    first = np.where(lone, np.minimum(own, other), np.where(side == 2, own, other))
    second = np.where(lone, np.maximum(own, other), np.where(side == 2, other, own))
    side = np.where(lone, np.where(own == other, 0, np.where(own < other, 2, 1)), side)
    cell = _mix(bucket ^ _mix((first << 32 | second).astype(np.uint64) + np.uint64(1)))
    return np.concatenate([keys[~is_hot], _keyed(cell, side, reduced)]), np.concatenate([rows[~is_hot], row])


def signatures(ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, ...]]:
    """key, id, two halves of the sketch of all words, size."""
    begins = np.cumsum(sizes) - sizes
    bit = np.uint64(1) << (hashes & np.uint64(63))
    upper = (hashes & np.uint64(64)) != 0
    f1 = np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), bit), begins).view(np.int64)
    f2 = np.bitwise_xor.reduceat(np.where(upper, bit, np.uint64(0)), begins).view(np.int64)
    for keys, rows in sketches(sizes, hashes, plan):
        keys, rows = split_hot(keys, rows, ids, plan)
        yield keys.view(np.int64), ids[rows], f1[rows], f2[rows], sizes[rows].astype(np.int32)


def meetings(key: np.ndarray, ids: np.ndarray, f1: np.ndarray, f2: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that share a key, not both lacking a word, and whose sketches allow the similarity."""
    order = np.argsort(key.view(np.uint64), kind="stable")
    bucket, side, reduced = _kind(key.view(np.uint64)[order])

    def ends(same: np.ndarray) -> np.ndarray:
        """Per row the end of its run; same: whether a row goes on with the run of the one before."""
        return np.append(np.nonzero(~same)[0][1:], len(same))[np.cumsum(~same) - 1]

    same = np.zeros(len(key), dtype=bool)
    same[1:] = bucket[1:] == bucket[:-1]
    kinds = same.copy()
    kinds[1:] &= (side[1:] == side[:-1]) & (reduced[1:] == reduced[:-1])
    end, after = ends(same), ends(kinds)
    # one lacking a word meets those of the other side, or of its own if there is one, that lack none; others meet all that follow
    begin = np.where(reduced == 1, after, np.arange(len(key)) + 1)
    of_side = same.copy()
    of_side[1:] &= side[1:] == side[:-1]
    begin = np.where(side == 2, ends(of_side), begin)
    full = np.where(begin < end, np.minimum(begin, len(key) - 1), 0)
    skip = (side == 2) & (reduced == 1) & (begin < end) & (reduced[full] == 1)
    begin = np.where(skip, after[full], begin)
    i = np.nonzero((begin < end) & (side != 1))[0]
    j, end = begin[i], end[i]
    ids, f1, f2, size = ids[order], f1[order].view(np.uint64), f2[order].view(np.uint64), size[order].astype(np.int64)
    most = ((1 - least) / (1 + least) * size + 1e-3).astype(np.float32)
    found_a, found_b = [], []
    while len(i):
        differing = np.bitwise_count(f1[i] ^ f1[j]) + np.bitwise_count(f2[i] ^ f2[j])
        near = differing <= most[i] + most[j]
        x, y = i[near], j[near]
        a, b = size[x], size[y]
        ok = (np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9) & (ids[x] != ids[y])
        found_a.append(ids[x[ok]])
        found_b.append(ids[y[ok]])
        j = j + 1
        stay = j < end
        i, j, end = i[stay], j[stay], end[stay]
    if not found_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, sizes and flat hashes of a few thousand records at a time."""
    for b in batches:
        for s in range(0, b.num_rows, 2_000):
            ids, hashes = b.column(0).slice(s, 2_000), b.column(1).slice(s, 2_000)
            yield ids.to_numpy(), hashes.value_lengths().to_numpy().astype(np.int64), hashes.flatten().to_numpy().view(np.uint64)


class NearDuplicates:
    """The classes of equal records and the links between them; made once, used by several results."""

    def __init__(self, df: DataFrame, key: str, columns: list[str], least: float) -> None:
        words = word_set([F.col(c) for c in columns])
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), words.alias("words")).dropDuplicates(["id"])
        named = cut(rows.withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64("words", F.lit(1))}))
        worded = named.filter(F.size("words") > 0)
        self.least, self.rows = least, named
        self.reps = cut(worded.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("words").alias("words"), F.count("*").alias("copies")))
        self.members = cut(worded.drop("words").join(self.reps.drop("words"), ["h1", "h2"]).select("id", "rep", "copies"))
        self.links = cut(self._links())

    def _plan(self) -> tuple[Plan, int]:
        """The plan, and the number of tasks for the rows it makes."""
        count, length, longest = self.reps.agg(F.count("*"), F.avg(F.size("words")), F.max(F.size("words"))).first()
        if not count:
            return Plan(self.least, np.zeros(0, dtype=np.uint64), [1], []), 8
        words = self._hashed().select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
        # at most length / FREQUENT words can be as frequent
        often = [r.h for r in words.filter(F.col("n") > FREQUENT * count).orderBy(F.desc("n"), "h").select("h").collect()]
        ends = band_ends(longest)
        band = sum(((F.size("words") > e).cast("int") for e in ends), F.lit(0))
        bands = self.reps.groupBy(band.alias("b")).agg(F.count("*").alias("n")).collect()
        plan = Plan(self.least, np.array(often, dtype=np.int64).view(np.uint64), ends, sorted(r.b for r in bands))
        of = {r.b: r.n for r in bands}
        rows = sum((of[i] * (i != j) + of[j]) * (length + m) for i, j, m in plan.combinations())

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, sizes, flat in _pieces(batches):
                for keys, _ in sketches(sizes, flat, plan, reduced=False):
                    yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(3)).view(np.int64))], ["bucket"])

        # no more than the sketches over HOT can be so many
        hot = self._hashed().mapInArrow(emit, "bucket bigint").groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).orderBy("bucket").collect()
        plan.hot = np.array([r.bucket for r in hot], dtype=np.int64).view(np.uint64)
        plan.chunks = np.array([-(-r.n // HOT) for r in hot], dtype=np.int64)
        return plan, max(8, int(rows / TASK_ROWS) + 1)

    def _hashed(self) -> DataFrame:
        return self.reps.select("rep", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))

    def _links(self) -> DataFrame:
        """Pairs of different classes, a < b, by their smallest ids."""
        least = self.least
        plan, tasks = self._plan()

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, sizes, flat in _pieces(batches):
                for columns in signatures(ids, sizes, flat, plan):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "id", "f1", "f2", "size"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                t = pa.Table.from_batches(held)
                del held
                a, b = meetings(*(t[c].to_numpy() for c in ("key", "id", "f1", "f2", "size")), least)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        keys = self._hashed().mapInArrow(emit, "key bigint, id bigint, f1 bigint, f2 bigint, size int").repartition(tasks, F.shiftright("key", 3))
        pairs = keys.mapInArrow(meet, "a bigint, b bigint").distinct()
        left = self.reps.select(F.col("rep").alias("a"), F.col("words").alias("words_a"))
        right = self.reps.select(F.col("rep").alias("b"), F.col("words").alias("words_b"))
        both = pairs.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("words_a", "words_b"))
        similarity = common / (F.size("words_a") + F.size("words_b") - common)
        return both.withColumn("similarity", similarity).filter(F.col("similarity") >= least).select("a", "b", "similarity")

    def pairs(self) -> DataFrame:
        """Every pair of ids, a < b, between classes and within them."""
        x, y = self.members.select(F.col("id").alias("x"), F.col("rep").alias("a")), self.members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
        between = self.links.join(x, "a").join(y, "b")
        copied = self.members.filter(F.col("copies") > 1)
        within = copied.select(F.col("id").alias("x"), "rep").join(copied.select(F.col("id").alias("y"), "rep"), "rep").filter(F.col("x") < F.col("y"))
        both = between.select("x", "y").unionByName(within.select("x", "y"))
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def groups(self) -> DataFrame:
        """Every id with its group (the smallest id it is linked to, over any number of links) and its number of links."""
        group = components(self.links.select("a", "b"))
        ends = self.links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(self.links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
        sizes = self.reps.select(F.col("rep").alias("other"), "copies")
        linked = ends.join(sizes, "other").groupBy("rep").agg(F.sum("copies").alias("others"))
        classes = self.reps.select("rep", "copies").join(linked, "rep", "left").join(group.select(F.col("node").alias("rep"), "component"), "rep", "left")
        classes = classes.select("rep", F.coalesce("component", "rep").alias("group"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
        worded = self.members.select("id", "rep").join(classes, "rep").select("id", "group", "links")
        wordless = self.rows.filter(F.size("words") == 0).select("id", F.col("id").alias("group"), F.lit(0).cast("long").alias("links"))
        return worded.unionByName(wordless)
