"""All similar pairs between set-valued records, by pigeonhole partitioning.

The universe of tokens is split into segments, as many as the length of the set
asks for.  Two sets with at most H different tokens agree in some segment, or
differ by one token in it: if segments are tested with weights v (0: not at
all, 1: equal, 2: equal or one token more or less) that add up to H + 1, two sets
that fail every test differ in more than H tokens.  So one side emits, per
segment, its tokens' signature and those with one token deleted; the other
side chooses, for each set, the tests that meet the fewest candidates.
Candidates are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.storage import materialize

#: Sets up to this length have segments of their own length; longer ones share those of a range of lengths.
EXACT_LENGTHS = 24
RANGE_RATIO = 1.1
#: Frequencies are known of the tokens that make up more than one of so many places.
HOT_TOKENS = 20_000

def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer for each element, as hashes are added up."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Layout:
    """Ranges of lengths, how far similar sets may differ, and numbers of segments."""

    def __init__(self, threshold: Fraction):
        self.t = threshold

    def range_of(self, n: int) -> tuple[int, int]:
        if n <= EXACT_LENGTHS:
            return n, n
        low = EXACT_LENGTHS + 1
        while (high := max(low, floor(low * RANGE_RATIO))) < n:
            low = high + 1
        return low, high

    def shortest(self, n: int) -> int:
        return ceil(self.t * n)

    def longest(self, n: int) -> int:
        return floor(n / self.t)

    def common(self, a: int, b: int) -> int:
        """Fewest common tokens of similar sets of these lengths."""
        return ceil(self.t / (1 + self.t) * (a + b))

    def apart(self, low: int, high: int) -> int:
        """Most different tokens of a set within the range and a similar one that is not shorter."""
        if high - low < 3:
            return max(s + l - 2 * self.common(s, l) for s in range(low, high + 1) for l in range(s, self.longest(s) + 1))
        return floor((1 - self.t) / (1 + self.t) * (high + self.longest(high)))

    def between(self, n: int, low: int, high: int) -> int:
        """Most different tokens of a set of length n and a similar one within the range and not longer."""
        return max(s + n - 2 * self.common(s, n) for s in range(max(low, self.shortest(n)), min(high, n) + 1))

    def ranges_from(self, a: int, b: int) -> list[tuple[int, int]]:
        """The ranges of the lengths a to b."""
        found = []
        while a <= b:
            found.append(self.range_of(a))
            a = found[-1][1] + 1
        return found


class Segments:
    """Segments of many sets of one length, for one range of lengths; a row for each set."""

    def __init__(self, tokens: np.ndarray, low: int, segments: int):
        self.low, self.m, self.rows = low, segments, np.arange(len(tokens))[:, None]
        salt = np.uint64(low * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        self.mixed = _mix(tokens ^ salt)
        self.seg = (self.mixed % np.uint64(segments)).astype(np.int64)
        self.whole = np.zeros((len(tokens), segments), np.uint64)
        for i in range(tokens.shape[1]):
            self.whole[self.rows[:, 0], self.seg[:, i]] += self.mixed[:, i]

    def keys(self, sums: np.ndarray, seg: np.ndarray, deleted: int) -> np.ndarray:
        salt = _mix(np.uint64(self.low << 24) ^ (seg.astype(np.uint64) << np.uint64(1)) ^ np.uint64(deleted))
        return _mix(sums ^ salt)

    def whole_keys(self, deleted: int) -> np.ndarray:
        return self.keys(self.whole, np.broadcast_to(np.arange(self.m), self.whole.shape), deleted)

    def less_keys(self, deleted: int) -> np.ndarray:
        """For each token the key of its segment without it."""
        return self.keys(self.whole[self.rows, self.seg] - self.mixed, self.seg, deleted)


def index_keys(tokens: np.ndarray, low: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of what sets can be found by: each segment as it is, and with one of its tokens deleted."""
    s = Segments(tokens, low, segments)
    keys = np.concatenate([s.whole_keys(0), s.less_keys(1)], axis=1)
    return np.repeat(np.arange(len(tokens)), keys.shape[1]), keys.ravel()


def probe_keys(tokens: np.ndarray, counts: np.ndarray, low: int, segments: int, budget: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of what sets ask for: tests of their segments whose weights add up to ``budget``.

    ``counts`` says in how many sets each token is.  A test of a segment meets
    at most as many sets as hold its rarest token, and may meet all of them if
    it has none.  The weights are given where this costs least: a segment's
    second unit needs the first, so where it is the cheaper one both cost their
    mean.
    """
    s = Segments(tokens, low, segments)
    size = np.zeros((len(tokens), segments), np.int64)
    least = np.full((len(tokens), segments), most, np.float64)
    second = np.full((len(tokens), segments), most, np.float64)
    r = s.rows[:, 0]
    for i in range(tokens.shape[1]):
        g, c = s.seg[:, i], counts[:, i]
        a, b = least[r, g], second[r, g]
        second[r, g] = np.minimum(b, np.maximum(a, c))
        least[r, g] = np.minimum(a, c)
        size[r, g] += 1
    # One token more in the other set; or one less: any but the rarest, or the rarest itself.
    two = least + np.where(size > 0, np.maximum(size - 1, 0) * least + second, most)
    mean = (least + two) / 2
    cost = np.stack([np.where(two >= least, least, mean), np.where(two >= least, two, mean)], axis=2).reshape(len(tokens), 2 * segments)
    taken = np.argsort(cost, axis=1, kind="stable")[:, :budget] // 2
    weight = np.zeros((len(tokens), segments), np.int64)
    np.add.at(weight, (np.repeat(r, taken.shape[1]), taken.ravel()), 1)
    parts = []
    for keys, wanted in (
        (s.whole_keys(0), weight > 0),
        (s.whole_keys(1), weight > 1),
        (s.less_keys(0), weight[s.rows, s.seg] > 1),
    ):
        at = np.nonzero(wanted)
        parts.append((at[0], keys[at]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def classes(df: DataFrame, record: str, items: str) -> tuple[DataFrame, DataFrame]:
    """(class, items, n) of the distinct sets and (record, class) of their members.

    A class is named by 128 bits of a cryptographic hash of its items.  The
    records with their sets are written once, as both results read them.
    """
    made = df.select(F.col(record).alias("r"), F.sort_array(F.array_distinct(F.col(items))).alias("items")).filter("r is not null and items is not null")
    made = made.withColumn("class", F.unhex(F.substring(F.sha2(F.to_json("items"), 256), 1, 32)))
    made = materialize(made, "members")
    sets = made.groupBy("class").agg(F.first("items").alias("items")).withColumn("n", F.size("items"))
    return sets, made.select(F.col("r").alias(record), "class").distinct()


def similar_classes(sets: DataFrame, threshold: Fraction, least: int = 1) -> DataFrame:
    """(a, b): classes a < b of different sets with Jaccard similarity >= threshold.

    ``sets`` has (class, items, n), one row per distinct set; sets of fewer than
    ``least`` items take part in no pair.  Hashes of 64 bits select candidates;
    verification compares the items themselves.
    """
    layout = Layout(threshold)
    num, den = threshold.numerator, threshold.denominator
    able = materialize(sets.filter(F.col("n") >= max(1, least)).withColumn("h", F.xxhash64("class")), "sets")
    counted = able.agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).first()
    # Tokens in more than one of HOT_TOKENS of all places are at most HOT_TOKENS many; all others count as just as frequent as this bound.
    rare = max(1, (counted["tokens"] or 0) // HOT_TOKENS)
    hot = able.select(F.explode("items").alias("i")).groupBy(F.xxhash64("i").alias("t")).agg(F.count("*").alias("c")).filter(F.col("c") > rare)
    often = sorted((r["t"], r["c"]) for r in hot.collect())
    most = counted["sets"]
    hashed = able.select("h", "n", F.transform("items", lambda x: F.xxhash64(x)).alias("t"))
    schema = T.StructType([T.StructField(c, T.IntegerType() if c == "n" else T.LongType()) for c in ("h", "n", "bits", "key")])

    def emit(probe: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = np.array([t for t, _ in often], np.int64)
            known_counts = np.array([c for _, c in often] + [rare], np.int64)
            segments: dict[int, int] = {}
            for b in batches:
                h, n = b.column(0).to_numpy(), b.column(1).to_numpy()
                values, starts = b.column(2).flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])[:-1]
                for length in np.unique(n).tolist():
                    rows = np.flatnonzero(n == length)
                    for part in np.array_split(rows, max(1, len(rows) * length // 500_000)):
                        tokens = values[starts[part][:, None] + np.arange(length)]
                        if probe and len(names):
                            at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
                            counts = known_counts[np.where(names[at] == tokens, at, len(names))]
                        else:
                            counts = np.full(tokens.shape, rare)
                        unsigned = tokens.view(np.uint64)
                        bits = np.bitwise_or.reduce(np.uint64(1) << (_mix(unsigned) >> np.uint64(58)), axis=1).view(np.int64)
                        for low, high in layout.ranges_from(layout.shortest(length), length) if probe else [layout.range_of(length)]:
                            if low not in segments:
                                segments[low] = layout.apart(low, high) + 1
                            if probe:
                                row, key = probe_keys(unsigned, counts, low, segments[low], layout.between(length, low, high) + 1, most)
                            else:
                                row, key = index_keys(unsigned, low, segments[low])
                            columns = [h[part[row]], np.full(len(row), length, np.int32), bits[row], key.view(np.int64)]
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

        return hashed.mapInArrow(run, schema)

    # Each differing token changes at most one of 64 bits, so this drops no similar pair.
    length = F.col("nx") + F.col("ny")
    common = F.floor((num * length + num + den - 1) / (num + den))
    found = (
        emit(True)
        .select(F.col("h").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx"), "key")
        .join(emit(False).select(F.col("h").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"), "key"), "key")
        .filter((F.col("x") != F.col("y")) & (F.bit_count(F.col("bx").bitwiseXOR(F.col("by"))) <= length - 2 * common))
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .distinct()
    )
    of_x = able.select(F.col("h").alias("x"), F.col("class").alias("cx"), F.col("items").alias("ix"))
    of_y = able.select(F.col("h").alias("y"), F.col("class").alias("cy"), F.col("items").alias("iy"))
    both = F.size(F.array_intersect("ix", "iy"))
    return (
        found.join(of_x, "x")
        .join(of_y, "y")
        .filter(both * den >= num * (F.size("ix") + F.size("iy") - both))
        .select(F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b"))
    )


def class_links(df: DataFrame, record: str, items: str, threshold: Fraction, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(record, class, records, links) of every record with a set, and (a, b) of the similar classes.

    Records with equal sets are one class, which is not expanded: ``records``
    is how many it has, and ``links`` how many other records are similar to
    each of them, its own class included where its set is large enough.
    """
    sets, members = classes(df, record, items)
    near = materialize(similar_classes(sets, threshold, least), "links")
    count = materialize(members.groupBy("class").agg(F.count("*").alias("records")), "classes")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(count.select(F.col("class").alias("b"), "records"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("records").alias("others"))
    own = F.when(F.col("n") >= max(1, least), F.col("records") - 1).otherwise(0)
    links = (own + F.coalesce("others", F.lit(0))).cast("long").alias("links")
    known = count.join(sets.select("class", "n"), "class").join(other, "class", "left").select("class", "records", links)
    return members.join(known, "class").select(record, F.lower(F.hex("class")).alias("class"), "records", "links"), near


def similar(df: DataFrame, record: str, items: str, threshold: Fraction, least: int = 1) -> DataFrame:
    """(a, b): records a < b whose sets of items are similar.

    Jaccard similarity of the distinct items, both sets with at least ``least``.
    Null records and null sets are left out; a record with several rows takes
    part with each of its sets.  Equal sets are one class: classes are joined,
    and members are put in at the end.
    """
    sets, members = classes(df, record, items)
    near = similar_classes(sets, threshold, least)
    kept = sets.filter(F.col("n") >= max(1, least)).select("class")
    links = near.unionByName(kept.select(F.col("class").alias("a"), F.col("class").alias("b")))
    of_a = members.select(F.col(record).alias("ra"), F.col("class").alias("a"))
    of_b = members.select(F.col(record).alias("rb"), F.col("class").alias("b"))
    return (
        links.join(of_a, "a")
        .join(of_b, "b")
        .filter("ra != rb and (a != b or ra < rb)")
        .select(F.least("ra", "rb").alias(f"{record}_a"), F.greatest("ra", "rb").alias(f"{record}_b"))
        .distinct()
    )
