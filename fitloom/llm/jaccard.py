"""Set similarity join of documents by the Jaccard index of their word shingles, and the classes that its links make.

Sets equal to each other are one node. Distances are sizes of symmetric differences: two sets of n and m elements are linked when
(num + den) * distance <= (den - num) * (n + m), and distances obey the triangle inequality.

1. Order. Shingles are counted over all documents in a table of buckets. A set's shingles stand in the order of ascending
   frequency (the bucket's power of two, then the hash), and the first ones, so many that two similar sets must share one, go into
   inverted lists. A frequent shingle is in a list only for sets that have little else.
2. Families. Sets with a common min-hash meet the head of that key, the least node; the nearest head by bitmap is compared
   exactly, and a set within ``WIDE`` times a link's distance becomes a member, linked or not. A member is held as its difference
   from the family's consensus (the shingles that most members have), so answers are derived from a very similar set's:
   - a pair without a common difference is linked only if its two differences are small enough together; then both are
     linked with the core, the member nearest to the consensus;
   - every other link has common differences, so only lists of differences are read, and for members that the core doesn't answer for.
     How many must be common follows from both differences' sizes; so a member stands in the lists of its rarest ones only, and
     what many members have in common (such as the loss of one shingle of the original) brings few of them together;
   - members that share so many differences that those alone bring them together (another version of a template) become a family
     of their own, about their own consensus.
   A group of n near copies costs about the size of its differences.
3. Lists. A list has a row per family, not per set. Rows stand in the order of size; a row reads only the range of sizes that its
   size and position allow, in blocks, and a block whose positions are all too late is skipped whole. Families with one
   previous token in common have met in that token's list.
4. Across families. Roots of two families are compared exactly, if their bitmaps and radii leave a link possible. Members of the
   smaller family then take their difference from the consensus of the larger one (one exclusive or), and step 2's rule holds again.

Skew: of a shingle counted in fewer than ``HOT`` sets the list fits a task. Lists of others are first reduced to a row per family
by a partial aggregation, then dealt into cells of two parts of at most about ``HOT`` rows each. No task holds a longer list.

Defined results: without words or text a set is empty and linked with nothing; fewer words than a shingle make one shingle
of the whole sequence; a null doc_id has the class of its equals and never gives a class its name; rows that repeat a
doc_id with other texts are one node with several sets; other columns are left alone; an empty table gives no rows.
doc_id must be an integer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom.llm.graph import components
from fitloom.llm.rows import is_small, lean, packed, small, spread
from fitloom.llm.sift import sifted
from fitloom.llm.textarrays import BASE, INVERSE, Powers, Texts, gram_ok, grams, mix, texts_of
from fitloom.plans.scratch import Scratch

#: Most 64-bit words of a bitmap.
MOST_WORDS = 64
#: From so many sets on, a shingle's list is dealt out; a power of two.
HOT = 8192
#: Min-hashes of a set, and a family's reach in distances of a link.
KEYS, WIDE = 4, 3
#: Rows of a list that are skipped together, and pairs that are looked at together.
BLOCK, PAIRS = 64, 400_000
#: Powers of two of buckets that count shingles: a byte for each is broadcast, 16 MB at most.
BUCKETS = (16, 24)
#: Members of a group that becomes a family of its own, at least, and rounds of that.
SPLIT, ROUNDS = 32, 8
#: Tasks whose counts are summed before the others'.
TASKS = 256
NO_ID = -(1 << 63)
#: Common differences that a loose set shares with any partner at least.
LOOSE = "greatest(1L, CAST(ceil((f + f0) / {}) AS long))"


def shingle_sets(t: Texts, powers: Powers, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ordered within it, and the offsets of the texts' ranges."""
    words = t.word_hashes(powers, lower=True)
    starts, docs = gram_ok(t.first, k)
    g = grams(words, k)[starts] if len(starts) else np.zeros(0, np.uint64)
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < k))
    if len(short):
        whole = []
        for d in short.tolist():
            x = np.full(1, 77, np.uint64)
            for i in range(t.first[d], t.first[d + 1]):
                x = mix(x * np.uint64(3) + words[i : i + 1])
            whole.append(x[0])
        g, docs = np.concatenate([g, np.array(whole, np.uint64)]), np.concatenate([docs, short])
    order = np.lexsort((g, docs))
    g, docs = g[order], docs[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (docs[1:] != docs[:-1])])[: len(g)]
    g, docs = g[new], docs[new]
    return g, np.searchsorted(docs, np.arange(len(t.n_words) + 1))


def width_of(n: int, num: int, den: int) -> int:
    """Words of a set's bitmap: a power of two, at least four bits for each element by which two similar sets can differ, so
    that the bitmaps of less similar sets differ by more."""
    differ = 2 * n - 2 * (-(-num * 2 * n // (num + den)))
    return min(MOST_WORDS, 1 << max(0, (4 * differ - 1) // 64).bit_length())


def _bitmaps(g: np.ndarray, at: np.ndarray, num: int, den: int) -> list[bytes]:
    """Of each set, the parity of its hashes in each bit. Bitmaps of two sets differ by no more bits than the sets by elements."""
    out = []
    h = mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    for d, n in enumerate(np.diff(at).tolist()):
        bits = 64 * width_of(n, num, den)
        ones = np.bincount((h[at[d] : at[d + 1]] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(ones.astype(np.uint8), bitorder="little").tobytes())
    return out


def bit_distance(x: bytes, y: bytes) -> int:
    """Bits by which two bitmaps differ, the longer one folded to the other's length."""
    w = min(len(x), len(y)) // 8
    a, b = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint64).reshape(-1, w), axis=0) for v in (x, y))
    return int(np.bitwise_count(a ^ b).sum())


def _levels(docs: DataFrame, k: int) -> np.ndarray:
    """Of each bucket of shingles, the bits of its count over all documents: 0 for none, 1 for one, 14 from 8192 to 16383, and so on.

    A task sends its counts as blocks of single bytes, the lowest of each count, then the next where one isn't 0. Blocks of ``TASKS`` tasks are
    summed first, then those sums; both go through the rows one by one, so a task never holds more than one block's total."""
    bits = int(min(BUCKETS[1], max(BUCKETS[0], int(max(1, docs.count())).bit_length() + 2)))
    part = 1 << 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counts = Powers(BASE, INVERSE), np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for t in texts_of(batch.column("text")):
                g, _ = shingle_sets(t, powers, k)
                at, n = np.unique(g >> np.uint64(64 - bits), return_counts=True)
                counts[at] += n.astype(np.uint32)
        blocks = counts.reshape(-1, part)
        yield from sent((TaskContext.get().partitionId() // TASKS, b, blocks[b].astype(np.int64)) for b in np.flatnonzero(blocks.any(axis=1)).tolist())

    def sent(totals: Iterable[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        for some, block, total in totals:
            for byte in range(8):
                plane = (total >> (8 * byte)).astype(np.uint8)
                if not byte or plane.any():
                    rows.append((some, block, byte, plane.tobytes()))
            if len(rows) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def totals() -> Iterator[tuple[int, int, np.ndarray]]:
            last, total = None, np.zeros(part, np.int64)
            for batch in batches:
                for some, block, byte, counts in zip(*(batch.column(c) for c in names)):
                    at = (some.as_py(), block.as_py())
                    if at != last:
                        if last is not None:
                            yield *last, total
                        last, total = at, np.zeros(part, np.int64)
                    total += np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int64) << (8 * byte.as_py())
            if last is not None:
                yield *last, total

        yield from sent(totals())

    kinds = "some bigint, block bigint, byte bigint, counts binary"
    names = ["some", "block", "byte", "counts"]
    sums = docs.select("text").mapInArrow(run, kinds)
    sums = sums.repartition("some", "block").sortWithinPartitions("some", "block").mapInArrow(added, kinds).withColumn("some", F.lit(0).cast("long"))
    sums = sums.repartition("block").sortWithinPartitions("block").mapInArrow(added, kinds)
    totals = np.zeros(1 << bits, np.int64).reshape(-1, part)
    for row in sums.toLocalIterator():
        totals[row["block"]] += np.frombuffer(row["counts"], np.uint8).astype(np.int64) << (8 * row["byte"])
    # The exponent of a count is its number of bits; counts are below 2^53.
    return np.frexp(totals.reshape(-1).astype(np.float64))[1].astype(np.uint8)


def _sketches(docs: DataFrame, k: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """Of each row: doc_id, h (the text's hash), n, node (a hash of the whole set), keys (min-hashes), prefix, cold (how many of it
    have lists that fit a task), bits."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    hot = HOT.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, levels = Powers(BASE, INVERSE), shared.value
        shift = np.uint64(64 - (len(levels).bit_length() - 1))
        for batch in batches:
            for t in texts_of(batch.column("text")):
                g, at = shingle_sets(t, powers, k)
                n = np.diff(at)
                some = n > 0
                sums = np.zeros(len(g) + 1, np.uint64)
                np.cumsum(mix(g), out=sums[1:])
                node = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64))
                keys = np.zeros((len(n), KEYS), np.uint64)
                for m in range(KEYS):
                    if len(g):
                        keys[some, m] = np.minimum.reduceat(mix(g + np.uint64(7919 * (m + 1))), at[:-1][some])
                bitmaps = _bitmaps(g, at, num, den)
                level = levels[g >> shift]
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((g, level, owner))
                g, level = g[order], level[order]
                head = np.where(some, n + (-num * n // den) + 1, 0)
                chosen = np.arange(len(g)) - np.repeat(at[:-1], n) < np.repeat(head, n)
                cold = np.bincount(owner[chosen & (level < hot)], minlength=len(n))
                prefix = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(head)]).astype(np.int32), g[chosen].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(t.rows.start, len(n)) for c in ("doc_id", "h")), pa.array(n.astype(np.int32)), pa.array(node.view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, KEYS * len(n) + 1, KEYS, np.int32), keys.reshape(-1).view(np.int64)), prefix, pa.array(cold.astype(np.int32)), pa.array(bitmaps, pa.binary()),
                    ],
                    ["doc_id", "h", "n", "node", "keys", "prefix", "cold", "bits"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id bigint, h bigint, n int, node bigint, keys array<bigint>, prefix array<bigint>, cold int, bits binary")


def _met(rows: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """rows (doc, h, and others) joined with wanted by (doc, h); texts that nothing meets are not shuffled for it."""
    return rows.join(F.broadcast(wanted), ["doc", "h"], how) if is_small(wanted) else sifted(rows, wanted, ["doc", "h"], how)


def _whole(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted (doc, h, and others) with the whole set of that row of ``docs``."""
    names = [c for c in wanted.columns if c not in ("doc", "h")]
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("h"), "text")
    rows = _met(rows, wanted, "inner").select(*names, "text")
    schema = T.StructType([*(wanted.schema[c] for c in names), T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASE, INVERSE)
        for batch in batches:
            for t in texts_of(batch.column("text")):
                g, at = shingle_sets(t, powers, k)
                own = [batch.column(c).slice(t.rows.start, len(at) - 1) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(at.astype(np.int32), g.view(np.int64))], [*names, "set"])

    return rows.mapInArrow(run, schema)


def _differences(met: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and diff, the elements of one of the sets x and y only, of rows with 2 * most >= (den + num) * distance."""
    schema = T.StructType([*(met.schema[c] for c in keep), T.StructField("diff", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                most, good, diffs = part.column("most").to_pylist(), [], []
                for i, (x, y) in enumerate(zip(part.column("x"), part.column("y"))):
                    d = np.setxor1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)
                    if len(d) <= most[i]:
                        good.append(i)
                        diffs.append(d)
                ends = np.concatenate([[0], np.cumsum([len(d) for d in diffs])]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.int64), *diffs])
                own = part.select(keep).take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(ends, values)], [*keep, "diff"])

    return met.select(*keep, "most", "x", "y").mapInArrow(run, schema)


def _bit_distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b, most and others) whose bitmaps differ by at most ``most``, with that distance as far."""
    one, two = nodes.select(F.col("node").alias("a"), F.col("bits").alias("x")), nodes.select(F.col("node").alias("b"), F.col("bits").alias("y"))
    names, schema = pairs.columns, T.StructType([*pairs.schema.fields, T.StructField("far", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [bit_distance(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            far = np.array(far, np.int64)
            keep = pa.array(far <= batch.column("most").to_numpy())
            out = batch.select(names).filter(keep)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(far).filter(keep)], [*names, "far"])

    return pairs.join(one, "a").join(two, "b").select(*names, "x", "y").mapInArrow(run, schema)


def _xor(a: str, b: str) -> Column:
    a, b = F.coalesce(F.col(a), F.array().cast("array<bigint>")), F.coalesce(F.col(b), F.array().cast("array<bigint>"))
    return F.concat(F.array_except(a, b), F.array_except(b, a))


class Families:
    """members: node, fam (its root), n, diff (from the consensus), f (as small as the core allows: linked when f + f0 <= 0), far
    ((den + num) * |diff| + (den - num) * n), of families of two or more. turned: fam, flip, what most members don't have as the root has it."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, scratch: Scratch, k: int, num: int, den: int):
        self.nodes, self.docs, self.scratch, self.k, self.num, self.den = nodes, docs, scratch, k, num, den
        self.total, self.free = num + den, den - num

    def build(self) -> None:
        nodes, total, free = self.nodes, self.total, self.free
        keyed = nodes.select("node", "n", F.posexplode("keys").alias("m", "key"))
        heads = keyed.groupBy("m", "key").agg(F.min("node").alias("b"), F.count("*").alias("size")).filter("size > 1").drop("size")
        met = keyed.join(heads, ["m", "key"]).filter("node <> b").select(F.col("node").alias("a"), "n", "b").distinct()
        met = met.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("m")), "b")
        most = F.expr(f"cast(floor({WIDE * free} * (cast(n AS long) + m) / {total}) AS long)")
        met = _bit_distances(met.select("a", "b", most.alias("most")), nodes)
        near = met.groupBy("a").agg(F.min(F.struct("far", "b", "most")).alias("s")).select("a", F.col("s.b").alias("b"), F.col("s.most").alias("most"))
        near = self.scratch.keep(near, "nearest-heads")
        rows = nodes.select(F.col("node").alias("a"), "doc", "h")
        x = _whole(self.docs, rows.join(near, "a"), self.k).withColumnRenamed("set", "x")
        heads = rows.withColumnRenamed("a", "b").join(near.select("b").distinct(), "b")
        y = _whole(self.docs, heads, self.k).withColumnRenamed("set", "y")
        state = self.scratch.keep(_differences(x.join(y, "b"), ["a", "b"]).dropDuplicates(["a"]), "steps-0")
        self.scratch.drop("nearest-heads")
        i = 0
        # Heads are smaller than what they head, so every path ends; each round halves it.
        while not state.join(state.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            up = state.select(F.col("a").alias("b"), F.col("b").alias("top"), F.col("diff").alias("more"))
            up = state.join(up, "b", "left").select("a", F.coalesce("top", "b").alias("b"), _xor("diff", "more").alias("diff"))
            state, i = self.scratch.keep(up, f"steps-{i + 1}"), i + 1
            self.scratch.drop(f"steps-{i - 1}")
        roots = state.select(F.col("b").alias("a"), "b").distinct().withColumn("diff", F.array().cast("array<bigint>"))
        every = state.unionByName(roots).join(nodes.select(F.col("node").alias("a"), "n"), "a").select(F.col("a").alias("node"), F.col("b").alias("fam"), "n", "diff")
        sizes = every.groupBy("fam").agg(F.count("*").alias("size"))
        flips = every.select("fam", F.explode("diff").alias("token")).groupBy("fam", "token").count().join(sizes, "fam").filter("2 * count > size")
        self.turned = self.scratch.keep(flips.groupBy("fam").agg(F.collect_list("token").alias("flip")), "turned")
        members = every.withColumn("reach", F.size("diff") * total + F.col("n") * free).join(self.turned, "fam", "left")
        members = members.select("node", "fam", "n", "reach", _xor("diff", "flip").alias("diff"))
        size = F.size("diff")
        members = members.withColumn("f", (size * total - F.col("n") * free).cast("long")).withColumn("far", (size * total + F.col("n") * free).cast("long"))
        self.members = self.scratch.keep(members, "members")
        self.scratch.drop(f"steps-{i}")
        self._told("families")
        self._split()

    def _told(self, name: str) -> None:
        """about: of each family its size, f0 (the core's f), core, most_far and reach."""
        about = self.members.groupBy("fam").agg(
            F.count("*").alias("size"), F.min("f").alias("f0"), F.min_by("node", F.struct("f", "node")).alias("core"), F.max("far").alias("most_far"), F.max("reach").alias("reach")
        )
        self.about = self.scratch.keep(about, name)

    def _split(self) -> None:
        """Members that the core doesn't answer for and that share enough differences to meet in lists by those alone become families of
        their own, about their own consensus: what they share is no difference there, and lists between families find what links them
        with others. Only groups that pay: of the square root of their family, and ``SPLIT``, members at least. A family's root stays."""
        total, free, pays = self.total, self.free, "greatest({}, sqrt(size))".format(SPLIT)
        for i in range(ROUNDS):
            loose = self.members.join(self.about.select("fam", "f0", "size"), "fam").filter("f + f0 > 0 AND node <> fam")
            tokens = loose.select("fam", "node", "size", F.explode("diff").alias("token"))
            often = tokens.groupBy("fam", "token").agg(F.count("*").alias("freq"), F.first("size").alias("size")).filter(f"freq >= {pays}").drop("size")
            often = self.scratch.keep(often, f"often-{i}")
            if often.isEmpty():
                self.scratch.drop(f"often-{i}")
                return
            chosen = tokens.join(often, ["fam", "token"]).groupBy("fam", "node").agg(F.max(F.struct("freq", "token")).getField("token").alias("by"))
            loose = self.scratch.keep(loose.join(chosen, ["fam", "node"]), f"loose-{i}")
            sizes = loose.groupBy("fam", "by").agg(F.count("*").alias("all"), F.first("size").alias("size")).filter(f"all >= {pays}")
            common = loose.select("fam", "by", F.explode("diff").alias("token")).groupBy("fam", "by", "token").count().join(sizes, ["fam", "by"])
            common = common.filter("2 * count > all").groupBy("fam", "by").agg(F.collect_list("token").alias("common"))
            moved = loose.join(common, ["fam", "by"]).withColumn("less", _xor("diff", "common"))
            moved = moved.filter(f"size(array_intersect(diff, common)) >= {LOOSE.format(2 * total)} AND size(less) < size(diff)")
            moved = self.scratch.keep(moved.select("fam", "by", "node", "n", "size", F.col("less").alias("diff")), f"moved-{i}")
            first = F.struct(F.size("diff").alias("k"), "node", F.col("diff").alias("flip"))
            heads = moved.groupBy("fam", "by").agg(F.count("*").alias("all"), F.first("size").alias("size"), F.min(first).alias("head")).filter(f"all >= {pays}")
            heads = self.scratch.keep(heads.select("fam", "by", F.col("head.node").alias("root"), F.col("head.flip").alias("flip")), f"heads-{i}")
            if heads.isEmpty():
                self.scratch.drop(*(f"{name}-{i}" for name in ("often", "loose", "moved", "heads")))
                return
            new = moved.join(heads, ["fam", "by"]).select("node", F.col("root").alias("fam"), "n", "diff", "flip")
            new = new.withColumn("reach", F.size(_xor("diff", "flip")) * total + F.col("n") * free).drop("flip")
            size = F.size("diff")
            new = new.withColumn("f", (size * total - F.col("n") * free).cast("long")).withColumn("far", (size * total + F.col("n") * free).cast("long"))
            new = self.scratch.keep(new, f"new-{i}")
            stay = self.members.join(new.select("node"), "node", "left_anti")
            self.members = self.scratch.keep(stay.select(*new.columns).unionByName(new), f"members-{i}")
            self.turned = self.scratch.keep(self.turned.unionByName(heads.select(F.col("root").alias("fam"), "flip")), f"turned-{i}")
            self._told(f"families-{i}")
            self.scratch.drop(*(f"{name}-{i}" for name in ("often", "loose", "moved", "heads", "new")), *(f"{name}-{i - 1}" if i else name for name in ("members", "turned", "families")))

    def _ranked(self, rows: DataFrame, least: str, freq: DataFrame) -> DataFrame:
        """fam, node, f, size and token of the differences that a set must share one of with every partner: those that come first in
        the order of their frequency among the family's members. least: how many differences a link shares at least."""
        rows = rows.select("fam", "node", "f", F.size("diff").alias("size"), F.expr(least).alias("least"), F.explode("diff").alias("token"))
        rows = rows.join(freq, ["fam", "token"], "left").withColumn("k", F.row_number().over(W.partitionBy("fam", "node").orderBy(F.coalesce("freq", F.lit(0)), "token")))
        return rows.filter("k <= size - least + 1").select("fam", "node", "f", "size", "token")

    def _index(self) -> DataFrame:
        """The lists of differences of all members, for sets that the core doesn't answer for (f + f0 > 0)."""
        self.freq = self.scratch.keep(self.members.select("fam", F.explode("diff").alias("token")).groupBy("fam", "token").agg(F.count("*").alias("freq")).filter("freq > 1"), "frequencies")
        rows = self.members.join(self.about.select("fam", "f0"), "fam")
        return self.scratch.keep(self._ranked(rows, f"greatest(1L, floor((f - f0) / {2 * self.total}) + 1)", self.freq), "differences")

    def inside(self) -> DataFrame:
        """Links a, b within families."""
        self.index = self._index()
        about = self.about.select("fam", "f0", "core")
        rows = self.members.join(about, "fam")
        loose = F.col("f") + F.col("f0") > 0
        star = rows.filter(~loose & (F.col("node") != F.col("core"))).select(F.col("node").alias("a"), F.col("core").alias("b"))
        # A loose member's links, but for those with common differences, are none.
        one = self._ranked(rows.filter(loose), LOOSE.format(2 * self.total), self.freq).select("fam", "token", F.col("node").alias("a"), F.col("f").alias("fa"), F.col("size").alias("sa"))
        two = self.index.join(about, "fam").select("fam", "token", F.col("node").alias("b"), F.col("f").alias("fb"), F.col("size").alias("sb"), loose.alias("other"))
        met = one.join(two, ["fam", "token"]).filter(f"a <> b AND (NOT other OR a < b) AND fa + fb <= {2 * self.total} * least(sa, sb)").select("a", "b").distinct()
        return star.unionByName(self._checked(met, self.members.select("node", "diff", "f"), self.members.select("node", "diff", "f")))

    def _checked(self, pairs: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
        """The pairs a, b that are linked by their differences from one consensus."""
        met = pairs.join(one.select(F.col("node").alias("a"), F.col("diff").alias("x"), F.col("f").alias("fa")), "a")
        met = met.join(two.select(F.col("node").alias("b"), F.col("diff").alias("y"), F.col("f").alias("fb")), "b")
        return met.filter(F.col("fa") + F.col("fb") <= 2 * self.total * F.size(F.array_intersect("x", "y"))).select("a", "b")

    def across(self, pairs: DataFrame) -> DataFrame:
        """Links a, b of sets of two families, from candidates a, b (roots)."""
        nodes, total, free = self.nodes, self.total, self.free
        known = nodes.select("node", "n").join(self.about.select(F.col("fam").alias("node"), "size", "reach"), "node", "left")
        known = known.select("node", F.coalesce("reach", F.col("n") * free).alias("reach"), F.coalesce("size", F.lit(1)).alias("size"))
        most = F.floor((F.col("ra") + F.col("rb")) / total).cast("long").alias("most")
        pairs = pairs.join(known.select(F.col("node").alias("a"), F.col("reach").alias("ra"), F.col("size").alias("sa")), "a")
        pairs = pairs.join(known.select(F.col("node").alias("b"), F.col("reach").alias("rb"), F.col("size").alias("sb")), "b")
        close = self.scratch.keep(_bit_distances(pairs.select("a", "b", "sa", "sb", most), nodes).drop("far"), "close")
        rows = nodes.select("node", "doc", "h")
        x = _whole(self.docs, rows.join(close.select(F.col("a").alias("node")).distinct(), "node"), self.k).select(F.col("node").alias("a"), F.col("set").alias("x"))
        y = _whole(self.docs, rows.join(close.select(F.col("b").alias("node")).distinct(), "node"), self.k).select(F.col("node").alias("b"), F.col("set").alias("y"))
        met = close.join(x.dropDuplicates(["a"]), "a").join(y.dropDuplicates(["b"]), "b")
        met = self.scratch.keep(_differences(met, ["a", "b", "sa", "sb"]), "roots")
        self.scratch.drop("close")
        sizes = nodes.select("node", "n")
        met = met.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        met = met.withColumn("linked", F.size("diff") * total <= (F.col("na") + F.col("nb")) * free)
        direct = met.filter("linked").select("a", "b")
        # Linked roots don't answer for members that their own core doesn't answer for, so those pairs go on too.
        more = met.filter("sa > 1 OR sb > 1").selectExpr("if(sa >= sb, a, b) AS big", "if(sa >= sb, b, a) AS little", "least(sa, sb) AS s", "if(sa >= sb, nb, na) AS n", "diff")
        turned = self.turned
        more = more.join(turned.select(F.col("fam").alias("big"), F.col("flip").alias("f1")), "big", "left").join(turned.select(F.col("fam").alias("little"), F.col("flip").alias("f2")), "little", "left")
        more = more.withColumn("d", _xor("diff", "f1")).drop("diff", "f1")
        alone = more.filter("s = 1").select("big", F.col("little").alias("node"), "n", F.col("d").alias("diff"))
        group = more.filter("s > 1").withColumn("e", _xor("d", "f2")).select("big", "little", "e")
        group = group.join(self.members.select(F.col("fam").alias("little"), "node", "n", "diff"), "little").select("big", "node", "n", _xor("diff", "e").alias("diff"))
        guests = alone.unionByName(group).withColumn("f", (F.size("diff") * total - F.col("n") * free).cast("long"))
        guests = guests.join(self.about.select(F.col("fam").alias("big"), "f0", "core", "most_far"), "big")
        guests = self.scratch.keep(guests.filter("f <= most_far"), "guests")
        star = guests.filter("f + f0 <= 0").select(F.col("node").alias("a"), F.col("core").alias("b"))
        one = self._ranked(guests.filter("f + f0 > 0").withColumnRenamed("big", "fam"), LOOSE.format(2 * total), self.freq)
        one = one.select(F.col("fam").alias("big"), F.col("node").alias("a"), F.col("f").alias("fa"), F.col("size").alias("sa"), "token")
        two = self.index.select(F.col("fam").alias("big"), F.col("node").alias("b"), F.col("f").alias("fb"), F.col("size").alias("sb"), "token")
        found = one.join(two, ["big", "token"]).filter(f"fa + fb <= {2 * total} * least(sa, sb)").select("big", "a", "b").distinct()
        found = found.join(guests.select("big", F.col("node").alias("a"), F.col("diff").alias("x"), F.col("f").alias("fa")), ["big", "a"])
        found = found.join(self.members.select(F.col("node").alias("b"), F.col("diff").alias("y"), F.col("f").alias("fb")), "b")
        found = found.filter(F.col("fa") + F.col("fb") <= 2 * total * F.size(F.array_intersect("x", "y"))).select("a", "b")
        return direct.unionByName(star).unionByName(found)


def list_pairs(group: np.ndarray, fam: np.ndarray, lo: np.ndarray, hi: np.ndarray, room: np.ndarray, prev: np.ndarray, part: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of the lists of a chunk: families of one group, whose sizes (lo to hi) and room (elements from the list's token on, at most)
    allow a link, that don't share the previous token, and aren't in one part other than 0."""
    order = np.lexsort((fam, group))
    group, fam, lo, hi, room, prev, part = (x[order] for x in (group, fam, lo, hi, room, prev, part))
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (fam[1:] != fam[:-1])]))
    same = np.minimum.reduceat(prev, first) == np.maximum.reduceat(prev, first)
    lo, hi, room = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), np.maximum.reduceat(room, first)
    group, fam, prev, part = group[first], fam[first], np.where(same, prev[first], 0), part[first]
    order = np.lexsort((lo, group))
    group, fam, lo, hi, room, prev, part = (x[order] for x in (group, fam, lo, hi, room, prev, part))
    most = np.maximum(np.minimum(hi * den // num, room * (num + den) // num - lo), -1)
    key = (group << 32) + lo
    begin, end = np.arange(1, len(key) + 1), np.searchsorted(key, (group << 32) + most, "right")
    rows = np.flatnonzero(end > begin)
    if not len(rows):
        return
    edges = np.arange(0, len(key), BLOCK)
    most_room, least_lo = np.maximum.reduceat(room, edges), lo[edges]
    long = end[rows] - begin[rows] > 2 * BLOCK
    # Long ranges go block by block: within a group sizes ascend, so a block's first size is its least.
    spans = [(rows[~long], begin[rows[~long]], end[rows[~long]])]
    for i in rows[long].tolist():
        blocks = np.arange(begin[i] // BLOCK, (end[i] - 1) // BLOCK + 1)
        good = most_room[blocks] * (num + den) >= num * (lo[i] + np.where(group[edges[blocks]] == group[i], least_lo[blocks], lo[i]))
        blocks = blocks[good]
        spans.append((np.full(len(blocks), i), np.maximum(blocks * BLOCK, begin[i]), np.minimum((blocks + 1) * BLOCK, end[i])))
    at, begin, end = (np.concatenate([s[c] for s in spans]) for c in range(3))
    done, sums = 0, np.cumsum(end - begin)
    while done < len(at):
        to = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + PAIRS, "right")))
        n = end[done:to] - begin[done:to]
        i = np.repeat(at[done:to], n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[done:to], n)
        good = (room[j] * (num + den) >= num * (lo[i] + lo[j])) & ((prev[i] != prev[j]) | (prev[i] == 0)) & ((part[i] != part[j]) | (part[i] == 0))
        a, b = fam[i[good]], fam[j[good]]
        yield np.minimum(a, b), np.maximum(a, b)
        done = to


def _candidates(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs a, b of families. lists: token, cell, part, fam, lo, hi, room, prev."""
    names = ["token", "cell", "fam", "lo", "hi", "room", "prev", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token, cell, *rest = columns
            if len(token) < 2:
                return
            group = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])])).astype(np.int64)
            size = np.bincount(group)[group]
            some = size > 1
            if not some.any():
                return
            for a, b in list_pairs(group[some], *(x[some] for x in rest), num, den):
                if len(a):
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            if kept is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(kept, columns)]
            token, cell = columns[:2]
            if not len(token):
                continue
            last = np.flatnonzero((token != token[-1]) | (cell != cell[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from pairs([x[:cut] for x in columns])
            kept = [x[cut:] for x in columns]
        if kept is not None:
            yield from pairs(kept)

    dealt = lists.select(*names).repartition("token", "cell").sortWithinPartitions("token", "cell")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """Lists of frequent shingles: a row per family, in cells of two parts, so that every two parts meet."""
    lists = rows.groupBy("token", "fam").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("room").alias("room"), F.min("prev").alias("p"), F.max("prev").alias("q"))
    lists = lists.withColumn("prev", F.when(F.col("p") == F.col("q"), F.col("p")).otherwise(F.lit(0))).drop("p", "q")
    per = lists.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1").select("token", F.ceil(F.col("size") / HOT).cast("long").alias("parts"))
    lists = lists.join(per, "token").withColumn("own", F.pmod(F.xxhash64("fam"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    lists = lists.select("*", other)
    cell = F.least("own", "other") * F.lit(1 << 24) + F.greatest("own", "other") + 1
    return lists.withColumn("cell", cell).withColumn("part", F.when(F.col("own") == F.col("other"), F.lit(0)).otherwise(F.col("own") + 1))


def _classes(docs: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """doc_id, h, n and class (a node; null without words) of every row of ``docs`` (doc_id, text)."""
    lean(docs.sparkSession)
    rows = scratch.keep(_sketches(docs, k, num, den, _levels(docs, k)), "sketches")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min_by(F.struct("doc_id", "h", "n", "keys", "bits"), first).alias("s"))
    nodes = scratch.keep(nodes.select("node", F.coalesce("s.doc_id", F.lit(NO_ID)).alias("doc"), "s.h", "s.n", "s.keys", "s.bits"), "nodes")
    families = Families(nodes, docs, scratch, k, num, den)
    families.build()

    who = nodes.select("node", "doc", "h").join(families.members.select("node", "fam"), "node", "left").select("node", "doc", "h", F.coalesce("fam", "node").alias("fam"))
    own = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "h", "node", "n", "prefix", "cold").join(small(scratch.keep(who, "who")), ["node", "doc", "h"])
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("prefix", 1, F.size("prefix") - 1))
    lists = own.select("fam", "n", "cold", F.posexplode(F.arrays_zip(F.col("prefix").alias("token"), before.alias("prev"))).alias("pos", "e"))
    lists = lists.select(
        F.col("e.token").alias("token"), "fam", F.col("n").alias("lo"), F.col("n").alias("hi"), (F.col("n") - F.col("pos")).alias("room"), F.col("e.prev").alias("prev"),
        (F.col("pos") < F.col("cold")).alias("fits"),
    )
    short = lists.filter("fits").drop("fits").withColumns({"cell": F.lit(0).cast("long"), "part": F.lit(0).cast("long")})
    pairs = scratch.keep(_candidates(short.unionByName(_dealt(lists.filter("NOT fits").drop("fits")).select(*short.columns)), num, den), "candidates")

    # What lists and families were made of takes room that the next steps need.
    rows = scratch.keep(rows.select("doc_id", "h", "n", "node"), "rows")
    scratch.drop("sketches", "who")
    # Written one after the other: as one statement with what follows, their plans took the driver the more memory.
    links = scratch.keep(families.inside(), "links-inside").unionByName(scratch.keep(families.across(pairs), "links-across"))
    scratch.drop(*(name for name in scratch.names if name not in ("rows", "links-inside", "links-across")))
    # Texts of one doc_id are one node.
    named = rows.filter("n > 0 AND doc_id IS NOT NULL")
    several = named.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b <> most")
    several = named.select("doc_id", F.col("node").alias("a")).join(several, "doc_id").select("a", "b")
    joined = components(links.unionByName(several)).withColumnsRenamed({"component": "class"})
    found = rows.select("doc_id", "h", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(joined, "node", "left")
    return scratch.only(found.select("doc_id", "h", "n", F.coalesce("class", "node").alias("class")), "classes")


def classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text): sets are linked when
    den * intersection >= num * union; component_id is the smallest doc_id reachable."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _classes(docs, k, num, den, Scratch(docs.sparkSession, "jaccard"))
    top = found.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).filter("size > 1").drop("size")
    found = found.join(top, "class", "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each class, with the columns of ``docs``: the smallest doc_id (nulls last), then the smallest hash of the text; of
    rows with equal doc_id and text, the one that comes first as JSON. Rows without words all stay."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("h")]
    scratch = Scratch(docs.sparkSession, "one-of-each")
    found = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, num, den, scratch)
    found = found.filter("n > 0").select(key[0], "h", "class")
    # A null doc_id is the last of its class.
    order = F.struct(F.col("doc") == NO_ID, "doc", "h")
    best = found.groupBy("class").agg(F.min(order).alias("best"), F.count("*").alias("size")).filter("size > 1")
    # One row for each text of a class of several: whether it goes, and whether rows repeat it. Told once, for each is asked of it several times.
    goes = F.bool_or(F.struct("doc", "h") != F.struct("best.doc", "best.h")).alias("goes")
    told = scratch.only(found.join(best, "class").groupBy("doc", "h").agg(goes, F.count("*").alias("count")).filter("goes OR count > 1"), "told")
    gone, again = told.filter("goes").select("doc", "h"), told.filter("count > 1").select("doc", "h")
    rows = _met(packed(docs, doc=key[0], h=key[1]), gone, "left_anti")
    one = _met(rows, again, "left_semi").groupBy("doc", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return spread(_met(rows, again, "left_anti").select("row").union(one.select("row")), docs)
