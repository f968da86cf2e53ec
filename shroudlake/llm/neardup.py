"""MinHash near-duplicates by a multi-index Hamming join.

A text's signature has 64 MinHash symbols of 16 bits in 16 chunks of 4. Two texts whose signatures differ in 31
symbols at most have, by the pigeonhole principle, a chunk with one difference at most; so the join enumerates the
allowed error of each chunk (the chunk without one of its symbols: 64 keys a text) and finds all such pairs. A pair of
Jaccard similarity 0.8 differs in 12.8 symbols on average, and in more than 31 with a probability below 1e-6.

Within a bucket pairs aren't all written out. Each member is first compared with the smallest one, and in large buckets
then with a few others. What that doesn't join to the bucket's largest component is compared with all members in blocks
of bounded size inside tasks, on short forms of the sets (by signatures alone where a set is large), and only pairs
that pass are written. Where that would be many blocks the bucket is first split by a second key that loses no pair
either. All links are confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .components import components

CHUNKS, LANES = 16, 4
SYMBOLS = CHUNKS * LANES
#: Most differing symbols for which a chunk with one error at most is certain.
RADIUS = 2 * CHUNKS - 1
#: Members of a bucket that are compared with each other in one go.
BLOCK = 2048
#: Pairs of blocks beyond which a bucket is split by a second key.
SPLIT = 64
#: Members, one after the other, with which all members of a bucket of more than one block are compared first.
STARS = 3
#: Shingles in a set's short form, which is all of them (in 32 bits) up to so many, else a sample by hash.
SHORT = 1024
#: Standard deviations below the similarity asked for that an estimate from samples may have.
SIGMAS = 5.3

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (xor-shift, multiply, twice)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _seeds(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    state = _mix(np.arange(seed << 20, (seed << 20) + 2 * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return state[:n] | np.uint64(1), state[n:]


class _Hashes(dict):
    """The hash of a word; forgets when it gets large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Shingler:
    """Shingle sets, as sorted distinct 64-bit hashes, and MinHash values of them."""

    def __init__(self, words: int):
        self.words, self.hashes = words, _Hashes()
        self.factors = _seeds(words, 3)[0]

    def split(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z alone, ASCII white space alone

    def shingles(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        x = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n, k = len(x) - self.words + 1, self.words
        with np.errstate(over="ignore"):
            if n < 1:
                return _mix(np.array([(x * self.factors[: len(x)]).sum() + np.uint64(len(x))], np.uint64))
            total = x[:n] * self.factors[0]
            for j in range(1, k):
                total += x[j : j + n] * self.factors[j]
            return np.unique(_mix(total))

    @staticmethod
    def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low = np.full(len(a), _ALL)
        with np.errstate(over="ignore"):
            for at in range(0, len(shingles), 1024):
                low = np.minimum(low, (shingles[at : at + 1024, None] * a + b).min(axis=0))
            return _mix(low)


def signatures(df: DataFrame, key: str, text: str, words: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """The key, n_shingles, class (a digest of the normalised words; null without words), signature (16 longs), row (a hash of
    key and text) and carry."""
    base = df.select(F.col(key), F.col(text), F.xxhash64(key, text).alias("row"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (a, b) = Shingler(words), _seeds(SYMBOLS, 1)
        for batch in batches:
            counts, classes, signs = [], [], np.zeros((batch.num_rows, CHUNKS), np.int64)
            for i, t in enumerate(batch.column(1)):
                split = shingler.split(t.as_py())
                found = shingler.shingles(split)
                counts.append(len(found))
                classes.append(hashlib.md5(b" ".join(split)).digest() if split else None)
                if split:
                    signs[i] = (shingler.minima(found, a, b) >> np.uint64(48)).astype("<u2").view("<i8")
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * CHUNKS, CHUNKS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(classes, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(signs.ravel())), *batch.columns[2:]], names=[key, "n_shingles", "class", "signature", "row", *carry])

    carried = "".join(f", {c} {base.schema[c].dataType.simpleString()}" for c in carry)
    return base.mapInArrow(run, f"{key} {base.schema[key].dataType.simpleString()}, n_shingles long, class binary, signature array<long>, row long{carried}")


def _short(shingles: np.ndarray) -> np.ndarray:
    """32 bits of each shingle, sorted; of large sets those below a power of two alone, so that two samples compare."""
    bits = (shingles >> np.uint64(32)).astype(np.uint32)  # sorted already
    return bits[: np.searchsorted(bits, 1 << (32 - _halvings(len(shingles))))] if len(shingles) > SHORT else bits


def _halvings(n: int) -> int:
    return max(0, (max(n, 1) - 1) // SHORT).bit_length()


def _maybe(p: np.ndarray, q: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m shingles with short forms p and q can have the similarity.

    Never false for such a pair if both have all their shingles (SHORT at most); an estimate from samples can be."""
    halvings = max(_halvings(n), _halvings(m))
    if halvings:
        p, q = (x[: np.searchsorted(x, 1 << (32 - halvings))] for x in (p, q))
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return True
    common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    if not halvings:
        return 100 * (common + 2) >= percent * (n + m - common - 2)  # 2 for shingles that meet in 32 bits
    union, share = len(p) + len(q) - common, percent / 100
    return common / union >= share - SIGMAS * (share * (1 - share) / union) ** 0.5


def _sets(df: DataFrame, text: str, words: int) -> DataFrame:
    """node, set (sorted hashes) and short form of each row of df (node, class, text) whose text is of the class."""
    base = df.select("node", "class", F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            nodes, found = [], []
            for node, name, t in zip(*batch.columns, strict=True):
                split = shingler.split(t.as_py())
                if hashlib.md5(b" ".join(split)).digest() == name.as_py():
                    nodes.append(node.as_py())
                    found.append(shingler.shingles(split))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([_short(x).tobytes() for x in found], pa.binary())], names=["node", "set", "short"])

    return base.mapInArrow(run, "node long, set binary, short binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets."""
    kind = pairs.schema["a"].dataType.simpleString()
    side = lambda n: sets.select(F.col("node").alias(n), F.col("set").alias(f"_{n}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                p, q = (p, q) if len(p) < len(q) else (q, p)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                keep[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _lanes(x: str, y: str) -> F.Column:
    """In how many symbols two signatures differ, by bit operations on longs of four symbols each: two at a time, since a
    symbol other than 0 plus 0xFFFF carries a bit into the free place above it. A column is written out wherever it is
    used, so each is used once or twice."""
    total, two, carries = F.lit(0), F.lit(0x0000FFFF0000FFFF), F.lit(0x0001000000010000)
    for c in range(CHUNKS):
        d = F.col(x)[c].bitwiseXOR(F.col(y)[c])
        for half in (d, F.shiftrightunsigned(d, 16)):
            total = total + F.bit_count((half.bitwiseAND(two) + two).bitwiseAND(carries))
    return total


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in blocks of buckets, close by signature and by short form.

    rows: bucket, which (the bucket's key number), i (a block of those that are compared with all), j (a block of all),
    mine and own (the row's blocks; mine is -1 for members of the largest component), node, component, n_shingles,
    signature, short. A pair is given in the first bucket that both share alone. A task holds two blocks of one bucket.
    A pair with a set of more than SHORT shingles is given by its signatures alone, since samples could lose a link.
    """
    kind = rows.schema["node"].dataType.simpleString()
    ordered = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def pairs_of(group: list[dict]) -> Iterator[tuple]:
        comp = np.unique(np.array([str(r["component"]) for r in group]), return_inverse=True)[1]
        if comp.max() == 0:
            return
        sign = np.array([r["signature"] for r in group], "<i8").view("<u2").reshape(len(group), SYMBOLS)
        n = np.array([r["n_shingles"] for r in group], np.int64)
        which, i, j = (group[0][c] for c in ("which", "i", "j"))
        mine, own, nodes = (np.array([r[c] for r in group]) for c in ("mine", "own", "node"))
        others = np.flatnonzero(own == j)
        shorts: dict[int, np.ndarray] = {}

        def short(i: int) -> np.ndarray:
            if i not in shorts:
                shorts[i] = np.frombuffer(group[i]["short"], np.uint32)
            return shorts[i]

        for k in np.flatnonzero(mine == i).tolist():
            at = others[(mine[others] < 0) | (nodes[others] > nodes[k])]  # two that are both compared with all meet twice
            at = at[(comp[at] != comp[k]) & (100 * np.minimum(n[at], n[k]) >= percent * np.maximum(n[at], n[k]))]
            if not len(at):
                continue
            same = sign[at] == sign[k]
            near = same.sum(axis=1) >= SYMBOLS - RADIUS
            at, same = at[near], same[near].reshape(-1, CHUNKS, LANES)
            if not len(at):
                continue
            # shared key c * LANES + j: all symbols of chunk c but the j-th are the same
            shared = (same.sum(axis=2)[:, :, None] - same) == LANES - 1
            first = shared.reshape(len(at), SYMBOLS).argmax(axis=1)
            for m in at[first == which].tolist():
                if max(n[k], n[m]) > SHORT or _maybe(short(k), short(m), int(n[k]), int(n[m]), percent):
                    x, y = group[k]["node"], group[m]["node"]
                    yield (x, y) if x < y else (y, x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        made: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"a": x, "b": y} for x, y in made], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                t = batch.schema.field("node").type
                arrow = pa.schema([("a", t), ("b", t)])
            for r in batch.to_pylist():
                this = (r["bucket"], r["i"], r["j"])
                if this != name:
                    if len(held) > 1:
                        made.extend(pairs_of(held))
                        if len(made) > 10_000:
                            yield out()
                            made.clear()
                    held, name = [], this
                held.append(r)
        if len(held) > 1:
            made.extend(pairs_of(held))
        if made:
            yield out()

    return ordered.mapInArrow(run, f"a {kind}, b {kind}")


def classes(base: DataFrame, key: str) -> DataFrame:
    """Each class of equal words with a number of its own (node), its smallest key and one of its rows.

    Numbers stand for digests to keep joins narrow; they are those of a checkpoint, so they last.
    """
    found = base.where(F.col("class").isNotNull() & F.col(key).isNotNull()).groupBy("class")
    found = found.agg(F.min(key).alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.min("row").alias("row"))
    return cut(found.withColumn("node", F.monotonically_increasing_id()))


def _mixed(members: DataFrame) -> DataFrame:
    """(bucket, which, most, own_blocks, my_blocks) of the buckets whose members aren't all of one component: the largest
    component, and the blocks of all members and of those outside of it."""
    each = members.groupBy("bucket", "which", "component").agg(F.count("*").alias("_n"))
    found = each.groupBy("bucket", "which").agg(F.max(F.struct("_n", "component")).alias("_most"), F.sum("_n").alias("_m")).where(F.col("_m") > F.col("_most._n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    return found.select("bucket", "which", F.col("_most.component").alias("most"), blocks(F.col("_m")).alias("own_blocks"), blocks(F.col("_m") - F.col("_most._n")).alias("my_blocks"))


def _in_blocks(members: DataFrame, mixed: DataFrame) -> DataFrame:
    """The members of mixed buckets once for each pair of blocks (i, j) that they are in, with their own blocks."""
    rows = members.join(mixed, ["bucket", "which"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("own_blocks")).cast("int"))
    rows = rows.withColumn("mine", F.when(F.col("component") == F.col("most"), -1).otherwise(F.pmod(F.xxhash64("node"), F.col("my_blocks"))).cast("int"))
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    as_own = F.transform(F.sequence(F.lit(0), F.col("my_blocks") - 1), lambda i: pair(i, F.col("own")))
    as_mine = F.transform(F.sequence(F.lit(0), F.col("own_blocks") - 1), lambda j: pair(F.col("mine"), j))
    return rows.select("bucket", "which", "node", "component", "own", "mine", F.inline(F.when(F.col("mine") < 0, as_own).otherwise(F.array_union(as_own, as_mine))))


def _split(members: DataFrame, narrow: DataFrame) -> DataFrame:
    """The members of heavy buckets in finer ones: by two symbols of a later chunk, for each two of each later chunk.

    A pair counts in its first bucket alone, say of chunk c: earlier chunks then differ in two symbols at least, so the
    15 - c later ones differ in 31 - 2c at most, and unless c is 14 or 15 one of them in two at most: it has two in common.
    """
    keys = []
    for c in range(1, CHUNKS):
        for number, two in enumerate(combinations(range(LANES), 2)):
            kept = sum(0xFFFF << (16 * lane) for lane in two)
            masked = F.col("signature")[c].bitwiseAND(F.lit(kept - (1 << 64) if kept >> 63 else kept))
            keys.append(F.when(F.col("which") < LANES * c, F.xxhash64(F.col("bucket"), F.lit(c), F.lit(number), masked)))
    wide = members.join(narrow, "node").select("which", "node", "component", F.explode(F.array_compact(F.array(*keys))).alias("bucket"))
    return wide.select("bucket", "which", "node", "component")


def links(reps: DataFrame, df: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame | None:
    """(node, component) of the classes that have links; reps is from classes."""
    keys = []
    for c in range(CHUNKS):
        for j in range(LANES):
            masked = F.col("signature")[c].bitwiseAND(F.lit((~(0xFFFF << (16 * j))) & 0xFFFFFFFFFFFFFFFF if j == LANES - 1 else ~(0xFFFF << (16 * j))))
            keys.append(F.struct(F.lit(c * LANES + j).cast("byte").alias("which"), F.xxhash64(F.lit(c * LANES + j), masked).alias("bucket")))
    keyed = reps.select("node", F.explode(F.array(*keys)).alias("_k")).select("node", "_k.which", "_k.bucket")
    buckets = keyed.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("_n")).where("_n > 1").select("bucket", "lead")
    members = cut(keyed.join(buckets, "bucket"))
    nodes = cut(members.select("node").distinct().join(reps.select("node", "class", "row"), "node"))
    if nodes.isEmpty():
        return None
    nodes = small(nodes)
    rows = df.select(F.xxhash64(key, text).alias("row"), F.col(text).alias("text"))
    sets = cut(_sets(rows.join(nodes, "row"), "text", words))
    narrow = reps.join(nodes.select("node"), "node", "left_semi")
    side = lambda n: narrow.select(F.col("node").alias(n), F.col("n_shingles").alias(f"_n{n}"), F.col("signature").alias(f"_s{n}"))

    def star(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        close = pairs.join(side("a"), "a").join(side("b"), "b").where((100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")) & (_lanes("_sa", "_sb") <= RADIUS))
        return cut(_confirm(close, sets, percent))

    def join(more: DataFrame, joined: DataFrame) -> DataFrame:
        """(node, component) once the pairs of more are links too."""
        return cut(components(more.union(joined.select(F.col("component").alias("a"), F.col("node").alias("b")))))

    def placed(rows: DataFrame, joined: DataFrame) -> DataFrame:
        """Members (bucket, which, node) with their components."""
        return rows.select("bucket", "which", "node").join(joined, "node", "left").select("bucket", "which", "node", F.coalesce("component", "node").alias("component"))

    joined = cut(components(star(members.where(F.col("lead") != F.col("node")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())))
    rest = placed(members.where(F.col("lead") != F.col("node")), joined)
    mixed = cut(_mixed(rest))
    rest = cut(rest.join(mixed.select("bucket"), "bucket"))  # components only grow, so other buckets are done with
    for k in range(STARS):
        large = mixed.where("own_blocks > 1").select("bucket")
        if large.isEmpty():
            break
        some = rest.join(large, "bucket")
        leads = some.groupBy("bucket").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(k))).alias("_lead"))
        pairs = some.join(leads, "bucket").where(F.col("component") != F.col("_lead.component")).select(F.col("_lead.node").alias("a"), F.col("node").alias("b"))
        more = star(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if not more.isEmpty():
            joined = join(more, joined)
            rest = cut(placed(rest, joined))
            mixed = cut(_mixed(rest))
    heavy = mixed.where((F.col("own_blocks").cast("long") * F.col("my_blocks") > SPLIT) & (F.col("which") < LANES * (CHUNKS - 2))).select("bucket")
    if heavy.isEmpty():
        parts = _in_blocks(rest, mixed)
    else:
        finer = cut(_split(rest.join(heavy, "bucket"), narrow))
        parts = _in_blocks(rest, mixed.join(heavy, "bucket", "left_anti")).unionByName(_in_blocks(finer, cut(_mixed(finer))))
    rows = parts.join(narrow, "node").join(sets.select("node", "short"), "node").select("bucket", "which", "i", "j", "mine", "own", "node", "component", "n_shingles", "signature", "short")
    more = cut(_confirm(_compare(rows, percent).distinct(), sets, percent))
    return joined if more.isEmpty() else join(more, joined)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """Groups of near-duplicate texts: the key, n_shingles, component_id and kept (the key is the component's).

    Texts are lower-cased (A-Z), split at ASCII white space and taken as sets of shingles of `words` words; a shorter
    text is one shingle, and a text without words is linked with nothing. Texts are linked if
    100 * intersection >= percent * union; component_id is the smallest key that is reachable.

    Null and empty texts have no shingles and stay. A row without a key isn't linked: its component is null and it stays.
    Equal texts form a class first, however many they are. Repeated rows get the same result each, so they all stay or
    go; where one key has several texts, each row has the links of its own text. An empty table gives an empty result.
    Other columns than those of carry, which come last, are left out.
    """
    base = cut(signatures(df, key, text, words, carry))
    reps = classes(base, key)
    joined = links(reps, df, key, text, words, percent)
    first = reps.select("class", F.col("key").alias("component_id"))
    if joined is not None:
        linked = cut(reps.select("node", "key").join(joined, "node"))
        least = cut(linked.groupBy("component").agg(F.min("key").alias("least")))
        least = linked.select("node", "component").join(small(least), "component").select("node", "least")
        first = reps.select("node", "class", "key").join(least, "node", "left").select("class", F.coalesce("least", "key").alias("component_id"))
    out = base.select(key, "n_shingles", "class", *carry).join(first, "class", "left")
    component = F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)).alias("component_id")
    return out.select(key, "n_shingles", component, *carry).select(key, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"), *carry)
