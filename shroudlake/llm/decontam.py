"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions alone.

Every item gives windows of its words, and a window is a set of shingles at known offsets. A document holds a window
only if it holds all of its shingles, so one of them is a sufficient prefix: the rarest of the benchmark, by one order
for all windows. Documents' shingles meet these prefixes alone, in blocks of windows that are small enough to be
broadcast; documents themselves are never shuffled. A candidate is bounded by position and length and confirmed over the
whole window where its document is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut, small

#: A run of letters, digits and anything beyond ASCII, after A-Z are lower-cased. (Its complement, as a negated class, is
#: many times slower.)
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 8, 4


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _part(words: str, start: Column, length: int | Column) -> Column:
    return F.array_join(F.slice(F.col(words), start + 1, F.lit(length) if isinstance(length, int) else length), " ")


def _shingle(words: str, at: Column, q: int) -> Column:
    """A hash of the q words from a place on."""
    return F.xxhash64(F.lit(q), *[F.get(F.col(words), at + k) for k in range(q)])


def _windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, window, length) of every distinct window of every item."""
    words = items.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    words = words.withColumn("length", F.least(F.size("_w"), F.lit(window)))
    starts = words.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_w") - F.col("length"))))
    return starts.select("item", _part("_w", F.col("_i"), F.col("length")).alias("window"), "length").distinct()


def _prefixes(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, length, h, offset): each window's shingle that is in the fewest windows, ties by hash."""
    kinds = windows.select("window", "length").distinct().withColumn("q", F.least("length", F.lit(shingle))).withColumn("_w", F.split("window", " "))
    parts = kinds.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("q"))))
    h = reduce(lambda c, q: c.when(F.col("q") == q, _shingle("_w", F.col("offset"), q)), range(2, shingle + 1), F.when(F.col("q") == 1, _shingle("_w", F.col("offset"), 1)))
    parts = cut(parts.select("window", "length", "offset", h.alias("h")))
    rarity = parts.groupBy("h").agg(F.count("*").alias("_df"))
    first = parts.join(rarity, "h").groupBy("window", "length").agg(F.min(F.struct("_df", "h", "offset")).alias("_p"))
    return cut(first.select("window", "length", F.col("_p.h").alias("h"), F.col("_p.offset").alias("offset")))


def contamination(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, min_items: int = 2, share: int | None = None) -> DataFrame:
    """What each document shares with a benchmark.

    Texts are lower-cased (A-Z) and split into words; a window is `window` consecutive words of an item, or all of a
    shorter item. Returns the key, n_words, n_hit (words inside any occurrence of a window), n_items (items with a
    window that occurs), items_sha256 (of the item ids as strings, sorted, joined by commas) and contaminated
    (n_items >= min_items). With a share, also n_most: item texts of `window` words at least of whose windows that
    many per cent occur.

    Null and empty texts have no words and no hits. Items without words or id count for nothing; items may share
    windows. Repeated rows each get the full result; rows with equal keys and other texts are kept apart; a null key
    is a key. An empty benchmark hits nothing; an empty table gives an empty result. Other columns are left out.
    """
    windows = cut(_windows(items, item, item_text, window))
    prefix = _prefixes(windows, shingle)
    n_prefix, bytes_prefix, shortest = prefix.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)), F.min("length")).first()
    lengths = range(min(shortest or shingle, shingle), shingle + 1)
    sizes = [q for q in lengths if q == shingle or not prefix.where(F.col("length") == q).isEmpty()]
    blocks = max(1, -(-n_prefix // max(1, common.BROADCAST_ROWS)), -(-bytes_prefix // max(1, common.BROADCAST_BYTES)))

    docs = df.select(F.col(key), words_of(F.col(text)).alias("_w"), F.xxhash64(key, text).alias("_k1"), F.hash(F.col(text), F.col(key)).alias("_k2"))
    # a row of its own for each document, at -1, then one for each word
    rows = docs.withColumn("_n", F.size("_w")).withColumn("_at", F.explode(F.sequence(F.lit(-1), F.col("_n") - 1)))
    hashes = [F.when((F.col("_at") >= 0) & (F.col("_at") <= F.col("_n") - q), _shingle("_w", F.col("_at"), q)) for q in sizes]
    if len(hashes) == 1:
        rows = rows.withColumn("h", hashes[0])
    else:
        rows = rows.withColumn("h", F.explode(F.when(F.col("_at") < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(*hashes))))
    start = F.col("_at") - F.col("offset")
    holds = F.col("window").isNotNull() & (start >= 0) & (start + F.col("length") <= F.col("_n")) & (_part("_w", start, F.col("length")) == F.col("window"))
    found = None
    for b in range(blocks):
        some = F.broadcast(prefix.where(F.pmod(F.hash("h"), F.lit(blocks)) == b))
        met = rows.join(some, "h", "inner" if b else "left").where(holds if b else holds | (F.col("_at") < 0))
        met = met.select(key, "_k1", "_k2", F.col("_n").cast("long").alias("n_words"), F.when(F.col("_at") >= 0, start).alias("start"), "length", "window")
        found = met if found is None else found.union(met)
    found = cut(found)

    doc = ["_k1", "_k2"]
    occurs = cut(found.where("start IS NOT NULL").select(*doc, "window", "length", "start").distinct())
    n_hit = occurs.select(*doc, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("_at")).distinct().groupBy(*doc).agg(F.count("*").alias("n_hit"))
    which = occurs.select(*doc, "window").distinct()
    n_items = which.join(small(windows.select("window", "item")), "window").select(*doc, "item").distinct()
    n_items = n_items.groupBy(*doc).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    out = found.where("start IS NULL").select(key, *doc, "n_words").join(n_hit, doc, "left").join(n_items, doc, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    extra = []
    if share is not None:
        name = F.sha2(F.concat_ws("|", F.col(item).cast("string"), F.col(item_text)), 256)  # one id may have several texts
        texts = cut(_windows(items.where(F.col(item).isNotNull()).select(name.alias("item"), F.col(item_text).alias("text")), "item", "text", window).where(F.col("length") == window))
        most = which.join(small(texts.select("window", "item")), "window").groupBy(*doc, "item").agg(F.count("*").alias("_n"))
        most = most.join(small(cut(texts.groupBy("item").agg(F.count("*").alias("_of")))), "item").where(100 * F.col("_n") >= share * F.col("_of"))
        out, extra = out.join(most.groupBy(*doc).agg(F.count("*").alias("n_most")), doc, "left"), [zero("n_most")]
    out = out.select(key, "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), *extra)
    return out.withColumn("contaminated", F.col("n_items") >= min_items)
