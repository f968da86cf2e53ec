"""What the training-data operators share: bounded joins, distributed running sums, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import checkpoint_dir, discard, scratch_path  # noqa: F401  (modules here take them from this one)
from ..shared import durable as cut

#: A word, for the operators that split at ASCII white space alone.
WORD = r"[^ \t\n\x0B\f\r]++"

#: A side of a join may be broadcast when it has been counted and has no more rows, and no more bytes of text, than this.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def size_of(df: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of text and binary columns; of a table beyond BROADCAST_ROWS only that it is."""
    wide = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    n, size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(sum(wide, F.lit(0).cast("long"))), F.lit(0))).first()
    return n, size


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is proven small, else df as it is (then Spark shuffles). df is evaluated: give a checkpoint."""
    n, size = size_of(df)
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def hash60(*cols: Column | str) -> Column:
    """The first 60 bits of the SHA-256 of the columns' text, as a long from 0; null counts as ''.

    The same value comes from any engine with SHA-256, so results can be checked outside Spark.
    """
    text = F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """A checkpoint of df, range-partitioned and sorted by `order`, with the partition as _part.

    Sampling balances the parts, so a group of any size is spread over several of them.
    """
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """A checkpoint of df with a number for each row, which lasts as long as the checkpoint."""
    return cut(df).withColumn(name, F.monotonically_increasing_id())


def running(df: DataFrame, group: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name in sums the sum of its column over the earlier rows of the group, by order: exclusive, from 0.

    Columns of group aren't null; without a group all rows are one. order makes all rows of a group differ (by a row's
    number at last), so ranges of even size can be cut anywhere, also between rows that are the same otherwise: no task
    holds a group, a key or a kind of row however large it is. Ranges are summed first, a row for each range and
    group, and hand their sums on.
    """
    names = list(sums)
    values = {f"_value{i}": c for i, c in enumerate(sums.values())}
    keep = df.columns
    df = in_ranges(df.withColumns(values), *group, *order)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*group, "_part").agg(*[F.sum(v).alias(v) for v in values])
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = parts.select(*group, "_part", *[zero(F.sum(v).over(before)).alias(f"_offset{i}") for i, v in enumerate(values)])
    out = [(F.col(f"_offset{i}") + zero(F.sum(v).over(inner))).alias(names[i]) for i, v in enumerate(values)]
    return df.join(offsets, [*group, "_part"]).select(*keep, *out)


def last_before(df: DataFrame, group: str, order: list[str], payload: Column, out: str) -> DataFrame:
    """Adds the last non-null payload among the earlier rows of the group: an as-of join of df with itself.

    order makes rows of a group distinct, and group isn't null. Rows are dealt by ranges of (group, order); each
    range finds the last payload inside, and ranges of one group hand theirs on, one row for each range.
    """
    df = in_ranges(df.withColumn("_payload", payload), group, *order)
    place = F.struct(*order)
    carry = df.where(F.col("_payload").isNotNull()).groupBy(group, "_part").agg(F.max_by("_payload", place).alias("_own"))
    carry = df.select(group, "_part").distinct().join(carry, [group, "_part"], "left")
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(group, "_part", F.last("_own", ignorenulls=True).over(earlier).alias("_carry"))
    inner = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = df.join(carry, [group, "_part"]).withColumn(out, F.coalesce(F.last("_payload", ignorenulls=True).over(inner), F.col("_carry")))
    return found.drop("_part", "_payload", "_carry")
