"""Space that a log no longer needs, and free byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.schemas import FREE, SAVE


def superseded(log: DataFrame) -> DataFrame:
    """Saves that a later save or free of the same key made needless."""
    w = Window.partitionBy("table", "key").orderBy(F.desc("seq"))
    return log.withColumn("rn", F.row_number().over(w)).where((F.col("op") == SAVE) & (F.col("rn") > 1)).drop("rn")


def reclaimable(log: DataFrame) -> DataFrame:
    """Bytes and rows of each table that compaction would give back; tables without any have no row.

    All saves less the surviving ones (of equal seq the save, then the longer payload); a null payload has no bytes. Hash aggregates of fixed width,
    so no key's history is sorted or gathered.
    """
    saved, size = F.col("op") == SAVE, F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint")
    order = (F.col("seq").cast("decimal(19,0)") * 2 + saved.cast("int")) * F.lit(1 << 31) + size
    keys = log.groupBy("table", "key").agg(
        F.count_if(saved).alias("n"), F.sum(F.when(saved, size)).alias("b"), F.max_by(F.when(saved, size), order.cast("decimal(38,0)")).alias("last"),
    )
    old = keys.groupBy("table").agg(
        (F.sum("n") - F.count("last")).alias("rows"), (F.coalesce(F.sum("b"), F.lit(0)) - F.coalesce(F.sum("last"), F.lit(0))).alias("bytes")
    )
    return old.where("rows > 0")


def counters(log: DataFrame) -> DataFrame:
    """Frees and saves of each table."""
    return log.groupBy("table").agg(F.count_if(F.col("op") == FREE).alias("frees"), F.count_if(F.col("op") == SAVE).alias("saves"))


def best_fit(blocks: DataFrame, need: int) -> DataFrame:
    """The smallest free block (file, start, end) of each file with room for `need` bytes; of equal ones the first."""
    size = F.col("end") - F.col("start")
    fits = blocks.where(size >= need)
    return fits.groupBy("file").agg(F.min(F.struct(size.alias("size"), "start", "end")).alias("b")).select("file", "b.start", "b.end", "b.size")


def _level(start: str, end: str) -> Column:
    """Bits of the smallest bins (16, 256, ... places) of which a range that isn't empty meets two at most; 60 bits are the most."""
    far = F.coalesce(F.try_subtract(F.col(end).cast("bigint") - 1, F.col(start).cast("bigint")), F.lit((1 << 63) - 1))
    return F.least(F.lit(60), F.length(F.hex(far)) * 4)


def _bin(place: Column, tier: str) -> Column:
    return F.call_function("shiftright", place.cast("bigint"), F.abs(F.col(tier)))


def _binned(ranges: DataFrame, start: str, end: str, levels: DataFrame, tiers: Column) -> DataFrame:
    """Each range once for every tier, which may depend on the `levels` of the other side (one row), and bin that it meets."""
    tiered = ranges.join(F.broadcast(levels)).withColumn("tier", F.explode(tiers)).drop("levels", "level")
    return tiered.withColumn("bin", F.explode(F.sequence(_bin(F.col(start), "tier"), _bin(F.col(end) - 1, "tier"))))


def subtract(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Free blocks (file, start, end) without the spans (file, start, end) now in use: none, one or more remainders each.

    Every row of blocks counts, equal ones too; empty blocks have no remainder and empty spans use nothing. A null file is a file.
    A block and a span that overlap meet in a bin whose width suits the longer of the two, so an equi-join on file and bin finds
    them: where spans of a file don't overlap, nor blocks, its work is in proportion to their number and the widths there are
    (15 at most), whatever lies in one file. The gaps come from a window over the spans that a block holds.
    """
    taken, free = spans.where("start < end"), blocks.where("start < end")
    level = _level("start", "end").alias("level")
    b = free.groupBy("file", F.col("start").alias("b0"), F.col("end").alias("b1")).agg(F.count("*").alias("n"))
    s = taken.select(F.col("file").alias("in"), F.col("start").alias("s0"), F.col("end").alias("s1"), level)
    of = [x.select(level).agg(F.collect_set("level").alias("levels")) for x in (taken, free)]
    # Tiers above 0 are of blocks with the spans that are no longer, tiers below 0 of spans with the shorter blocks.
    longer = F.transform(F.filter("levels", lambda x: x > F.col("level")), lambda x: -x)
    b_at = _binned(b.withColumn("level", _level("b0", "b1")), "b0", "b1", of[0], F.concat(F.array("level"), longer)).withColumnsRenamed({"tier": "bt", "bin": "bb"})
    s_at = _binned(s, "s0", "s1", of[1], F.concat(F.array(-F.col("level")), F.filter("levels", lambda x: x >= F.col("level"))))
    met = b_at.join(s_at.hint("merge"), F.col("file").eqNullSafe(F.col("in")) & F.expr("bt = tier AND bb = bin AND b0 < s1 AND s0 < b1"))
    once = met.where(F.col("bin") == _bin(F.greatest("b0", "s0"), "tier")).select("file", "b0", "b1", "n", "s0", "s1")
    w = Window.partitionBy("file", "b0", "b1").orderBy("s0").rowsBetween(Window.unboundedPreceding, -1)
    ends = once.union(b.select("file", "b0", "b1", "n", F.col("b1").alias("s0"), F.col("b1").alias("s1")))
    gaps = ends.select("file", F.coalesce(F.max("s1").over(w), "b0").alias("start"), F.col("s0").alias("end"), "n").where("start < end")
    return gaps.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).select("file", "start", "end")
