"""Connected components of an edge table, and text lookups for pairs of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendra.llm.common import cut

#: Bits of the filter that keeps texts without a partner from being shuffled: 2 MB.
FILTER_BITS = 1 << 24
_BUCKET = 1 << 15


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of an edge (a, b); label: the smallest id it is linked with.

    Each round takes the smallest label of a node's neighbours and then the label of its
    label, so paths shorten by half or more; a round's table is cut.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        closer = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("via"))
        further = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        moved = cut(
            closer.join(further, "via", "left")
            .select("id", F.col("label").alias("was"), F.least("via", "far").alias("label"))
        )
        if moved.filter("label <> was").isEmpty():
            return moved.select("id", "label")
        labels = moved.select("id", "label")


def maybe_in(keys: DataFrame, key: Column) -> Column:
    """True for every key of the one-column table ``keys``, and for few others.

    A bitmap of fixed size: as keys grow it lets more rows pass, never fewer.
    """
    name = keys.columns[0]
    at = F.pmod(F.xxhash64(F.col(name)), F.lit(FILTER_BITS))
    rows = (
        keys.select(F.shiftright(at, 15).alias("bucket"), (at % _BUCKET).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    )
    maps = {row["bucket"]: bytes(row["bits"]) for row in rows}
    table = F.array(*[F.lit(maps.get(i)).cast("binary") for i in range(FILTER_BITS // _BUCKET)])
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bit = (place % _BUCKET).cast("int")
    byte = F.substring(F.get(table, F.shiftright(place, 15).cast("int")), F.shiftright(bit, 3) + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.coalesce(F.floor(value / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))
