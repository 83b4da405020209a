"""Global ranks without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in the order, from 1; ties are dealt out arbitrarily but once.

    Rows are range-partitioned and numbered within partitions; only the sizes of
    partitions are summed in one place.
    """
    from treeline.operators.dataset import stored

    # the low 33 bits of the identifier number the rows of a partition
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    own = stored(own.withColumns({"_p": F.shiftright("_m", 33), "_n": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m"))
    sizes = own.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).select("_p", "_b")
    return own.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_n") + 1).drop("_p", "_n", "_b")
