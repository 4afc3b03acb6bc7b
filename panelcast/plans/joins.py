"""Join helper for a dimension that keeps its unmatched rows.

Nothing is hinted: Spark broadcasts a side whose size (from file statistics,
or from finished shuffle stages under AQE) is within
``spark.sql.autoBroadcastJoinThreshold`` bytes, and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension_left_join(dim: DataFrame, fact: DataFrame, dim_key: str, fact_key: str) -> DataFrame:
    """``dim LEFT JOIN fact`` that stays balanced when one key is hot.

    A plain outer join keeps every dimension row, so Spark can neither
    broadcast the dimension nor let AQE split a skewed key on the fact side.
    Written instead as

    * matched rows: ``fact JOIN dim`` (inner, so a small dimension can be
      broadcast and AQE may split a hot fact key), and
    * unmatched rows: ``dim LEFT ANTI JOIN distinct(fact keys)``, where the
      distinct is a partial aggregate, so a hot key arrives as one row.

    The union has the rows and columns of the outer join; fact columns are
    null on unmatched rows.
    """
    matched = fact.join(dim, fact[fact_key] == dim[dim_key])
    keys = fact.select(F.col(fact_key).alias("__fk")).distinct()
    unmatched = dim.join(keys, dim[dim_key] == keys["__fk"], "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)
