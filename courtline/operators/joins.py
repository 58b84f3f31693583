"""Role-playing dimension joins.

No join here asks for a broadcast: adaptive execution picks one from measured
bytes, and splits skewed partitions otherwise, so one program serves all sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def join_role(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
              renames: dict[str, str], how: str = "inner") -> DataFrame:
    """Join one role of a role-playing dimension (e.g. the home team).

    ``renames`` maps dimension columns to the names they take for this role, so
    the same dimension can be joined several times without ambiguity.
    """
    side = dim.select(F.col(dim_key).alias(f"__{fact_key}_k"),
                      *[F.col(c).alias(a) for c, a in renames.items()])
    return (fact.join(side, F.col(fact_key) == F.col(f"__{fact_key}_k"), how)
                .drop(f"__{fact_key}_k"))
