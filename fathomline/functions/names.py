"""Arguments that are columns or their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
