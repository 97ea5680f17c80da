"""Ratcliff-Obershelp similarity as an Arrow-batched UDF.

The ratio is ``2*M/T`` from the standard library's ``difflib.SequenceMatcher``
with the catalog name as the first argument (the ratio is not symmetric).
Callers prefilter pairs natively with the length bound ``2*min/(la+lb)`` so
only pairs that can reach the threshold cross into Python.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def ratio_py(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from lengths alone (exact, lossless filter)."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * F.least(la, lb) / (la + lb))
