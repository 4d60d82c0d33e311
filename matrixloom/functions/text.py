"""Text functions that tables of names and sequences need."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc_name(name: pd.Series) -> pd.Series:
    """A name in NFKC, case-folded, everything but letters and digits as single spaces."""
    return name.map(lambda s: None if s is None else re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", s).casefold()).strip())


def position_identity(a: Column, b: Column, length: int | Column) -> Column:
    """The share of places at which two texts agree."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0))) / length
