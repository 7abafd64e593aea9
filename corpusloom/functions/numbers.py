"""Numbers as Python rounds and shows them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def rounded(digits: int):
    """A pandas UDF: the nearest decimal of so many digits to the binary double, half to even, as Python's ``round`` has it."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if pd.isna(x) else round(x, digits))

    return run
