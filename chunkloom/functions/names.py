"""Functions on archive member names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the multiplier of the name hash.
NAME_PRIME = 1099511628211


def strip_version(name: Column) -> Column:
    """The name behind its first component (the version's folder)."""
    return F.regexp_replace(name, "^[^/]*/", "")


def directory_path(name: Column) -> Column:
    """From the first slash on, without the last component; paths of four slashes or more lose the last two."""
    parts = F.split(name, "/", -1)
    n = F.size(parts)
    keep = F.when(n - 1 >= 4, n - 3).otherwise(n - 2)
    return F.when(n >= 2, F.concat(F.lit("/"), F.array_join(F.slice(parts, 2, F.greatest(keep, F.lit(0))), "/")))


@F.pandas_udf(T.StringType())
def name_hash(names: pd.Series) -> pd.Series:
    """h = h * NAME_PRIME + byte, modulo 2^64, as a decimal string; null stays null."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        b = np.frombuffer(x.encode(), np.uint8).astype(np.uint64)
        p = np.full(len(b), NAME_PRIME, np.uint64)
        if len(b):
            p[0] = 1
        return str(int((b * np.multiply.accumulate(p)[::-1]).sum(dtype=np.uint64))) if len(b) else "0"

    return names.map(one, na_action=None)
