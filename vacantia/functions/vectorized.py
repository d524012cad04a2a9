"""Arrow-batched functions that a module may define without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf(kind)``, but the type text is read when the function is used, on the driver."""

    def wrap(function: Callable) -> Callable[..., Column]:
        def use(*columns: Column) -> Column:
            return F.pandas_udf(function, kind)(*columns)

        use.__doc__ = function.__doc__
        return use

    return wrap
