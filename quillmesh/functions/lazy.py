"""Arrow functions that are made when first used, so their modules import without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf(kind)``."""

    def wrap(fn: Callable) -> Callable[..., Column]:
        @functools.wraps(fn)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(fn, kind)(*columns)

        return call

    return wrap


def vector(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``arrow_udf(kind)``: whole Arrow arrays in and out, no pandas between."""
    import pyarrow as pa

    def wrap(fn: Callable) -> Callable[..., Column]:
        names = [n for n in fn.__code__.co_varnames[: fn.__code__.co_argcount]]
        fn.__annotations__ = {**dict.fromkeys(names, pa.Array), "return": pa.Array}

        @functools.wraps(fn)
        def call(*columns: Column | str) -> Column:
            return F.arrow_udf(fn, kind)(*columns)

        return call

    return wrap
