"""Packed sheets: text whose characters are the bytes of a deflated JSON document."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def inflate(packed: pd.Series) -> pd.Series:
    """The JSON text of a packed sheet; the low byte of each character counts. Null for null, empty
    or broken input."""

    def text(value: str | None) -> str | None:
        if not value:
            return None
        try:
            return zlib.decompress(bytes(ord(c) & 255 for c in value)).decode()
        except (zlib.error, UnicodeDecodeError):
            return None

    return packed.map(text)
