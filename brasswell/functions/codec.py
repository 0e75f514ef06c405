"""Vectors as text: a signed byte for each component, or its four float bytes, in base64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from brasswell.functions.hashes import once

#: Up to so many components a vector is stored in bytes, else in floats.
BYTES = 512


def encode_bytes(v: Column) -> Column:
    byte = lambda x: F.lpad(F.hex(F.pmod(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x)) * 127 + 0.5), F.lit(256))), 2, "0")
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(v, byte), ""))), r"\s", "")  # Spark may break lines


def decode_bytes(text: Column) -> Column:
    """Components from -1 to 1 in steps of 1/127."""
    signed = lambda b: (F.when(b > 127, b - 256).otherwise(b)) / 127.0

    def values(plain: Column) -> Column:
        value = lambda k: F.conv(F.substr(plain, (2 * k + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        return F.transform(F.transform(F.sequence(F.lit(0), (F.length(plain) / 2 - 1).cast("int")), value), signed)

    return once(F.hex(F.unbase64(text)), values)


@F.pandas_udf(StringType())
def encode_floats(v: pd.Series) -> pd.Series:
    import base64

    return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())


@F.pandas_udf(ArrayType(FloatType()))
def decode_floats(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import base64

    for part in texts:
        yield part.map(lambda t: None if t is None else np.frombuffer(base64.b64decode(t), "<f4"))
