"""HTML entity decoding; Spark has no built-in for the HTML5 table, so this is an Arrow UDF."""

from __future__ import annotations

import html
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Batch functions travel to the workers by value, so that these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(StringType())
def _unescape_udf(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _unescape_twice_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda value: html.unescape(html.unescape(value)), na_action="ignore")


def unescape(text: Column) -> Column:
    """Decode entities once."""
    return _unescape_udf(text)


def unescape_twice(text: Column) -> Column:
    """Decode entities of a text that was escaped twice."""
    return _unescape_twice_udf(text)
