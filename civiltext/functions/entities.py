"""HTML character references; the one cleaning rule that needs Python."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescape_html(text: Column) -> Column:
    """All HTML5 references, named and numeric, in a single pass.

    Rows without the start of a reference, `&` before a letter or `#`, are sent to Python as null, so Arrow
    carries only texts that can change.
    """
    return F.coalesce(_unescape(F.when(text.rlike("&[#A-Za-z]"), text)), text)
