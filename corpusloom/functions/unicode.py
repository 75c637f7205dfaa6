"""Unicode normal forms, which no built-in function has: Arrow batches through the standard library."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(c: Column, form: str) -> Column:
    """A text in a normal form (NFC, NFD, NFKC, NFKD); null stays null."""

    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    work.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(work, "string")(c)


def without_marks(c: Column) -> Column:
    """A text without accents and other combining marks, whatever letters they stand on."""
    return normalized(F.regexp_replace(normalized(c, "NFD"), r"\p{Mn}", ""), "NFC")
