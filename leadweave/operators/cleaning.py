"""Stage ``html_cleaner``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.functions.text import clean_texts


def clean_strings(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Clean every string column; other types, ``_`` columns and ``skip`` pass unchanged.
    One projection, so all columns share a single Arrow exchange at most."""
    texts = [
        f.name for f in df.schema
        if isinstance(f.dataType, T.StringType) and not f.name.startswith("_") and f.name not in skip
    ]
    if not texts:
        return df
    cleaned = dict(zip(texts, clean_texts(*[F.col(f"`{c}`") for c in texts]), strict=True))
    return df.select([cleaned[c].alias(c) if c in cleaned else F.col(f"`{c}`") for c in df.columns])
