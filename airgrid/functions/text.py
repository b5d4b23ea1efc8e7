"""Station-name normalisation (the one place Python runs per value).

Spark SQL has no Unicode NFKD normaliser, so the fold runs as an Arrow-batched
pandas UDF.  Callers apply it to the *distinct* names only and join the result
back, so Python sees one value per station, not one per reading.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def fold_name(value) -> str:
    """Text of the value, quotes removed, NFKD-folded to ASCII, stripped."""
    text = "None" if value is None else str(value)
    text = text.replace('"', "")
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("utf-8")
    return text.strip()


@pandas_udf(StringType())
def fold_name_udf(names: pd.Series) -> pd.Series:
    return names.map(fold_name)


def clean_names(df: DataFrame, col: str = "location") -> DataFrame:
    """Replace ``col`` by its folded form, computing the fold once per distinct name.

    The name dimension is tiny next to the readings; AQE turns the join back into
    a broadcast join when its runtime size is under the broadcast threshold and
    keeps a shuffle join otherwise.
    """
    raw = "_raw_name"
    names = (df.select(F.col(col).alias(raw)).distinct()
             .withColumn("_clean_name", fold_name_udf(F.col(raw))))
    joined = df.join(names, df[col].eqNullSafe(names[raw]), "left")
    cols = [F.col("_clean_name").alias(col) if c == col else df[c] for c in df.columns]
    return joined.select(*cols)

