"""Per-token vector output (J1-J3): layer choice, nested records, lookups.

Layer outputs of an example are arrays of token vectors; the nested record is
built with ``transform`` over the real tokens of each row, so no explode and no
regrouping is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_layers(layers: Column, indexes: list[int]) -> Column:
    """Layers chosen by (negative) index, e.g. [-1, -2, -3, -4]."""
    return F.array(*[F.element_at(layers, i) for i in indexes])


def token_vectors(df: DataFrame, id_col: str, tokens_col: str, layers_col: str, indexes: list[int],
                  digits: int = 6) -> DataFrame:
    """One record per input line: ``linex_index`` and, for every real token
    (padding left out), its vectors in the chosen layers rounded to ``digits``.

    ``layers_col`` holds array<layer>, layer = array<vector over tokens>, vector = array<double>."""
    chosen = select_layers(F.col(layers_col), indexes)
    idx = F.array(*[F.lit(i) for i in indexes])
    feats = F.transform(
        F.col(tokens_col),
        lambda tok, t: F.struct(
            tok.alias("token"),
            F.transform(
                F.arrays_zip(idx.alias("i"), chosen.alias("l")),
                lambda z: F.struct(
                    z["i"].alias("index"),
                    F.transform(z["l"][t], lambda v: F.round(v, digits)).alias("values"),
                ),
            ).alias("layers"),
        ),
    )
    return df.select(F.col(id_col).cast("long").alias("linex_index"), feats.alias("features"))


def vector_of(df: DataFrame, position: int, layer: int) -> DataFrame:
    """The token and vector of one position in one listed layer."""
    f = F.element_at(F.col("features"), position + 1)
    return df.select("linex_index", f["token"].alias("token"), F.element_at(f["layers"], layer + 1)["values"].alias("values"))
