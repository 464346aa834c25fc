"""Standard forms of the identifiers used in catalogs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def standard_tile(tile: Column) -> Column:
    """Two digits and three capitals from any delivered spelling; NULL if no letter or digit is left.

    Case, blanks and separators are ignored, a leading T is dropped and a lone zone digit gets its zero. What isn't
    zone, band and square then is kept as it is in capitals, so nothing is silently lost.
    """
    bare = F.regexp_replace(F.upper(tile), r"[^A-Z0-9]", "")
    core = F.regexp_replace(bare, r"^T(?=[0-9]{1,2}[A-Z]{3}$)", "")
    return F.when(bare != "", F.when(core.rlike(r"^[0-9][A-Z]{3}$"), F.concat(F.lit("0"), core)).otherwise(core))


def standard_split(name: Column) -> Column:
    """train, val or test from the long and short names in any case, blanks around them ignored; NULL for anything else."""
    low = F.lower(F.trim(name))
    return (
        F.when(low.isin("train", "training"), "train")
        .when(low.isin("val", "validation"), "val")
        .when(low.isin("test", "testing"), "test")
    )


def one_row_per_id(df, id_col: str, *cols: str):
    """One row per non-null id with the named columns.

    Rows of one id that agree are merged; where they disagree the least row wins, whatever the order of arrival.
    Other columns are not read.
    """
    rest = [c for c in cols if c != id_col]
    kept = df.select(id_col, *rest).filter(F.col(id_col).isNotNull())
    if not rest:
        return kept.distinct()
    return kept.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("_row")).select(id_col, *[F.col("_row")[c].alias(c) for c in rest])
