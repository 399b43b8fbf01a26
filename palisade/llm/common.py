"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import materialise, ship_package

#: Where a row stands in its file; names that no table is likely to have.
FILE, ROW = "_llm_file", "_llm_row"


#: What is put behind a caller's columns of those names while rows are keyed.
_OWN = "_own"


def row_keyed(df: DataFrame) -> DataFrame:
    """Add the file and the row number in it, an identity that survives recomputation.

    ``doc_id`` may be null or repeated, and generated ids change when a lost
    task runs again on other splits; a row's place in a Parquet file does
    neither.  Input that doesn't come straight from Parquet is written first.
    Columns of the caller that have these names are set aside; see ``own_columns``.
    """
    if "_row_keyed" in df.__dict__:
        return df
    try:
        place = df.metadataColumn("_metadata")
        own = [F.col(f"`{c}`").alias(c + _OWN if c in (FILE, ROW) else c) for c in df.columns]
        keyed = df.select(*own, place["file_path"].alias(FILE), place["row_index"].alias(ROW))
        keyed.schema  # noqa: B018  raises where there is no such column
    except AnalysisException:
        return row_keyed(materialise(df, "rows"))
    keyed.__dict__["_row_keyed"] = True
    return keyed


def own_columns(keyed: DataFrame) -> list[Column]:
    """The caller's columns of a table from ``row_keyed``, under their own names."""
    names = {FILE + _OWN: FILE, ROW + _OWN: ROW}
    return [F.col(f"`{c}`").alias(names.get(c, c)) for c in keyed.columns if c not in (FILE, ROW)]


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` (from ``row_keyed``) whose place is in ``keys``, without the place."""
    return docs.join(keys.select(FILE, ROW), [FILE, ROW], "left_semi").select(*own_columns(docs))


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``materialise`` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        discard_folder(df.sparkSession, files[0].rsplit("/", 1)[0])


def discard_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of scratch data, where there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship(df: DataFrame) -> None:
    """Make this package importable in the Python workers of ``df``'s session."""
    ship_package(df.sparkSession)


def text_of(column: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
