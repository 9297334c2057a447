"""Landing path parsing: ``dt=YYYY-MM-DD[/hr=HH]`` read from the path text.

Partition inference would turn ``hr=09`` into the integer 9, so the folder
values are always parsed from the path as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: the landing folder pattern, hour optional.
DT_HR_PATTERN = r"dt=(\d{4}-\d{2}-\d{2})(?:/hr=(\d{2}))?"


def path_dt(path: Column) -> Column:
    """The ``dt=`` date text, or NULL for an undated path."""
    return F.nullif(F.regexp_extract(path, DT_HR_PATTERN, 1), F.lit(""))


def path_hr(path: Column) -> Column:
    """The ``hr=`` hour text; a dated folder without ``hr=`` is hour ``00``."""
    hr = F.regexp_extract(path, DT_HR_PATTERN, 2)
    return F.when(path_dt(path).isNull(), F.lit(None)).when(hr == "", F.lit("00")).otherwise(hr)


def file_hour(path: Column) -> Column:
    """Folder time as timestamp_ntz (UTC wall clock), NULL when undated."""
    return F.try_to_timestamp(F.concat_ws(" ", path_dt(path), path_hr(path)),
                              F.lit("yyyy-MM-dd HH")).cast("timestamp_ntz")


def qualify(root: str) -> str:
    """The folder with the scheme and authority of its file system, however it is
    written: ``/x``, ``file:/x`` and ``file:///x`` are one folder."""
    spark = SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def plain_uri(path: Column) -> Column:
    """File paths with one slash after ``file:``, as in ``qualify``; Spark writes one or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def relative_path(path: Column, root: str) -> Column:
    """Path made relative to the landing root (lineage column ``_filename``)."""
    q = qualify(root) + "/"
    path = plain_uri(path)
    return F.when(path.startswith(q), F.substr(path, F.lit(len(q) + 1))).otherwise(path)


def file_uri_path(meta_path: Column) -> Column:
    """``_metadata.file_path`` (URI-encoded: ``a%20b``, ``c%25d``) decoded to
    the plain path the file listing reports. ``+`` is literal in a URI path,
    so it is protected before the form decoder runs."""
    return F.url_decode(F.replace(meta_path, F.lit("+"), F.lit("%2B")))
