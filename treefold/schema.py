"""The fixed schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

FILE, DIRECTORY, SYMLINK, OTHER = "File", "Directory", "Symlink", "Other"
NODE_TYPES = (FILE, DIRECTORY, SYMLINK, OTHER)
VERSION = "V1"

PATH_STRUCT = T.StructType([T.StructField("path", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("target", T.StringType())])))])

HEADER = T.StructType([T.StructField("version", T.StringType()), T.StructField("hash_type", T.StringType()), T.StructField("creation_date", T.LongType())])

#: One line of the record log.
ENTRY = T.StructType(
    [
        T.StructField("file_type", T.StringType()),
        T.StructField("modified", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("path", PATH_STRUCT),
        T.StructField("children", T.ArrayType(T.StringType())),
    ]
)

#: What the file-system scan returns, before hashing.
SCAN = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("modified", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("target", T.StringType()),
        T.StructField("inode", T.LongType()),
        T.StructField("device", T.LongType()),
        T.StructField("utf8", T.BooleanType()),
    ]
)

#: Columns of a record table; `ord` may have any orderable type (a number, a path, or a struct of file and offset).
RECORD = ("ord", "path", "file_type", "modified", "size", "hash", "children")
