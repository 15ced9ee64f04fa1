"""Path columns. Inside the engine a path is one normalised string; in the record log it is a list of components."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Collapses repeated separators, drops interior and trailing ``.`` and the trailing separator; keeps ``..``."""
    one = F.regexp_replace(path, "/+", "/")
    for _ in range(2):  # overlapping /./. needs a second pass
        one = F.regexp_replace(one, r"/\.(?=/|$)", "")
    one = F.regexp_replace(one, r"^\./", "")
    one = F.when(one == ".", F.lit("")).otherwise(one)
    out = F.regexp_replace(one, r"(?<=[^/])/$", "")
    return F.when(path.startswith("/") & (out == ""), F.lit("/")).otherwise(out)


def parent(path: Column) -> Column:
    """The parent's path: ``""`` for one component, null for ``""`` and ``/``."""
    bare = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1  # up to the last separator
    return F.when((path == "") | (path == "/"), F.lit(None).cast("string")).when(F.instr(path, "/") == 0, F.lit("")).when(bare == 0, F.lit("/")).otherwise(F.left(path, bare))


def child(path: Column, name: Column) -> Column:
    return F.when(path == "", name).when(path.endswith("/"), F.concat(path, name)).otherwise(F.concat_ws("/", path, name))


def depth(path: Column) -> Column:
    """Number of components."""
    bare = F.ltrim(path, F.lit("/"))
    return F.when(bare == "", F.lit(0)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit(""))) + 1).cast("int")


def is_under(path: Column, root: str) -> Column:
    """Whether a path is the root or below it."""
    root = root.rstrip("/")
    return F.lit(True) if not root else (path == root) | path.startswith(f"{root}/")


def wrap(*components: Column) -> Column:
    """The logical path of the record log: a list of components, of which only real files exist."""
    return F.struct(F.array(*[F.struct(c.alias("path"), F.lit("File").alias("target")) for c in components]).alias("path"))


def unwrap(path: Column) -> Column:
    """The only component's path, null for null; more components (archives) aren't supported."""
    return F.when(path["path"].isNull(), F.lit(None).cast("string")).when(F.size(path["path"]) == 1, path["path"][0]["path"]).otherwise(F.raise_error(F.lit("a path must have exactly one component")))


def display(path: Column) -> Column:
    return F.concat_ws("| ", F.transform(path["path"], lambda x: x["path"]))


def lexical_absolute(path: str, base: str | None = None) -> str:
    """Absolute path without looking at the disk."""
    return os.path.normpath(os.path.join(base or os.getcwd(), path))


def resolve(path: str, base: str | None = None, existing: bool = False) -> str:
    """A path given by the user: canonical if it must exist, else lexical. The process never changes its directory."""
    return os.path.realpath(os.path.join(base or os.getcwd(), path), strict=True) if existing else lexical_absolute(path, base)
