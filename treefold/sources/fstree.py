"""Scan of a directory tree as a Python data source, and chunked hashing of file contents.

`binaryFile` isn't usable: it skips hidden names, has no directories, follows links and loads whole files. The scan's
partitions are subtrees; executors need the same mount as the driver. Contents are read in chunks, on executors only.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treefold.functions import hashing
from treefold.schema import DIRECTORY, FILE, OTHER, SCAN, SYMLINK

CHUNK = 1 << 20


class _Subtree(InputPartition):
    def __init__(self, path: str, deep: bool, above: tuple = ()):
        self.path, self.deep, self.above = path, deep, above


def _node(base: str, rel: str, follow: bool) -> tuple[tuple, bool, tuple | None]:
    """A scan row, whether it is a directory, and its identity."""
    full = os.path.join(base, rel) if rel else base
    utf8 = True
    try:
        shown = rel
        rel.encode()
    except UnicodeEncodeError:
        utf8, shown = False, rel.encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace")
    try:
        st = os.stat(full) if follow else os.lstat(full)
    except OSError:
        return (shown, OTHER, 0, 0, None, None, None, utf8), False, None
    kind = SYMLINK if stat.S_ISLNK(st.st_mode) else DIRECTORY if stat.S_ISDIR(st.st_mode) else FILE if stat.S_ISREG(st.st_mode) else OTHER
    target = None
    if kind == SYMLINK:
        try:
            target = os.readlink(full)
        except OSError:
            kind = OTHER
    size = st.st_size if kind != DIRECTORY else 0
    modified = max(0, st.st_mtime_ns // 10**9) if kind != OTHER else 0
    return (shown, kind, modified, size, target, st.st_ino, st.st_dev, utf8), kind == DIRECTORY, (st.st_dev, st.st_ino)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.root = options["base"], options.get("root", "")
        self.follow = str(options.get("followsymlinks", "false")).lower() == "true"
        self.wanted = int(options.get("subtrees", "64"))

    def _names(self, rel: str) -> list[str]:
        try:
            return sorted(os.listdir(os.path.join(self.base, rel) if rel else self.base))
        except OSError:
            return []  # an unreadable directory has no entries

    def partitions(self) -> list[InputPartition]:
        """Breadth first down to enough subtrees; the directories passed on the way are single nodes."""
        if not os.path.lexists(os.path.join(self.base, self.root)):
            raise FileNotFoundError(os.path.join(self.base, self.root))
        single, edge = [], [(self.root, ())]
        while edge and len(edge) < self.wanted:
            below, went = [], False
            for rel, above in edge:
                row, is_dir, own = _node(self.base, rel, self.follow)
                if is_dir and own not in above:
                    went = True
                    single.append(_Subtree(rel, False, above))
                    below += [(os.path.join(rel, n) if rel else n, (*above, own)) for n in self._names(rel)]
                else:
                    single.append(_Subtree(rel, False, above))
            edge = below
            if not went:
                break
        return single + [_Subtree(rel, True, above) for rel, above in edge]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        todo = [(partition.path, partition.above)]
        while todo:
            rel, above = todo.pop()
            row, is_dir, own = _node(self.base, rel, self.follow)
            if own is not None and is_dir and own in above:
                continue  # a link back to a directory above
            yield row
            if is_dir and partition.deep:
                todo += [(os.path.join(rel, n) if rel else n, (*above, own)) for n in self._names(rel)]


class FsTree(DataSource):
    """Options: base (absolute), root (below base, may be empty), followSymlinks, subtrees."""

    @classmethod
    def name(cls) -> str:
        return "fstree"

    def schema(self):
        return SCAN

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, base: str, root: str = "", follow_symlinks: bool = False, subtrees: int = 64) -> DataFrame:
    """path, file_type, modified, size, target, inode, device, utf8 of the root and all below."""
    spark.dataSource.register(FsTree)
    read = spark.read.format("fstree").options(base=os.path.abspath(base), root=root, followSymlinks=str(follow_symlinks).lower(), subtrees=str(subtrees))
    return read.load()


def hash_files(files: DataFrame, base: str, algorithm: str = "SHA256") -> DataFrame:
    """File rows (path, file_type, modified, size) with `hash` and the byte count that was read as `size`; an unreadable
    file becomes Other. Rows pass through once; no join, and no second look at the tree."""
    algorithm = hashing.parse_algorithm(algorithm)
    base = os.path.abspath(base)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = hashing.hasher(algorithm)

        def one(path: str, size: int) -> tuple:
            if algorithm == "NULL":
                return hashing.NULL_HASH, size
            h, n = make(), 0
            try:
                with open(os.path.join(base, path) if path else base, "rb") as f:
                    while chunk := f.read(CHUNK):
                        h.update(chunk)
                        n += len(chunk)
            except OSError:
                return None, 0
            return f"{algorithm}:{h.hexdigest()}", n

        for pdf in batches:
            pdf["hash"], pdf["size"] = zip(*[one(p, n) for p, n in zip(pdf["path"], pdf["size"])]) if len(pdf) else ([], [])
            bad = pdf["hash"].isna()
            pdf.loc[bad, ["file_type", "modified", "hash"]] = OTHER, 0, hashing.NULL_HASH
            yield pdf

    rows = files.select("path", "file_type", "modified", "size")
    return rows.mapInPandas(run, "path string, file_type string, modified long, size long, hash string")


def file_identity(inode: Column, device: Column) -> Column:
    """What hard links of one file share."""
    return F.concat_ws(":", device.cast("string"), inode.cast("string"))
