"""Tagged content hashes: ``TYPE:hex``.

SHA-1, SHA-256 and SHA-512 are JVM built-ins. XXH32 and XXH64 with seed 0 have no built-in (Spark's own uses seed 42),
so they run as Arrow-batched UDFs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The algorithms in their order of precedence, and the length of each digest in bytes.
ALGORITHMS = {"SHA512": 64, "SHA256": 32, "SHA1": 20, "XXH64": 8, "XXH32": 4, "NULL": 0}
NULL_HASH = "NULL:00"


def parse_algorithm(name: str) -> str:
    """The canonical name of an algorithm, given in any case."""
    if (upper := name.upper()) not in ALGORITHMS:
        raise ValueError(f"unknown hash algorithm {name!r}; supported: {', '.join(ALGORITHMS)}")
    return upper


class _Null:
    def update(self, data: bytes) -> None:
        pass

    def hexdigest(self) -> str:
        return "00"


def hasher(algorithm: str) -> Callable:
    """A factory of incremental hashers with update() and hexdigest()."""
    algorithm = parse_algorithm(algorithm)
    if algorithm == "NULL":
        return _Null
    if algorithm.startswith("XXH"):
        import xxhash

        return {"XXH64": xxhash.xxh64, "XXH32": xxhash.xxh32}[algorithm]
    return getattr(hashlib, algorithm.lower())


def _xxh(algorithm: str) -> Callable:
    @F.pandas_udf(T.StringType())
    def digest(data: pd.Series) -> pd.Series:
        make = hasher(algorithm)

        def one(x):
            if x is None:
                return None
            h = make()
            h.update(x)
            return h.hexdigest()

        return data.map(one, na_action=None)

    return digest


def digest_hex(data: Column, algorithm: str) -> Column:
    """Lower-case hex digest of a binary or string (UTF-8) column; null stays null."""
    algorithm = parse_algorithm(algorithm)
    data = data.cast("binary")
    if algorithm == "SHA1":
        return F.sha1(data)
    if algorithm in ("SHA256", "SHA512"):
        return F.sha2(data, int(algorithm[3:]))
    if algorithm == "NULL":
        return F.when(data.isNotNull(), F.lit("00"))
    return _xxh(algorithm)(data)


def digest(data: Column, algorithm: str) -> Column:
    """Tagged digest, such as ``SHA256:315f…``."""
    return F.concat(F.lit(f"{parse_algorithm(algorithm)}:"), digest_hex(data, algorithm))


def hash_type(h: Column) -> Column:
    """The algorithm of a tagged hash."""
    return F.split(h, ":")[0]


def decode_hex(text: Column) -> Column:
    """Bytes of a hex string; null for an odd length or a character that isn't hex."""
    return F.when(F.length(text) % 2 == 0, F.unhex(text))


def hash_bytes(h: Column) -> Column:
    """The raw digest of a tagged hash; empty for NULL."""
    return F.when(hash_type(h) == "NULL", F.lit(b"")).otherwise(decode_hex(F.split(h, ":")[1]))


def rank(h: Column) -> Column:
    """Position of a hash's algorithm in the fixed order; hashes sort by (rank, text)."""
    out = F.lit(len(ALGORITHMS))
    for i, name in reversed(list(enumerate(ALGORITHMS))):
        out = F.when(h.startswith(f"{name}:"), F.lit(i)).otherwise(out)
    return out


def parse(h: Column) -> Column:
    """The hash in canonical form (lower-case, what follows a second ``:`` ignored), or null when its type is unknown,
    its data isn't hex, or its length is wrong. NULL ignores its data."""
    name, data = F.upper(F.split(h, ":")[0]), F.split(h, ":")[1]
    out = F.when((name == "NULL") & data.isNotNull(), F.lit(NULL_HASH))
    for kind, n in ALGORITHMS.items():
        if n:
            out = out.when((name == kind) & (F.octet_length(decode_hex(data)) == n), F.concat(name, F.lit(":"), F.lower(data)))
    return out


def link_digest(target: Column, algorithm: str) -> Column:
    """The content hash of a symbolic link: the digest of its target's bytes."""
    return digest(target, algorithm)


def components_digest(path: Column, algorithm: str) -> Column:
    """Digest over the components of a logical path struct."""
    return digest(F.concat_ws("", F.transform(path["path"], lambda x: x["path"])), algorithm)


def type_guard(h: Column, file_type: Column, algorithm: str) -> Column:
    """Keeps records of the log's own algorithm, and Other records, whose hash is NULL."""
    return (hash_type(h) == parse_algorithm(algorithm)) | ((file_type == "Other") & (hash_type(h) == "NULL"))
