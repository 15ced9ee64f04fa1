import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from treefold.functions import hashing, paths
from treefold.plans import queries

HELLO = "Hello, world!"


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_digests(spark):
    data = HELLO.encode()
    want = {
        "SHA512": hashlib.sha512(data).hexdigest(), "SHA256": "315f5bdb76d078c43b8ac0064e4a0164612b1fce77c869345bfc94c75894edd3", "SHA1": "943a702d06f34599aee1f8da8ef9f7296031d699",
        "XXH64": "f58336a78b6f9476", "XXH32": xxhash.xxh32(data).hexdigest(), "NULL": "00",
    }
    got = one(spark, *[hashing.digest(F.lit(HELLO), a) for a in want])
    assert got == tuple(f"{a}:{h}" for a, h in want.items())
    for a, h in want.items():
        x = hashing.hasher(a)()
        x.update(data)
        assert x.hexdigest() == h


def test_null_content(spark):
    assert one(spark, *[hashing.digest(F.lit(None).cast("string"), a) for a in hashing.ALGORITHMS]) == (None,) * 6


def test_algorithm_names():
    assert hashing.parse_algorithm("sha256") == "SHA256" and list(hashing.ALGORITHMS)[0] == "SHA512"
    with pytest.raises(ValueError, match="SHA512, SHA256, SHA1, XXH64, XXH32, NULL"):
        hashing.parse_algorithm("md5")


def test_parse(spark):
    h = "SHA1:943A702D06F34599AEE1F8DA8EF9F7296031D699"
    cases = [(h, h.replace("SHA1:", "").lower().join(["SHA1:", ""])), ("sha1:" + h[5:].lower() + ":more", "SHA1:" + h[5:].lower()), ("SHA1:abc", None), ("SHA1:zz" + h[7:], None), ("MD5:00", None), ("null:whatever", "NULL:00"), ("", None)]
    assert one(spark, *[hashing.parse(F.lit(x)) for x, _ in cases]) == tuple(y for _, y in cases)


def test_hex(spark):
    assert one(spark, hashing.decode_hex(F.lit("deadbeef")), hashing.decode_hex(F.lit("abc")), hashing.decode_hex(F.lit("zz"))) == (bytearray(b"\xde\xad\xbe\xef"), None, None)
    assert one(spark, hashing.hash_bytes(F.lit("NULL:00")), hashing.rank(F.lit("NULL:00")), hashing.rank(F.lit("SHA256:00"))) == (bytearray(b""), 5, 1)


def test_paths(spark):
    chain = ["test/abc/def.txt", "test/abc", "test", "", None]
    for p, q in zip(chain, chain[1:]):
        assert one(spark, paths.parent(F.lit(p))) == (q,)
    assert one(spark, paths.parent(F.lit("/a")), paths.parent(F.lit("/"))) == ("/", None)
    assert one(spark, *[paths.child(F.lit(a), F.lit(b)) for a, b in (("test/", "child.txt"), ("test/subdir", "abc.txt"), ("", "x"))]) == ("test/child.txt", "test/subdir/abc.txt", "x")
    raw = ["a//b/", "./a/./b/.", "/", "//", ".", "a/../b", "a/././b"]
    assert one(spark, *[paths.normalize(F.lit(x)) for x in raw]) == ("a/b", "a/b", "/", "/", "", "a/../b", "a/b")
    assert one(spark, *[paths.depth(F.lit(x)) for x in ("", "/", "a", "/a/b", "a/b/c")]) == (0, 0, 1, 2, 3)
    assert one(spark, *[paths.parent(F.lit(x)) for x in ("a/", "/a/", "//", "a\nb/c", "/a/b", "a//b")]) == ("a", "/a", "/", "a\nb", "/a", "a/")
    two = paths.wrap(F.lit("a.tar"), F.lit("b"))
    assert one(spark, paths.display(two), hashing.components_digest(two, "SHA256")) == ("a.tar| b", "SHA256:" + hashlib.sha256(b"a.tarb").hexdigest())
    w = paths.wrap(F.lit("a/b"))
    assert one(spark, paths.unwrap(w), paths.display(w)) == ("a/b", "a/b")
    assert paths.lexical_absolute("/a/b/../c") == "/a/c"


def test_every_algorithm_row_by_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    make = {"SHA512": hashlib.sha512, "SHA256": hashlib.sha256, "SHA1": hashlib.sha1, "XXH64": xxhash.xxh64, "XXH32": xxhash.xxh32}
    text = {f"docs/{r['doc_id']}": r["text"].encode() for r in docs.collect()}
    for name, f in make.items():
        got = queries.Q[f"leaf_{name.lower()}"](spark, "/root/testdata/sf0.001").collect()
        assert len(got) == len(text) and all(r["hash"] == f"{name}:{f(text[r['path']]).hexdigest()}" and r["size"] == len(text[r["path"]]) for r in got)
