import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from treefold import __main__ as cli
from treefold.operators import analyze, incremental, merkle, scratch
from treefold.operators import clean as cleaning
from treefold.plans import commands
from treefold.sources import fstree, hashlog, tables
from treefold.streaming.tail import tail


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture
def tree(tmp_path):
    base = tmp_path / "base"
    for name, data in {"t/_a/.hid": b"1", "t/_a/ü x": b"22", "t/b/.hid": b"1", "t/b/ü x": b"22", "t/c/deep/er/f": b"333", "t/f": b"1", "t/z": b""}.items():
        p = base / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (base / "t/empty").mkdir()
    os.symlink("f", base / "t/link")
    os.symlink("nowhere", base / "t/dangling")
    os.symlink("c", base / "t/dirlink")
    return str(base)


def by_path(df):
    return {r["path"]: r for r in df.collect()}


def test_build(spark, tree):
    got = by_path(commands.build_tree(spark, "t", tree))
    assert set(got) == {"t", "t/_a", "t/b", "t/c", "t/c/deep", "t/c/deep/er", "t/_a/.hid", "t/_a/ü x", "t/b/.hid", "t/b/ü x", "t/c/deep/er/f", "t/f", "t/z", "t/link", "t/dangling", "t/dirlink"}
    want = sha(b"".join(sorted([bytes.fromhex(sha(b"1")), bytes.fromhex(sha(b"22"))])))
    assert got["t/b"]["hash"] == got["t/_a"]["hash"] == f"SHA256:{want}" and got["t/b"]["size"] == 2
    assert got["t/link"]["hash"] == f"SHA256:{sha(b'f')}" and got["t/link"]["size"] == 1 and got["t/link"]["file_type"] == "Symlink"
    assert got["t/z"]["hash"] == f"SHA256:{sha(b'')}" and got["t/z"]["size"] == 0
    assert got["t"]["size"] == 8 and got["t"]["modified"] > 0


def test_build_options(spark, tree):
    assert by_path(commands.build_tree(spark, "t", tree, include_empty=True))["t/empty"]["hash"] == f"SHA256:{sha(b'')}"
    follow = by_path(commands.build_tree(spark, "t", tree, follow_symlinks=True))
    assert follow["t/link"]["file_type"] == "File" and follow["t/dangling"]["file_type"] == "Other" and follow["t/dangling"]["hash"] == "NULL:00"
    assert follow["t/dirlink/deep/er/f"]["file_type"] == "File"
    os.symlink("..", os.path.join(tree, "t/c/up"))
    assert len(by_path(commands.build_tree(spark, "t", tree, follow_symlinks=True))) < 40
    root = by_path(commands.build_tree(spark, ".", tree))
    assert root[""]["file_type"] == "Directory" and root["t"]["hash"] in root[""]["children"]
    null = by_path(commands.build_tree(spark, "t", tree, hash_type="null"))
    assert null["t/b"]["hash"] == "NULL:00" and null["t/_a/ü x"]["size"] == 2
    x = by_path(commands.build_tree(spark, "t/b", tree, hash_type="xxh64"))
    assert x["t/b"]["hash"].startswith("XXH64:") and set(x) == {"t/b", "t/b/.hid", "t/b/ü x"}


def test_other_sorts_last_and_adds_no_bytes(spark):
    leaves = spark.createDataFrame([("d/a", "SHA256:" + sha(b"1")), ("d/p", "NULL:00")], "path string, hash string")
    got = merkle.fold(leaves).first()
    assert got["children"][-1] == "NULL:00" and got["size"] == 2 and got["hash"] == "SHA256:" + sha(bytes.fromhex(sha(b"1")))


def test_fold_of_nothing(spark):
    assert merkle.fold(spark.createDataFrame([], "path string, hash string")).count() == 0


def test_vanished_file_is_other(spark, tree):
    files = spark.createDataFrame([("t/gone", "File", 5, 9)], "path string, file_type string, modified long, size long")
    assert tuple(fstree.hash_files(files, tree).first()) == ("t/gone", "Other", 0, 0, "NULL:00")


def test_log_round_trip(spark, tree, tmp_path):
    now = commands.build_tree(spark, "t", tree)
    log = str(tmp_path / "log")
    hashlog.write(now, log, "SHA256", created=7)
    assert hashlog.read_header(spark, log) == {"version": "V1", "hash_type": "SHA256", "creation_date": 7}
    back = hashlog.read(spark, log)
    cols = ["path", "file_type", "modified", "size", "hash", "children"]
    assert sorted(back.select(cols).collect()) == sorted(now.select(cols).collect())
    assert [r["path"] for r in back.orderBy("ord").collect()] == [r["path"] for r in now.orderBy("ord").collect()]
    with pytest.raises(FileExistsError):
        hashlog.write(now, log, "SHA256")
    one = str(tmp_path / "one.jsonl")
    hashlog.write_file(now, one, "SHA256")
    assert hashlog.read(spark, one).count() == now.count()


HEAD = json.dumps(hashlog.header("SHA256", 1))
H256, H1 = ["SHA256:" + f"{k:064x}" for k in range(3)], "SHA1:" + "0" * 40


def line(h, p, t="File", **change):
    e = {"file_type": t, "modified": 0, "size": 1, "hash": h, "path": {"path": [{"path": p, "target": "File"}]}, "children": []} | change
    return json.dumps({k: v for k, v in e.items() if v != "-"})


@pytest.fixture
def log(tmp_path):
    def make(*lines):
        f = tmp_path / f"l{len(list(tmp_path.iterdir()))}"
        f.write_text("\n".join(lines))
        return str(f)

    return make


def test_log_faults(spark, log):
    good = hashlog.read(spark, log(HEAD, line(H256[0], "a"), "", line(H1, "b"), line("NULL:00", "c", "Other"), line(H256[1], "a"), '{"file_ty'))
    assert [(r["path"], r["hash"]) for r in good.orderBy("ord").collect()] == [("a", H256[0]), ("c", "NULL:00"), ("a", H256[1])]
    assert [r["hash"] for r in incremental.keep_last(good).orderBy("ord").collect()] == ["NULL:00", H256[1]]
    loose = hashlog.read(spark, log(HEAD, line(H256[0], "a"), line(H1, "b")), guard=False)
    assert {r["hash"] for r in loose.collect()} == {H256[0], H1}
    with pytest.raises(ValueError, match="malformed.*nonsense 1"):
        hashlog.read(spark, log(HEAD, "{nonsense 1", "{nonsense 2", line(H256[0], "a")))
    with pytest.raises(ValueError, match="no header"):
        hashlog.read(spark, log(""))


@pytest.mark.parametrize("change", [{k: "-"} for k in ("file_type", "modified", "size", "hash", "path", "children")] + [{"file_type": "Door"}, {"hash": "SHA256:zz"}, {"hash": "SHA256:00"}, {"hash": "MD5:00"}, {"children": ["SHA256:0"]}, {"modified": "x"}, {"path": {"path": [{"path": None, "target": "File"}]}}])
def test_a_line_that_lacks_something_is_malformed(spark, log, change):
    with pytest.raises(ValueError, match="malformed"):
        hashlog.read(spark, log(HEAD, line(H256[0], "a", **change), line(H256[1], "b")))


def test_hashes_are_read_in_canonical_form(spark, log):
    got = hashlog.read(spark, log(HEAD, line("sha256:" + "AB" * 32, "a"), line(H256[0], "d", "Directory", children=["Sha256:" + "CD" * 32, "null:"]))).orderBy("ord").collect()
    assert got[0]["hash"] == "SHA256:" + "ab" * 32 and got[1]["children"] == ["SHA256:" + "cd" * 32, "NULL:00"]


def test_overwriting_leaves_nothing_behind(spark, tree, tmp_path):
    path, f = str(tmp_path / "log"), os.path.join(tree, "t/f")
    for k, how in enumerate(({}, {"noclean": True}, {"overwrite": True})):
        with open(f, "w") as out:
            out.write("x" * (3 + 3 * k))
        commands.resume(spark, "t", path, tree, **how)
    assert by_path(incremental.keep_last(hashlog.read(spark, path)))["t/f"]["size"] == 9
    assert sorted(x for x in os.listdir(path) if not x.startswith(".")) == ["0-header", "1-records"] and not [x for x in os.listdir(tmp_path) if x.endswith((".new", ".old"))]


def test_a_replacement_that_was_broken_off(spark, tree, tmp_path):
    path = str(tmp_path / "log")
    now = commands.build_tree(spark, "t/b", tree)
    n = now.count()
    hashlog.write(now, path, "SHA256", created=1)
    hashlog.write(now, path + "2", "SHA256", created=2)
    one = lambda: (hashlog.settle(spark, path), hashlog.read_header(spark, path)["creation_date"], hashlog.read(spark, path).count())[1:]
    os.rename(path + "2", path + ".new")  # written, not yet in its place
    assert one() == (1, n)
    hashlog.write(now, path + "2", "SHA256", created=2)
    os.rename(path, path + ".old")
    os.rename(path + "2", path + ".new")  # between the two moves
    assert one() == (2, n)
    os.rename(path, path + ".old")
    os.makedirs(path + ".new/1-records")  # the new one never got its header
    assert one() == (2, n) and sorted(os.listdir(tmp_path / "log"))[-2:] == ["0-header", "1-records"]


def test_a_log_may_be_rewritten_from_itself(spark, tree, tmp_path):
    path = str(tmp_path / "log")
    hashlog.write(commands.build_tree(spark, "t", tree), path, "SHA256")
    n = hashlog.read(spark, path).count()
    hashlog.write(hashlog.read(spark, path).where("path <> 't/f'"), path, "SHA256", "overwrite")
    assert hashlog.read(spark, path).count() == n - 1


def test_one_listing_a_build(spark, tree, monkeypatch):
    seen, scan = [], fstree.scan
    real = fstree.hash_files

    def late(files, *how):
        os.remove(os.path.join(tree, "t/f"))  # between the listing and the hashing
        return real(files, *how)

    monkeypatch.setattr(fstree, "scan", lambda *a: seen.append(a) or scan(*a))
    monkeypatch.setattr(fstree, "hash_files", late)
    got = by_path(commands.build_tree(spark, "t", tree))
    assert len(seen) == 1 and (got["t/f"]["file_type"], got["t/f"]["hash"], got["t/f"]["modified"]) == ("Other", "NULL:00", 0) and got["t"]["size"] == 8


def test_what_cannot_be_looked_at_stays(spark, tree):
    seen = spark.createDataFrame([("t/f", "Other", None), ("t/gone", "Other", None), ("t/b", "Directory", 5), ("t/dangling", "Symlink", 6), ("t/link", "Symlink", 7)], "path string, file_type string, inode long")
    live = commands.live_types(seen, tree)
    assert {tuple(r) for r in live.collect()} == {("t/f", None), ("t/b", "Directory"), ("t/link", "Symlink")}
    recs = spark.createDataFrame([(1, "t/f", "File"), (2, "t/gone", "File"), (3, "t/b", "File")], "ord long, path string, file_type string")
    assert [r["path"] for r in cleaning.clean(recs, live).collect()] == ["t/f"]


def test_unreadable_directory_has_no_entries(tmp_path, monkeypatch):
    reader = fstree._Reader({"base": str(tmp_path)})
    (tmp_path / "d").mkdir()
    assert reader._names("nowhere") == [] and reader._names("") == ["d"]
    assert fstree._node(str(tmp_path), "gone", False)[0][:4] == ("gone", "Other", 0, 0)


def test_file_identity(spark, tree):
    os.link(os.path.join(tree, "t/f"), os.path.join(tree, "t/hard"))
    rows = {r["path"]: r["i"] for r in fstree.scan(spark, tree, "t").select("path", fstree.file_identity(F.col("inode"), F.col("device")).alias("i")).collect()}
    assert rows["t/f"] == rows["t/hard"] != rows["t/z"]


def test_scratch_is_swept(spark):
    s = scratch.Scratch(spark, "swept")
    s.store(spark.range(3), "x")
    assert os.path.isdir(s.top.removeprefix("file:"))
    others = [x for x in scratch._left if s.top not in x[1].toString()]
    scratch._left[:] = [x for x in scratch._left if s.top in x[1].toString()]
    scratch._sweep()
    scratch._left[:] = others
    assert not os.path.exists(s.top.removeprefix("file:"))


def test_clean_filters_before_it_keeps_the_last(spark):
    recs = spark.createDataFrame([(1, "a", "File"), (2, "a", "Symlink"), (3, "b", "File"), (4, "x/c", "File"), (5, "d", "File")], "ord long, path string, file_type string")
    live = spark.createDataFrame([("a", "File"), ("x/c", "File"), ("d", None)], "path string, file_type string")
    assert sorted(r["ord"] for r in cleaning.clean(recs, live).collect()) == [1, 4, 5]
    assert [r["ord"] for r in cleaning.clean(recs, live, root="x").collect()] == [4]


def test_resume(spark, tree, tmp_path):
    log = str(tmp_path / "log")
    commands.resume(spark, "t", log, tree)
    before = by_path(hashlog.read(spark, log))
    os.remove(os.path.join(tree, "t/f"))
    with open(os.path.join(tree, "t/b/ü x"), "w") as f:
        f.write("changed")
    after = by_path(commands.resume(spark, "t", log, tree))
    assert "t/f" not in after and after["t/b/ü x"]["hash"] != before["t/b/ü x"]["hash"]
    assert after["t/_a"]["hash"] == before["t/_a"]["hash"] and after["t"]["hash"] != before["t"]["hash"]
    assert "t/dangling" not in after  # a link counts as existing while its target does
    with pytest.raises(ValueError, match="can't be continued"):
        commands.resume(spark, "t", log, tree, hash_type="sha1")


def test_unchanged_files_are_not_read_again(spark, tree):
    first = commands.build_tree(spark, "t", tree).checkpoint()
    fake = first.withColumn("hash", F.when(F.col("path") == "t/f", F.lit("SHA256:" + "0" * 64)).otherwise(F.col("hash")))
    assert by_path(commands.build_tree(spark, "t", tree, previous=fake))["t/f"]["hash"] == "SHA256:" + "0" * 64


def test_command_line(spark, tree, tmp_path, capsys):
    log, out, clean = (str(tmp_path / x) for x in ("log", "out", "clean"))
    assert cli.main(["build", "t", "-w", tree, "-o", log]) == 0
    assert cli.main(["build", "t", "-w", tree, "-o", log]) == 0
    assert cli.main(["clean", "-i", log, "-o", clean, "-w", tree]) == 0
    assert cli.main(["analyze", "-i", clean, "-o", out]) == 0
    assert "0 GiB" in capsys.readouterr().out
    sets = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert {x["ftype"] for x in sets} >= {"Directory"} and {y["path"][0]["path"] for x in sets if x["ftype"] == "Directory" for y in x["conflicting"]} >= {"t/_a", "t/b"}
    assert cli.main(["--threads", "0", "analyze"]) == 2


def test_stream(spark, tree, tmp_path):
    log = str(tmp_path / "log")
    now = commands.build_tree(spark, "t", tree).checkpoint()
    hashlog.write(now, log, "SHA256")
    q = tail(spark, log).writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tailed").count() == now.count()


def test_stream_stops_at_a_malformed_line(spark, log, tmp_path):
    q = tail(spark, log(HEAD, line(H256[0], "a"), line("SHA256:zz", "b"))).writeStream.format("memory").queryName("bad_tail").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="malformed line"):
        q.awaitTermination(120)


def test_virtual_tree(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, text string")
    recs = tables.from_table(df, F.concat(F.lit("d/"), (F.col("id") % 2).cast("string"), F.lit("/"), F.col("id").cast("string")), F.col("text"))
    assert recs.where("file_type = 'Directory'").count() == 3
    assert [r["conflicting"] for r in analyze.duplicate_sets(recs).collect()] == [["d/0/2", "d/1/1"]]
