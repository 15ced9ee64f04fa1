import random

import pytest

from treefold.operators import analyze

SCHEMA = "ord long, path string, hash string, file_type string, size long, children array<string>, modified long"
KIND = {"F": "File", "D": "Directory", "S": "Symlink", "O": "Other"}
M2 = "r/a/f h1 F 3; r/a d1 D 1 [h1]; r/b/f h1 F 3; r/b d1 D 1 [h1]"
GOLDEN = {
    "M1": ("r/a/f h1 F 3; r/a d1 D 1 [h1]; r/b/f h1 F 3; r/b/g h2 F 4; r/b d2 D 2 [h1,h2]; r d0 D 2 [d1,d2]", ["File 3 h1 r/a/f r/b/f"]),
    "M2": (f"{M2}; r d0 D 2 [d1,d1]", ["Directory 1 d1 r/a r/b"]),
    "M3": (f"{M2}; r/c/f h1 F 3; r/c/g h2 F 4; r/c d2 D 2 [h1,h2]; r d0 D 3 [d1,d1,d2]", ["Directory 1 d1 r/a r/b"]),
    "M4": (f"r/c/f h1 F 3; r/c/g h2 F 4; r/c d2 D 2 [h1,h2]; {M2}; r d0 D 3 [d1,d1,d2]", ["Directory 1 d1 r/a r/b", "File 3 h1 r/c/f r/a/f r/b/f"]),
    "M5": ("r/f h1 F 3; r/g h1 F 4; r d0 D 2 [h1,h1]", []),
    "M6": ("r/f h1 F 3; r/l h1 S 3; r d0 D 2 [h1,h1]", []),
    "M7": ("r/p N O 0; r/q N O 0; r d0 D 2 [N,N]", []),
    "M8": ("r/f h1 F 3; r d0 D 1 [h1]; r/f h1 F 3", ["File 3 h1 r/f r/f"]),
    "M9": ("r/f N F 3; r/g N F 3; r N D 2 [N,N]", []),
    "M10": ("r/a/f h1 F 3; r/a d1 D 1 [h1]; r/b/f h1 F 3; r/b/p N O 0; r/b d1 D 2 [h1,N]; r d0 D 2 [d1,d1]", []),
    "M11": ("x/f h1 F 3; y/f h1 F 3", ["File 3 h1 x/f y/f"]),
    "M12": ("r/f h1 F 3; r/g h1 F 3; r d0 D 2 [h1,h1]", ["File 3 h1 r/f r/g"]),
}


def rows(text):
    out = []
    for i, x in enumerate(text.split(";")):
        path, h, t, size, *kids = x.split()
        out.append((i, path, h, KIND[t], int(size), kids[0][1:-1].split(",") if kids else [], 0))
    return out


def found(spark, data, mode="parity"):
    got = analyze.duplicate_sets(spark.createDataFrame(data, SCHEMA), mode).collect()
    return sorted(" ".join([r["ftype"], str(r["size"]), r["hash"], *r["conflicting"]]) for r in got)


@pytest.mark.parametrize("case", GOLDEN)
def test_golden(spark, case):
    text, want = GOLDEN[case]
    assert found(spark, rows(text)) == sorted(want)


def test_complete_mode_keeps_what_parity_loses(spark):
    assert "File 3 h1 r/a/f r/b/f r/c/f" in found(spark, rows(GOLDEN["M3"][0]), "complete")
    assert found(spark, rows(GOLDEN["M10"][0]), "complete") == ["File 3 h1 r/a/f r/b/f"]


def model(data):
    """The same question answered row by row."""
    up = lambda p: None if p == "" else p.rpartition("/")[0]
    last, count, sets = {}, {}, {}
    for r in data:
        last[r[1]] = r
        count[r[2]] = count.get(r[2], 0) + 1
        sets.setdefault((r[2], r[4], r[3], tuple(r[5])), []).append(r[1])
    out = []
    for (h, size, t, _), members in sets.items():
        if len(members) < 2 or t == "Other":
            continue
        first = last[members[0]]
        above = last.get(up(first[1]))
        hidden = above is not None and above[3] != "Other" and count[above[2]] >= 2
        if first[2] == h and first[3] != "Other" and not hidden:
            out.append(" ".join([t, str(size), h, *members]))
    return sorted(out)


def test_random(spark):
    rng = random.Random(5)
    for _ in range(12):
        data = []
        for i in range(60):
            path = "/".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
            t = rng.choice("FFFFDDSO")
            data.append((i, path, "N" if t == "O" else f"h{rng.randint(1, 9)}", KIND[t], rng.randint(1, 2), rng.choice([[], ["x"]]) if t == "D" else [], 0))
        assert found(spark, data) == model(data)


def test_positions_in_a_large_set(spark):
    data = [(i, f"d{i % 7}/{i:05d}", "h1" if i % 3 else f"u{i % 5}", "File", 4, [], 0) for i in range(4000)]
    got = analyze.ranked(spark.createDataFrame(data, SCHEMA).repartition(9)).collect()
    by = {}
    for r in got:
        by.setdefault(r["hash"], []).append((r["position"], r["ord"]))
    assert len(by) == 6 and len(got) == 4000
    assert all([p for p, _ in sorted(x)] == list(range(1, len(x) + 1)) and sorted(x) == sorted(x, key=lambda y: y[1]) for x in by.values())


def test_summary_and_empty(spark):
    df = spark.createDataFrame(rows(GOLDEN["M4"][0]), SCHEMA)
    assert analyze.summary(df).first().asDict() == {"sets": 2, "redundant_units": 7, "redundant_bytes": 6, "redundant_directories": 1, "redundant_gib": 0}
    assert analyze.summary(df.where("false")).first()["redundant_units"] == 0
