import hashlib
import zlib

import duckdb
import pytest

from pitpanel.llm import merkle as M

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def frame(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, low=False):
    d, t, g, s, n = row
    if low and t is not None:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return H(*map(frame, (d, s, g, n, t)))


def grow(nodes):
    """The levels over ``nodes``, the lowest first."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def climb(levels, at, h):
    proof = ""
    for level in levels[:-1]:
        run, i = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
        proof, h = proof + "".join(run[:i] + run[i + 1 :]), H(*run[:i], h, *run[i + 1 :])
        at //= 16
    return proof, h


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    trees = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in trees}
    grown = {s: grow([leaf_of(r) for r in held[s]]) for s in trees}
    top = grow([grown[s][-1][0] for s in trees])
    out, root = [], top[-1][0] if trees else None
    for j, s in enumerate(trees):
        for i, r in enumerate(held[s]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            proof, h = climb(grown[s], i, leaf_of(r, bad))
            more, h = climb(top, j, h)
            out.append((r[0], leaf_of(r), grown[s][-1][0], root, H(proof + more), h, h == root))
    return sorted(out, key=str)


def op13(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLS).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in M.op13(spark, str(tmp_path)).collect()), key=str)


def test_trees_of_every_depth(spark, tmp_path):
    rows = [(i, f"Text {i} Ä\n", "en", "hot", i) for i in range(300)]  # three levels
    rows += [(1000 + i, f"x{i}", None, f"s{i % 19}", None) for i in range(38)]  # two levels of trees
    rows += [(2000 + i, "Sixteen", "de", "full", 1) for i in range(16)] + [(3000 + i, "Seventeen", "de", "more", 1) for i in range(17)]
    rows += [(5, "same id", "en", "lone", 3), (7, None, None, None, None), (8, "", "", "", 0), (None, "Null Id", "en", None, 4), (9, "É" * 70_000, "fr", "long", 70_000)]
    assert op13(spark, tmp_path, rows) == brute(rows)


def test_repeated_rows_and_shared_ids(spark, tmp_path):
    rows = [(10, "Copy", "en", "a", 4)] * 70 + [(10, f"Other {i}", "en", "a", 4) for i in range(20)] + [(i, "Copy", "en", "b", 4) for i in range(33)] + [(None, "Null", None, None, None)] * 40
    assert op13(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, tmp_path, n):
    rows = [(10 + i, "A Text", "en", "s", 6) for i in range(n)]
    assert op13(spark, tmp_path, rows) == brute(rows)


def test_wanted_leaves_and_clashing_names(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 3}", i) for i in range(1, 400)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], COLS + ", at int, digest string, tree string")
    leaves = M.document_leaves(docs).select("tree", "leaf", "doc_id", docs["at"].alias("place"))
    m = M.build(leaves, "doc_id", ["doc_id", "place"])
    every = {(r["tree"], r["at"]): r for r in M.prove(m).collect()}
    assert len(every) == 399
    asked = [("ss0", 0), ("ss1", 77), ("ss2", 132), ("ss1", 78), ("ss1", 77)]
    got = M.prove(m, spark.createDataFrame(asked, "tree string, at long"))
    assert {(r["tree"], r["at"]): r for r in got.collect()} == {k: every[k] for k in asked}
    back = M.prove(m).filter(M.folded(M.F.col("leaf"), M.F.col("path")) == M.F.col("root")).count()
    assert back == 399
    # content-addressed: every digest once, each the digest of its children
    held = m.records.collect()
    assert len({r["digest"] for r in held}) == len(held) and all(H(*r["children"]) == r["digest"] for r in held)


def test_sql_agrees(spark, tmp_path):
    rows = [(i, f"Text {i} Ä\n", "en" if i % 7 else None, f"src{i % 20}" if i % 3 else "src0", i) for i in range(500)]
    got = op13(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(M.OP13_SQL).fetchall(), key=str) == got == brute(rows)
