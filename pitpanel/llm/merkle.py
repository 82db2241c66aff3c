"""Merkle dataset manifest (operator 13): a content-addressed DAG, and proofs by descent from its root.

1. Every row becomes a leaf: the digest of its fields, each framed by its length.
2. Leaves are ranked within their tree (one for each source). A tree of any size is
   ranked in two levels: rows are dealt in ranges of their order, numbered within
   a range, and ranges receive the counts of those before them.
3. ``FAN`` consecutive nodes are one node of the next level, until one is left. Each
   such node is a record *digest -> children*; records of all levels lie in one
   store without order, where equal digests are one record. The trees' roots, in
   the order of their names, are the leaves of one more tree.
4. Requests for leaves go down from the root: the record of the digest at hand is
   looked up, the digit of the rank (base ``FAN``) chooses the child, its siblings
   are collected as a segment of the path. Requests that share a path go as one
   until it forks, so a level has as many rows as it has nodes on the way to a
   requested leaf, and no record meets all requests. A path read from its end is
   the proof.

A group holds ``FAN`` rows at most. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = "top"


def framed(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value: no two rows of fields read the same."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the framed values, one after the other."""
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _run(at: str = "at") -> Column:
    return F.floor(F.col(at) / FAN).cast("long")


def _ranked(rows: DataFrame, order: Sequence[str], space: Workspace, name: str) -> DataFrame:
    """``rows`` with ``at``, their place from 0 within ``tree`` by ``order``.

    Ranges of the order, not trees, are what tasks hold, so a tree with a third of
    all rows is many ranges. ``__salt`` splits rows that are equal in all of it.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, "tree", *[F.asc_nulls_first(c) for c in order], "__salt")
    dealt = space.save(dealt.withColumn("__range", F.spark_partition_id()), f"{name}-ranges")
    counts = dealt.groupBy("tree", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("tree").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("tree").alias("__t"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("tree", "__range").orderBy(*[F.asc_nulls_first(c) for c in order], "__salt")
    out = dealt.withColumn("__k", F.row_number().over(inside)).join(offsets, (F.col("tree") == F.col("__t")) & (F.col("__range") == F.col("__r")))
    return out.withColumn("at", (F.col("__o") + F.col("__k") - 1).cast("long")).drop("__t", "__r", "__o", "__k", "__range", "__salt")


def _depth(n: int) -> int:
    """Levels above ``n`` leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def _sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree").agg((F.max("at") + 1).alias("n"))


def _built(runs: DataFrame, sizes: DataFrame, space: Workspace, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The records of every level and (tree, n, depth, digest) of the trees' roots.

    ``runs``: (tree, at, children), the runs of the leaves.
    """
    most = sizes.agg(F.max("n")).first()[0] or 0
    deep = F.lit(0)
    for k in range(_depth(most)):
        deep = deep + F.when(F.col("n") > FAN**k, 1).otherwise(0)
    sizes = sizes.withColumn("depth", deep.cast("int"))
    records, roots, now = [], [], runs.join(sizes, "tree")
    lone = now.filter("depth = 0").select("tree", "n", "depth", F.col("children")[0].alias("digest"))
    now = now.filter("depth > 0")
    roots.append(lone)
    for k in range(1, _depth(most) + 1):
        level = space.save(now.select("tree", "at", "n", "depth", "children", F.sha2(_joined("children"), 256).alias("digest")), f"{name}-level-{k}")
        records.append(level.select("digest", "children"))
        roots.append(level.filter(F.col("depth") == k).select("tree", "n", "depth", "digest"))
        above = level.filter(F.col("depth") > k).groupBy("tree", "n", "depth", _run().alias("up"))
        now = above.agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("c")).select("tree", F.col("up").alias("at"), "n", "depth", F.col("c.digest").alias("children"))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return records, out


@dataclass
class Manifest:
    """``runs``: the leaves (tree, at, members: array of (at, leaf, carried columns)) by runs of ``FAN``;
    ``records``: digest -> children; ``trees``: tree, digest (its root), n, depth, at (its place); ``root``: None without rows."""

    runs: DataFrame
    records: DataFrame
    trees: DataFrame
    root: str | None
    depth: int
    space: Workspace


def build(leaves: DataFrame, order: str, carry: Sequence[str] = (), name: str = "merkle") -> Manifest:
    """The manifest of ``leaves``: (tree: string, leaf: hex digest, ``order``, ``carry``).

    Within a tree leaves ascend by ``order`` (null first), equal ones by their
    digest; trees ascend by name, bytewise. Rows that are equal in all of it are
    leaves of their own, side by side. No rows: a manifest without root.
    """
    space = Workspace(leaves.sparkSession, name)
    held = leaves.select("tree", "leaf", F.col(order).alias("__order"), *carry, F.xxhash64(F.monotonically_increasing_id()).alias("__salt"))
    held = space.save(held, "leaves")
    ranked = _ranked(held, ["__order", "leaf"], space, "leaf")
    runs = ranked.groupBy("tree", _run().alias("run")).agg(F.array_sort(F.collect_list(F.struct("at", "leaf", *carry))).alias("members"))
    runs = space.save(runs.select("tree", F.col("run").alias("at"), "members"), "runs")
    sizes = runs.groupBy("tree").agg(F.max(F.col("at") * FAN + F.size("members")).alias("n"))
    records, trees = _built(runs.select("tree", "at", F.col("members.leaf").alias("children")), sizes, space, "tree")
    named = trees.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("name"), F.col("n").alias("leaves"), F.col("depth").alias("levels"), "digest", F.lit(0).alias("__salt"))
    placed = space.save(_ranked(space.save(named, "roots"), ["name"], space, "root"), "trees")
    tops = placed.groupBy("tree", _run().alias("run")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("c"))
    more, top = _built(tops.select("tree", F.col("run").alias("at"), F.col("c.digest").alias("children")), _sizes(placed), space, "top")
    found = top.select("digest", "depth").first()
    every = leaves.sparkSession.createDataFrame([], "digest string, children array<string>")
    for r in [*records, *more]:
        every = every.unionByName(r)
    stored = space.save(every.groupBy("digest").agg(F.first("children").alias("children")), "records")
    trees = placed.select(F.col("name").alias("tree"), "digest", F.col("leaves").alias("n"), F.col("levels").alias("depth"), "at")
    return Manifest(runs, stored, trees, found["digest"] if found else None, found["depth"] if found else 0, space)


def _step(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """One level down: a row for each child, its siblings left and right of it added to the path."""
    held = frontier.join(records, "digest").select(*[c for c in frontier.columns if c not in ("digest", "at")], F.col("at").alias("__up"), "children")
    each = held.select("*", F.posexplode("children").alias("__d", "digest"))
    return each.withColumns({"at": F.col("__up") * FAN + F.col("__d"), "path": F.concat("path", F.array(_beside(F.col("__d"), F.col("children"))))}).drop("__up", "__d", "children")


def _beside(d: Column, children: Column) -> Column:
    return F.struct(_joined(F.slice(children, F.lit(1), d)).alias("l"), _joined(F.slice(children, d + 2, F.lit(FAN))).alias("r"))


def paths(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """(tree, at: a run, digest, depth, path) of every run of leaves that holds a wanted leaf, by descent from the root.

    ``wanted``: (tree, at) of leaves, or all of them. A run of a tree of one leaf is
    that leaf. ``path`` has a (l, r) pair of joined siblings for each level, the root's first.
    """
    spark, space = manifest.records.sparkSession, manifest.space
    start = spark.createDataFrame([(manifest.root, 0)] if manifest.root else [], "digest string, at long")
    now = start.withColumn("path", F.expr("cast(array() as array<struct<l: string, r: string>>)"))
    keep = None
    if wanted is not None:
        keep = space.save(wanted.join(manifest.trees.select("tree", F.col("at").alias("place"), "depth"), "tree").select("tree", "place", "at", "depth"), f"wanted-{id(wanted)}")
    for k in range(manifest.depth - 1, -1, -1):
        now = _step(now, manifest.records)
        if keep is not None:
            now = now.join(keep.select(F.floor(F.col("place") / FAN**k).alias("at")).distinct(), "at", "left_semi")
    now = now.join(manifest.trees.select("tree", "at", "depth"), "at").select("tree", F.lit(0).cast("long").alias("at"), "digest", "depth", F.col("depth").alias("left"), "path")
    deepest, out = manifest.trees.agg(F.max("depth")).first()[0] or 0, None
    for k in range(deepest - 1):
        now = space.save(now, f"descent-{id(now)}-{k}")
        ready = now.filter("left <= 1")
        out = ready if out is None else out.unionByName(ready)
        now = _step(now.filter("left > 1"), manifest.records).withColumn("left", F.col("left") - 1).select(*ready.columns)
        if keep is not None:
            nodes = keep.select("tree", F.floor(F.col("at") / F.pow(F.lit(FAN), F.col("depth") - (k + 1))).cast("long").alias("at")).distinct()
            now = now.join(nodes, ["tree", "at"], "left_semi").select(*ready.columns)
    return (now if out is None else out.unionByName(now)).drop("left")


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """A row for each (wanted) leaf: tree, at, the members' columns, ``subroot``, ``root``, and ``path``, (l, r) pairs from the leaf's level to the root's.

    The leaf itself is what the last record names; siblings are collected on the way.
    """
    above = paths(manifest, wanted).withColumn("path", F.reverse("path"))
    held = above.join(manifest.records, (above["digest"] == manifest.records["digest"]) & (F.col("depth") > 0), "left").select(above["*"], "children")
    held = held.withColumn("children", F.coalesce("children", F.array("digest"))).drop("digest")
    held = held.join(manifest.runs, ["tree", "at"]).withColumnRenamed("at", "__run")
    each = held.select("*", F.posexplode("members").alias("__d", "m")).withColumn("leaf", F.try_element_at("children", F.col("__d") + 1))
    own = F.when(F.col("depth") > 0, F.array(_beside(F.col("__d"), F.col("children")))).otherwise(F.expr("cast(array() as array<struct<l: string, r: string>>)"))
    carried = [f.name for f in manifest.runs.schema["members"].dataType.elementType.fields if f.name not in ("at", "leaf")]
    out = each.select("tree", F.col("m.at").alias("at"), "leaf", *[F.col(f"m.{c}").alias(c) for c in carried], F.concat(own, "path").alias("path"))
    if wanted is not None:
        out = out.join(wanted.select("tree", "at").distinct(), ["tree", "at"], "left_semi")
    roots = manifest.trees.select("tree", F.col("digest").alias("subroot"))
    return out.join(roots, "tree").withColumn("root", F.lit(manifest.root).cast("string"))


def siblings(path: Column) -> Column:
    """The digests of a proof, one after the other, from the leaf's level on."""
    return _joined(F.transform(path, lambda x: F.concat(x["l"], x["r"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]), 256))


def document_leaves(docs: DataFrame, tree: str = "source", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(tree, leaf, carried fields) of documents; a null tree has the empty name, others a letter before theirs, so null comes first."""
    return docs.withColumns({"tree": F.when(F.col(tree).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(tree).cast("string"))), "leaf": digest(*[docs[f] for f in fields])})


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, a proof for every row, and whether the row verifies after one in five was tampered with.

    Null fields are ``-``. Rows that share an id stand side by side by their
    digests; a null id comes first and is never tampered with. A text without A-Z
    is tampered with in vain and verifies. A lone row is its own root, with the
    proof of the empty string.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = digest(*[lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in FIELDS])
    rows = document_leaves(docs).withColumn("tampered", F.when(changed, other)).select("tree", "doc_id", "leaf", "tampered")
    proofs = prove(build(rows, "doc_id", ["doc_id", "tampered"]))
    back = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """The same in DuckDB: levels one after the other, as many as 16**6 leaves of a source and as many sources need."""
    frame = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    whole = " || ".join(frame(c) for c in FIELDS)
    lowered = " || ".join(frame("low" if c == "text" else c) for c in FIELDS)
    # crc32 of the id, byte by byte with the table of the reflected polynomial
    out = f"""WITH RECURSIVE t AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(i)),
 tab AS (SELECT list(v ORDER BY i) AS tab FROM t),
 d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, CASE WHEN doc_id IS NULL THEN NULL ELSE
   xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
     lambda a, b: xor(a // 256, tab[CAST(xor(a, b) % 256 AS INT) + 1])), 4294967295) END AS crc FROM documents, tab),
 l AS (SELECT doc_id, source, sha256({whole}) AS leaf, CASE WHEN crc % 5 = 0 THEN sha256({lowered}) END AS bad FROM d),
 n0 AS (SELECT *, coalesce('s' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS a0, count(*) OVER (PARTITION BY source) AS c0 FROM l),
 v0 AS (SELECT tree, a0 AS a, leaf AS h, c0 AS c FROM n0)"""
    for k in range(1, 7):  # a level: (tree, place, digest, nodes of the tree)
        out += f""",
 v{k} AS (SELECT tree, a // 16 AS a, CASE WHEN c > 1 THEN sha256(string_agg(h, '' ORDER BY a)) ELSE min(h) END AS h, (c + 15) // 16 AS c FROM v{k - 1} p GROUP BY tree, a // 16, c)"""
    out += """,
 w0 AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS a, h, count(*) OVER () AS c FROM v6)"""
    for k in range(1, 7):
        out += f""",
 w{k} AS (SELECT a // 16 AS a, CASE WHEN c > 1 THEN sha256(string_agg(h, '' ORDER BY a)) ELSE min(h) END AS h, (c + 15) // 16 AS c FROM w{k - 1} GROUP BY a // 16, c)"""
    out += """,
 f0 AS (SELECT n0.doc_id, n0.leaf, n0.tree, n0.a0 AS a, coalesce(bad, leaf) AS acc, '' AS proof, w0.a AS b, w0.h AS subroot FROM n0 JOIN w0 USING (tree))"""

    def level(k: int, table: str, own: str, place: str, keep: str) -> str:
        at = "tree, " if table[0] == "v" else ""
        on = "s.tree = f.tree AND " if table[0] == "v" else ""
        return f""",
 s{k} AS (SELECT {at}a // 16 AS u, max(c) AS c, list(h ORDER BY a) AS hs FROM {table} GROUP BY ALL),
 f{k} AS (SELECT f.doc_id, f.leaf, f.tree, {keep}, f.subroot,
   CASE WHEN s.c > 1 THEN sha256(array_to_string(hs[1:CAST({place} % 16 AS INT)], '') || acc || array_to_string(hs[CAST({place} % 16 AS INT) + 2:], '')) ELSE acc END AS acc,
   CASE WHEN s.c > 1 THEN proof || array_to_string(hs[1:CAST({place} % 16 AS INT)], '') || array_to_string(hs[CAST({place} % 16 AS INT) + 2:], '') ELSE proof END AS proof
   FROM f{k - 1} f JOIN s{k} s ON {on}s.u = {place} // 16)"""

    for k in range(1, 7):
        out += level(k, f"v{k - 1}", "a", "f.a", "f.a // 16 AS a, f.b")
    for k in range(7, 13):
        out += level(k, f"w{k - 7}", "b", "f.b", "f.a, f.b // 16 AS b")
    return out + " SELECT doc_id, leaf, subroot, (SELECT h FROM w6) AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = (SELECT h FROM w6) AS verified FROM f12"


OP13_SQL = _sql()
