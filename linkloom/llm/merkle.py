"""Merkle dataset manifest, checked by a recursive climb.

A leaf is the sha256 of its row's fields, each written as ``-`` for null, else
its UTF-8 byte count, ``:`` and its value.  The leaves of a group ascend by id;
while several nodes remain, every ``fan`` consecutive ones become the sha256 of
their joined hex digests.  The groups' roots, ordered by group, make the root of
the manifest the same way.

1. Leaves are numbered inside their group over range partitions (a group may hold
   a third of all rows): rows are numbered where they lie, and one row a
   (partition, group) carries the offsets.
2. Levels are built bottom up, one exchange of narrow rows a level, and stored as
   node rows with a link to their parent and the siblings on both sides.
3. A recursive query starts at the lowest nodes and follows the links: every step
   joins the next node row, appends its siblings to the proof and folds the
   hashes that were given.  The leaves of one lowest node share all links above it,
   so a row of the query holds these (at most ``fan``) leaves side by side, each
   with a folded hash of its own, and the proof above them once.

A node high up is on the way of very many rows: its row is stored once for every
``MEETINGS`` of them and the climbers are dealt over the copies, so no join key is
hot.  The driver holds the root alone.

Defined results: null fields are ``-`` (a null group is a group and comes first;
null ids come first and are not tampered); rows of one id are ordered by leaf;
repeated rows are leaves of their own; null and empty texts differ; a group of one
row has its leaf as root and no siblings there; a proof without siblings is the
sha256 of the empty text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import ascii_lower, stage

#: climbers that meet one stored copy of a node row
MEETINGS = 4096
ROW_LIMIT, LEVEL_LIMIT = "spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"


def field(c: Column) -> Column:
    """``-`` or byte count, ``:``, value; never empty."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_rows(docs: DataFrame, id_col: str, group_col: str, fields: list[str], text_col: str, every: int) -> DataFrame:
    """id, grp, tree, leaf, tampered (null where nothing is tampered with), salt."""
    at = fields.index(text_col)
    before = [field(F.col(c)) for c in fields[:at]]
    after = [field(F.col(c)) for c in fields[at + 1:]]
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % every == 0, F.lit(False))
    return docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("grp"), field(F.col(group_col)).alias("tree"),
        _hash(*before, field(F.col(text_col)), *after).alias("leaf"),
        F.when(hit, _hash(*before, field(ascii_lower(F.col(text_col))), *after)).alias("tampered"),
        F.monotonically_increasing_id().alias("salt"))


def positions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds pos (from 0) and cnt, each row's place in its group and the group's size."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    keys = [F.col(key), *[F.col(c).asc_nulls_first() for c in order]]
    placed = stage(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(
        "_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "merkle-placed")
    # one row a (partition, group)
    runs = placed.groupBy("_part", key).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key)
    so_far = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_part", key, (F.coalesce(so_far, F.lit(0)) - F.col("_first")).alias("_shift"),
                       F.sum("_n").over(w).alias("cnt"))
    return (placed.join(runs, ["_part", key]).withColumn("pos", F.col("_row") + F.col("_shift"))
            .drop("_part", "_row", "_shift"))


def build_levels(nodes: DataFrame, fan: int, up: str | None):
    """(node rows, tops): all nodes below the tops with parent link and siblings.

    nodes: tree, grp, level, pos, cnt (nodes of the tree on this level), digest,
    w (lowest nodes below); up: a path prefix of the stored names."""
    parts, tops = [], []
    while True:
        tops.append(nodes.where("cnt = 1").select("tree", "grp", "level", "pos", "digest", "w"))
        kids = F.sort_array(F.collect_list(F.struct("pos", "digest", "w")))
        parents = stage(
            nodes.where("cnt > 1").groupBy("tree", "grp", "level", (F.expr(f"pos div {fan}")).alias("up"), "cnt")
            .agg(kids.alias("kids"), F.sum("w").alias("up_w"))
            .withColumn("digest", F.sha2(F.array_join("kids.digest", ""), 256)), f"merkle-{up}")
        if parents.isEmpty():
            break
        low = parents.select("tree", "level", "up", "up_w", "kids", F.posexplode("kids").alias("slot", "kid"))
        parts.append(low.select(
            "tree", "level", F.col("kid.pos").alias("pos"), F.col("kid.digest").alias("digest"), F.col("kid.w").alias("w"),
            F.expr("array_join(slice(kids.digest, 1, slot), '')").alias("before"),
            F.expr(f"array_join(slice(kids.digest, slot + 2, {fan}), '')").alias("after"),
            F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), F.col("up").alias("up_pos"), "up_w"))
        nodes = parents.select("tree", "grp", (F.col("level") + 1).alias("level"), F.col("up").alias("pos"),
                               F.expr(f"(cnt + {fan - 1}) div {fan}").alias("cnt"), "digest", F.col("up_w").alias("w"))
    return parts, tops


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CLIMB = """
WITH RECURSIVE climb(tree, run, folded, proof, subroot, at_tree, at_level, at_pos, w) AS (
  SELECT tree, pos, folded, '', CAST(NULL AS STRING), tree, level, pos, 1L FROM {start}
  UNION ALL
  SELECT c.tree, c.run, transform(c.folded, h -> sha2(concat(n.before, h, n.after), 256)),
         concat(c.proof, n.before, n.after), coalesce(c.subroot, n.subroot), n.up_tree, n.up_level, n.up_pos, n.up_w
  FROM climb c JOIN {nodes} n ON n.tree = c.at_tree AND n.level = c.at_level AND n.pos = c.at_pos
   AND n.copy = pmod(xxhash64(c.tree, c.run), 1 + c.w div {meetings}))
SELECT tree, run, folded, proof, subroot FROM climb WHERE at_tree = '{top_tree}' AND at_level = {top_level}
"""


def climb(start: DataFrame, nodes: DataFrame, top: tuple[str, int]) -> DataFrame:
    """tree, run, folded, proof, subroot of every lowest node when it has come to the
    root ``top`` (tree, level).  The rows that a recursive query may make are not
    bounded here: they are the lowest nodes times the levels."""
    spark = start.sparkSession
    names = [f"merkle_{x}_{id(start)}" for x in ("start", "nodes")]
    start.createOrReplaceTempView(names[0])
    nodes.createOrReplaceTempView(names[1])
    old = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, -1)
    try:
        quoted = top[0].replace("\\", "\\\\").replace("'", "\\'")
        return stage(spark.sql(CLIMB.format(start=names[0], nodes=names[1], meetings=MEETINGS, top_tree=quoted,
                                            top_level=top[1])), "merkle-climbed")
    finally:
        spark.conf.set(ROW_LIMIT, old)
        for n in names:
            spark.catalog.dropTempView(n)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text",
             fan: int = 16, every: int = 5) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Every ``every``-th id by checksum is tampered with (A-Z of its text in lower
    case) before its hash is folded along the original siblings."""
    leaves = positions(stage(leaf_rows(docs, id_col, group_col, list(fields), text_col, every), "merkle-leaves"),
                       "tree", ["id", "leaf", "salt"])
    kids = F.sort_array(F.collect_list(F.struct("pos", "id", "leaf", "tampered")))
    runs = stage(leaves.groupBy("tree", "grp", F.expr(f"pos div {fan}").alias("run"), "cnt").agg(kids.alias("kids")),
                 "merkle-runs")
    digest = F.when(F.col("cnt") == 1, F.col("kids")[0]["leaf"]).otherwise(F.sha2(F.array_join("kids.leaf", ""), 256))
    lowest = runs.select("tree", "grp", F.lit(1).alias("level"), F.col("run").alias("pos"),
                         F.expr(f"(cnt + {fan - 1}) div {fan}").alias("cnt"), digest.alias("digest"), F.lit(1).cast("long").alias("w"))
    parts, tops = build_levels(lowest, fan, "tree")
    subroots = stage(_union(tops), "merkle-subroots")
    if subroots.isEmpty():
        return runs.select(F.lit(None).cast(docs.schema[id_col].dataType).alias("id"), *[
            F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
            F.lit(False).alias("verified")).where("false")
    # the subroots are the lowest nodes of the upper tree '' (no group's name is empty)
    ranked = stage(positions(subroots.withColumn("one", F.lit("")), "one", ["grp"]), "merkle-ranked")
    upper, (*_, last) = build_levels(ranked.select(
        F.lit("").alias("tree"), F.lit(None).cast("string").alias("grp"), F.lit(1).alias("level"), "pos", "cnt", "digest", "w"),
        fan, "upper")
    # a group's root takes the place of its node in the upper tree
    crossing = ranked.select(
        F.col("tree").alias("low_tree"), F.col("level").alias("low_level"), F.col("pos").alias("up_at"))
    if upper:
        first, *above = upper
        entry = first.join(crossing, F.col("pos") == F.col("up_at")).select(
            F.col("low_tree").alias("tree"), F.col("low_level").alias("level"), F.lit(0).cast("long").alias("pos"), "digest", "w",
            "before", "after", "up_tree", "up_level", "up_pos", "up_w", F.col("digest").alias("subroot"))
        none = F.lit(None).cast("string").alias("subroot")
        nodes = _union([entry, *[p.select("*", none) for p in [*parts, *above]]])
        top = last.first()
        goal = (top["tree"], top["level"])
    else:  # one group: its root is the root
        top = ranked.first()
        goal = (top["tree"], top["level"])
        nodes = _union(parts or [_no_nodes(ranked)]).withColumn("subroot", F.lit(None).cast("string"))
    copies = F.expr(f"explode(sequence(0L, w div {MEETINGS}))").alias("copy")
    nodes = stage(nodes.select("tree", "level", "pos", "before", "after", "up_tree", "up_level", "up_pos", "up_w",
                               "subroot", copies), "merkle-nodes")
    # the first fold: a leaf among its own run
    changed = "coalesce(k.tampered, k.leaf)"
    folded = F.expr(f"""CASE WHEN cnt = 1 THEN transform(kids, k -> {changed}) ELSE transform(kids, (k, i) -> sha2(concat(
        array_join(slice(kids.leaf, 1, i), ''), {changed}, array_join(slice(kids.leaf, i + 2, {fan}), '')), 256)) END""")
    start = stage(runs.select("tree", F.col("run").alias("pos"), F.lit(1).alias("level"), folded.alias("folded")),
                  "merkle-start")
    done = climb(start, nodes, goal)
    root = top["digest"]
    each = runs.join(done, ["tree", "run"]).select("kids", "folded", "proof", "subroot", F.posexplode("kids").alias("i", "kid"))
    beside = F.expr(f"concat(array_join(slice(kids.leaf, 1, i), ''), array_join(slice(kids.leaf, i + 2, {fan}), ''), proof)")
    mine = F.expr("element_at(folded, i + 1)")
    return each.select(
        F.col("kid.id").alias("id"), F.col("kid.leaf").alias("leaf"), F.coalesce("subroot", F.lit(root)).alias("subroot"),
        F.lit(root).alias("root"), F.sha2(beside, 256).alias("proof_sha256"), mine.alias("folded_root"),
        (mine == F.lit(root)).alias("verified"))


def _no_nodes(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(
        [], "tree string, level int, pos long, digest string, w long, before string, after string, up_tree string, "
            "up_level int, up_pos long, up_w long")
