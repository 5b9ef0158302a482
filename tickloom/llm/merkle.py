"""Merkle manifest of a data set: trees of documents for each source, a tree of sources over them, and a climb that checks every document.

Nodes are stored by block: four levels of runs of three under one node, which a row holds as arrays of digests, with a link to the
row (and the place in it) where that node is a child; the last block of a source links into the tree of sources. A recursive query
climbs from every document by these links at once, one block a step, and folds the digest of what is to be checked. It appends the
siblings of the path where it is told to: for one document of each block, as what lies over a block is the same for all that are in it.
A climb over a billion documents is five steps and two for the sources.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Children of a node, levels of a block, and so leaves of a block.
FAN, LEVELS = 3, 4
LEAVES = FAN**LEVELS
#: Documents that climb through one copy of a block; one that more climb through has more copies, so that no step meets in one task.
CLIMBERS = 4096
#: The tree of sources; those of sources have their ranks as numbers.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*fields: Column) -> Column:
    """Digest of fields as text: - for null, else the count of its bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line ends where 2 divides the checksum of the document's number; a null doc_id is left alone."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def numbered(spark: SparkSession, rows: DataFrame, group: list[str], order: list[str], path: str) -> tuple[DataFrame, DataFrame]:
    """rows with row_no, unique and ascending by group and order, and pos, from 0 in each group; and each group's n. Nulls come first.

    Rows are dealt by ranges of group and order, so a large group is many tasks; only counts of (group, task) are added up.
    """
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row_no", F.monotonically_increasing_id())
    sorted_rows = stored(spark, sorted_rows, path)
    task = F.shiftright("row_no", 33).alias("_task")
    counts = sorted_rows.groupBy(*group, task).agg(F.count("*").alias("_n"), F.min("row_no").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(spark, counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))), f"{path}-counts")
    same = F.lit(True)
    left, right = sorted_rows.withColumn("_task", task), counts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_task").alias("_t"), "_first", "_before")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = left.join(right, same & (F.col("_task") == F.col("_t")))
    return out.select(*sorted_rows.columns, (F.col("row_no") - F.col("_first") + F.col("_before")).alias("pos")), counts.groupBy(*group).agg(F.sum("_n").alias("n"))


def _height(n: Column) -> Column:
    """Levels over n nodes until one remains, LEVELS at most."""
    return sum((n > FAN**k).cast("int") for k in range(LEVELS))


def _levels(children: Column, height: Column) -> Column:
    """Digests of children and of the levels over them: height + 1 arrays."""

    def parents(below: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int")), lambda k: F.sha2(F.array_join(F.slice(below, k * FAN + 1, F.lit(FAN)), ""), 256))

    steps = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), height)
    return F.aggregate(steps, F.array(children), lambda done, _: F.concat(done, F.array(parents(F.element_at(done, -1)))))


def build(spark: SparkSession, leaves: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """leaves (tree, pos, digest, n: leaves of the tree, under: documents) to blocks and roots (tree, root).

    blocks: (tree, tier, block, under: documents that climb through, levels: digests of its children and of each level over them but the
    last, parent_tier, parent_block, parent_slot; the last three null for a tree's last block). A tree of one leaf has no block; the leaf is its root.
    """
    nodes, blocks, roots, tier = stored(spark, leaves.select("tree", "pos", "digest", "n", "under"), f"{path}/0"), [], [], 0
    while True:
        roots.append(nodes.where("n = 1").select("tree", F.col("digest").alias("root")))
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            break
        rows = nodes.groupBy("tree", F.floor(F.col("pos") / LEAVES).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("c"), F.first("n").alias("n"), F.sum("under").alias("under"))
        rows = rows.withColumn("levels", _levels(F.transform("c", lambda x: x["digest"]), _height(F.col("n")))).drop("c")
        rows = stored(spark, rows, f"{path}/blocks{tier}")
        link = lambda c: F.when(F.col("n") > LEAVES, c)
        blocks.append(rows.select("tree", F.lit(tier).alias("tier"), "block", "under", F.expr("transform(slice(levels, 1, size(levels) - 1), l -> transform(l, d -> unhex(d)))").alias("levels"), link(F.lit(tier + 1)).alias("parent_tier"), link(F.floor(F.col("block") / LEAVES)).alias("parent_block"), link((F.col("block") % LEAVES).cast("int")).alias("parent_slot")))
        nodes = rows.select("tree", F.col("block").alias("pos"), F.element_at(F.element_at("levels", -1), 1).alias("digest"), F.ceil(F.col("n") / LEAVES).alias("n"), "under")
        tier += 1
    none = spark.createDataFrame([], "tree long, tier int, block long, under long, levels array<array<binary>>, parent_tier int, parent_block long, parent_slot int")
    for b in blocks:
        none = none.unionByName(b)
    whole = roots[0]
    for r in roots[1:]:
        whole = whole.unionByName(r)
    return none, whole


@contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    """Recursion over more than the million rows that are allowed by default."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _step(levels: str, slot: str, folded: str) -> str:
    """The path from a slot up to the block's node, in SQL: of each level, the run's other digests are appended to the proof, and the run with the folded digest in its place is folded."""
    run = [f"get(level, s.slot - s.slot % {FAN} + {k})" for k in range(FAN)]
    hexed = lambda c: f"coalesce(lower(hex({c})), '')"
    return f"""aggregate({levels}, named_struct('slot', {slot}, 'folded', {folded}, 'proof', unhex('')), (s, level) -> named_struct('slot', cast(floor(s.slot / {FAN}) as int),
        'folded', unhex(sha2(concat({", ".join(hexed(f"if(s.slot % {FAN} = {k}, s.folded, {r})") for k, r in enumerate(run))}), 256)),
        'proof', concat(s.proof, {", ".join(f"coalesce(if(s.slot % {FAN} = {k}, null, {r}), unhex(''))" for k, r in enumerate(run))})))"""


#: Rows of start go up block by block until there is no parent. Siblings are appended where kept says so.
CLIMB = f"""
    with recursive climb(a, b, tree, tier, block, copy, slot, folded, kept, proof) as (
        select a, b, tree, 0, block, 0L, slot, folded, kept, unhex('') from {{start}} where tree is not null
        union all
        select a, b, parent_tree, parent_tier, parent_block, pmod(xxhash64(a, b), parent_copies), parent_slot, path.folded, kept, if(kept, concat(proof, path.proof), proof) from (
            select c.a, c.b, n.parent_tree, n.parent_tier, n.parent_block, n.parent_slot, n.parent_copies, c.kept, c.proof, {_step("n.levels", "c.slot", "c.folded")} path
            from climb c join {{nodes}} n on c.tree = n.tree and c.tier = n.tier and c.block = n.block and c.copy = n.copy))
    select a, b, folded, proof from climb where tree is null"""


def _climbed(spark: SparkSession, start: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """(a, b, folded, proof) of start (a, b, tree, block, slot, folded, kept) at the root; those whose tree is null are there already."""
    with _unlimited(spark):
        up = stored(spark, spark.sql(CLIMB, start=start, nodes=nodes), path)
    return up.unionByName(start.where("tree is null").select("a", "b", "folded", F.unhex(F.lit("")).alias("proof")))


def linked(blocks: DataFrame) -> DataFrame:
    """blocks with parent_tree and the rest of the link to node rows: as many copies as its climbers need (copy), and of its parent (parent_copies)."""
    blocks = blocks.withColumn("copies", F.ceil(F.col("under") / CLIMBERS))
    parents = blocks.select(F.col("tree").alias("parent_tree"), F.col("tier").alias("parent_tier"), F.col("block").alias("parent_block"), F.col("copies").alias("parent_copies"))
    return blocks.join(parents, ["parent_tree", "parent_tier", "parent_block"], "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("under", "copies")


def manifest(spark: SparkSession, docs: DataFrame, tampered=tampered_text) -> DataFrame:
    """One row for every row of docs (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    tampered gives the text that is checked, from doc_id and text; everything else comes from the rows as they are. Leaves of a source
    ascend by doc_id, a null one first, then by digest, so rows that repeat a doc_id have an order, and equal rows are leaves of their own.
    Sources ascend by their bytes, null first. Null fields are leaves' dashes; a document alone in its source is that source's root, and
    alone in the table, the root, with an empty proof. Extra columns are ignored; an empty table gives an empty result.
    """
    folder = shared_dir(spark)
    fields = [F.col(c) for c in FIELDS]
    changed = leaf_digest(*fields[:-1], tampered(F.col("doc_id"), F.col("text")))
    rows = docs.select("source", "doc_id", leaf_digest(*fields).alias("leaf"), changed.alias("changed")).withColumn("changed", F.when(F.col("changed") != F.col("leaf"), F.col("changed")))
    rows, sizes = numbered(spark, rows, ["source"], ["doc_id", "leaf"], f"{folder}/rows")
    sources, totals = numbered(spark, sizes, [], ["source"], f"{folder}/sources")
    sources = stored(spark, sources.select("source", F.col("pos").alias("tree"), "n"), f"{folder}/ranks")
    rows = rows.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = stored(spark, rows, f"{folder}/leaves")
    own, subroots = build(spark, rows.select("tree", "pos", F.col("leaf").alias("digest"), "n", F.lit(1).alias("under")), f"{folder}/own")
    subroots = stored(spark, subroots.join(sources.select("tree", F.col("n").alias("under")), "tree"), f"{folder}/subroots")
    number = totals.first()["n"] or 0
    top, root = build(spark, subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("digest"), F.lit(number).cast("long").alias("n"), "under"), f"{folder}/top")
    # the last block of a source links to its place in the tree of sources, if there is one
    above = F.lit(number > 1)
    into = lambda own_link, top_link, kind: F.coalesce(own_link, F.when(above, top_link)).cast(kind)
    own = own.withColumns({"parent_tree": F.when(F.col("parent_tier").isNotNull(), F.col("tree")).when(above, F.lit(TOP)).cast("long"), "parent_tier": into(F.col("parent_tier"), F.lit(0), "int"), "parent_block": into(F.col("parent_block"), F.floor(F.col("tree") / LEAVES), "long"), "parent_slot": into(F.col("parent_slot"), F.col("tree") % LEAVES, "int")})
    top = top.withColumn("parent_tree", F.when(F.col("parent_tier").isNotNull(), F.lit(TOP)).cast("long"))
    nodes = stored(spark, linked(stored(spark, own.unionByName(top), f"{folder}/blocks")), f"{folder}/nodes")
    alone = F.col("n") == 1
    tree = F.when(~alone, F.col("tree")).when(above, F.lit(TOP)).cast("long")
    place = F.when(~alone, F.col("pos")).otherwise(F.col("tree"))
    at = [tree.alias("tree"), F.floor(place / LEAVES).cast("long").alias("block"), (place % LEAVES).cast("int").alias("slot")]
    # every document climbs with the digest that is checked; the proof over a block, the same for all its documents, is carried up by the block's first
    start = rows.select(F.col("row_no").alias("a"), F.lit(0).cast("long").alias("b"), *at, F.unhex(F.coalesce("changed", "leaf")).alias("folded"), F.lit(False).alias("kept"))
    first = rows.where(F.col("pos") % LEAVES == 0).select(F.col("tree").alias("a"), F.floor(F.col("pos") / LEAVES).cast("long").alias("b"), *at, F.unhex("leaf").alias("folded"), F.lit(True).alias("kept"))
    climbed = _climbed(spark, start, nodes, f"{folder}/climbed").select(F.col("a").alias("row_no"), F.col("folded"))
    proofs = _climbed(spark, first, nodes, f"{folder}/proofs").select(F.col("a").alias("tree"), F.col("b").alias("block"), "proof")
    # of that proof, what comes after the siblings within the block holds for all its documents; theirs within it are read from the block
    lowest = nodes.where("tree >= 0 and tier = 0 and copy = 0").select("tree", "block", "levels")
    within = F.expr(_step("levels", f"cast(pos % {LEAVES} as int)", "unhex(leaf)") + ".proof")
    own_length = "length(" + _step("levels", "0", "unhex('')") + ".proof)"
    both = proofs.join(lowest, ["tree", "block"], "left").withColumn("rest", F.when(F.col("levels").isNull(), F.col("proof")).otherwise(F.expr(f"substring(proof, {own_length} + 1)"))).drop("proof")
    out = rows.withColumn("block", F.floor(F.col("pos") / LEAVES).cast("long")).join(both, ["tree", "block"]).withColumn("proof", F.concat(F.coalesce(within, F.unhex(F.lit(""))), F.col("rest")))
    out = out.select("row_no", "tree", "doc_id", "leaf", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"))
    out = out.join(subroots.select("tree", F.col("root").alias("subroot")), "tree").join(climbed, "row_no").crossJoin(F.broadcast(root.select("root")))  # one row, or none for an empty table
    folded = F.lower(F.hex("folded"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))
