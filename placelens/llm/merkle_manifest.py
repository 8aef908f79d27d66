"""Merkle manifest of a table: a hash tree a source, a tree over the sources, and a recursive climb.

Leaves hash a row's fields. Within a source they ascend by id, and every ``FAN`` (16)
consecutive nodes become the hash of their hashes until one is left, the subroot;
subroots in the order of their sources likewise give the root.

Building: rows are numbered by a range sort and the ranges' counts, so that a source
with a large share of all rows is spread like any other. A node's number is that of
its first leaf, from which its parent's number follows by arithmetic; each level is
one grouping of at most 16 rows a key, written to the shared folder.

Proving: inner nodes are stored as rows (number, parent, slot, the children's hashes).
A recursive SQL query climbs from the lowest inner node of every leaf to the root,
appends the other children's hashes and folds the hashes that it carries. Leaves of one
parent climb in one row, as they share all siblings above it. Near the root all climbers
would meet in one node, so a node has a copy for each block of ``BLOCK`` leaves below it,
and a climber meets that of its own block.

Defined results: a null field counts as "-"; null sources and ids come first; equal ids
are ordered by their leaf, and equal rows are leaves of their own; an empty table
gives an empty manifest; a lone leaf is its own root, its proof the hash of nothing. Only
the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from placelens.scratch import materialize

# The tree's arity, the fields of a leaf, and what tampering does.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Leaves whose climbers meet in one copy of a node (a sixteenth as many rows).
BLOCK = 512
#: Levels from which nodes belong to the tree over the sources.
TOP = 100


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields, each as its number of bytes, a colon and its text, or as "-"."""

    def one(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*map(one, fields)))


def leaves(rows: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, leaf, shown): ``shown`` is the leaf as a reader of the tampered table sees it."""
    plain = [F.col(c) for c in fields]
    lower = [F.translate(c.cast("string"), UPPER, LOWER) if name == text_col else c for name, c in zip(fields, plain, strict=True)]
    touched = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    return rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf_hash(plain).alias("leaf"), F.when(touched, leaf_hash(lower)).alias("changed")).select(
        "id", "source", "leaf", F.coalesce("changed", "leaf").alias("shown")
    )


#: Rows of counts up to which they are broadcast (about 60 bytes each).
BROADCAST_COUNTS = 200_000


def numbered(rows: DataFrame, order: list[str], by: str) -> DataFrame:
    """``rows`` with ``number``, the place in ``order`` (nulls first), and, in the order's first column ``by``, with ``place`` and ``of``, how many share it.

    Rows are sorted into ranges and numbered within each; counts of the ranges and of
    what shares ``by`` in them move the numbers. Rows that are equal in ``order`` are
    split by where they were read, so a range has no more than its share of them.
    """
    spread = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    # the upper bits are the range, the lower 33 the place in it
    ranged = materialize(ranged.withColumn("__m", F.monotonically_increasing_id()).withColumn("__range", F.expr("__m >> 33")), "ranges")
    counts = ranged.groupBy("__range", by).agg(F.count("*").alias("n"))
    before = counts.groupBy("__range").agg(F.sum("n").alias("rows"))
    before = before.select("__range", (F.sum("rows").over(Window.orderBy("__range")) - F.col("rows")).alias("before"))
    same, inside = Window.partitionBy(by), Window.partitionBy("__range").orderBy(by)
    counts = counts.join(F.broadcast(before), "__range").select(
        F.col("__range").alias("r"), F.col(by).alias("b"), "before", F.sum("n").over(same).alias("of"),
        (F.sum("n").over(same.orderBy("__range")) - F.sum("n").over(inside)).alias("shift"),
    )
    counts = materialize(counts, "counts")
    few = counts.count() <= BROADCAST_COUNTS
    met = ranged.join(F.broadcast(counts) if few else counts, (F.col("__range") == F.col("r")) & F.col(by).eqNullSafe(F.col("b")))
    row = F.expr("__m & 8589934591")
    # shift: rows that share ``by`` up to this range, less rows of this range up to ``by``
    return met.select(*rows.columns, (F.col("before") + row).alias("number"), (row + F.col("shift")).alias("place"), "of")


LINK = ("up_level", "up_number", "slot")


def linked(level: DataFrame, depth: int, number: str = "low") -> DataFrame:
    """Rows (low, place, ...) of nodes of a source's tree at ``depth`` with their parent's level and number, and their slot in it."""
    span = FAN**depth
    slot = F.expr(f"place div {span}") % FAN
    return level.withColumns({"up_level": F.lit(depth + 1), "up_number": F.col(number) - slot * span, "slot": slot.cast("int")})


def parents(children: DataFrame, *first: str) -> DataFrame:
    """(level, number, children, hash, low, high, *first) of the parents of linked rows: the hashes of up to 16 rows in order, and theirs."""
    in_order = F.array_sort(F.collect_list(F.struct("slot", "hash")))
    text = F.array_join(F.transform(in_order, lambda c: c["hash"]), "")
    up = children.groupBy(F.col("up_level").alias("level"), F.col("up_number").alias("number"))
    return up.agg(text.alias("children"), F.min("low").alias("low"), F.max("high").alias("high"), *(F.min(c).alias(c) for c in first)).withColumn("hash", digest(F.col("children")))


def bottom(leaves: DataFrame) -> DataFrame:
    """Lowest nodes: runs of up to 16 leaves (level 1), and lone leaves (level 0), with ``members`` (slot, id, leaf, shown)."""
    member = F.struct(F.col("slot"), "id", "leaf", "shown")
    runs = linked(leaves.where("of > 1").withColumn("low", F.col("number")), 0).groupBy(F.col("up_number").alias("low"))
    runs = runs.agg(F.max("number").alias("high"), F.min("place").alias("place"), F.first("of").alias("of"), F.array_sort(F.collect_list(member)).alias("members"))
    runs = runs.select(F.lit(1).alias("level"), "low", "high", "place", "of", "members")
    runs = runs.withColumn("children", F.array_join(F.transform("members", lambda m: m["leaf"]), "")).withColumn("hash", digest(F.col("children")))
    lone = leaves.where("of = 1").withColumn("slot", F.lit(0))
    lone = lone.select(F.lit(0).alias("level"), F.col("number").alias("low"), F.col("number").alias("high"), "place", "of", F.array(member).alias("members"), F.lit("").alias("children"), F.col("leaf").alias("hash"))
    return runs.unionByName(lone)


def build(numbered_leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lowest nodes with their links, all nodes above leaves) of leaves (id, leaf, shown, number, place, of).

    Nodes are (level, number, up_level, up_number, slot, children, hash, low, high); the
    one without a parent is the root. ``low`` and ``high`` are the first and last leaf below.
    """
    runs = materialize(bottom(numbered_leaves), "runs")
    most = runs.agg(F.max("of")).first()[0] or 0
    parts, now, depth = ["level", "low", "high", "hash", "children"], runs, 1
    subroots, inner = runs.where(F.col("of") <= FAN).select(*parts), []
    while FAN**depth < most:
        child = linked(now.where(F.col("of") > FAN**depth), depth)
        if depth > 1:
            inner.append(child.select("level", F.col("low").alias("number"), *LINK, "children", "hash", "low", "high"))
        up = parents(child, "place", "of")
        now, depth = materialize(up, "level"), depth + 1
        subroots = subroots.unionByName(now.where(F.col("of") <= FAN**depth).select(*parts))
    # subroots follow one another as their sources do, so that the first leaf orders them
    top = numbered(subroots, ["low"], "low").drop("place", "of").withColumnRenamed("number", "rank")
    top = materialize(top, "subroots")
    many = top.count()
    up_link = {"up_level": F.lit(TOP + 1), "up_number": F.expr(f"rank div {FAN}"), "slot": (F.col("rank") % FAN).cast("int")}
    if many == 1:
        up_link = {k: F.lit(None).cast("int" if k != "up_number" else "long") for k in up_link}
    top = top.withColumns(up_link)
    inner.append(top.where("level > 1").select("level", F.col("low").alias("number"), *LINK, "children", "hash", "low", "high"))
    now, height = top, 0
    while many > 1:
        up, height, many = materialize(parents(now), "top"), height + 1, -(-many // FAN)
        slot, above = (F.col("number") % FAN).cast("int"), F.expr(f"number div {FAN}")
        here = many > 1
        now = up.withColumns(
            {
                "up_level": F.lit(TOP + height + 1 if here else None).cast("int"), "up_number": (above if here else F.lit(None)).cast("long"), "slot": (slot if here else F.lit(None)).cast("int"),
            }
        )
        inner.append(now.select("level", "number", *LINK, "children", "hash", "low", "high"))
    # lowest nodes that are subroots are linked to the tree over the sources
    of_top = top.where("level <= 1").select(F.col("low").alias("t_low"), *(F.col(c).alias(f"t_{c}") for c in LINK))
    alone = F.col("of") <= FAN
    starts = linked(runs, 1).join(of_top, F.col("low") == F.col("t_low"), "left")
    starts = starts.withColumns({c: F.when(alone, F.col(f"t_{c}")).otherwise(F.col(c)) for c in LINK}).select(*runs.columns, *LINK)
    inner.append(starts.where("level = 1").select("level", F.col("low").alias("number"), *LINK, "children", "hash", "low", "high"))
    nodes = inner[0]
    for some in inner[1:]:
        nodes = nodes.unionByName(some)
    return starts, nodes


def copies(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``nodes`` above the lowest, once for each block of leaves that they reach into."""
    reach = F.sequence(F.expr(f"low div {block}"), F.expr(f"high div {block}"))
    return nodes.where("level > 1").select("level", "number", *LINK, "children", "hash", F.explode(reach).alias("block"))


def folded(children: Column, slot: Column, own: Column) -> Column:
    """Hash of the children with the one in ``slot`` replaced."""
    return digest(F.concat(before(children, slot), own, after(children, slot)))


def before(children: Column, slot: Column) -> Column:
    return F.substring(children, F.lit(1), slot * 64)


def after(children: Column, slot: Column) -> Column:
    return F.substring(children, slot * 64 + 65, F.lit(64 * FAN))


CLIMB = """
with recursive climb(start, block, up_level, up_number, slot, folded, proof, subroot, root) as (
  select low, block, up_level, up_number, slot, folded, cast('' as string), cast(null as string), root from {starts}
  union all
  select c.start, c.block, n.up_level, n.up_number, n.slot,
         transform(c.folded, f -> sha2(substr(n.children, 1, 64 * c.slot) || f || substr(n.children, 64 * c.slot + 65), 256)),
         c.proof || substr(n.children, 1, 64 * c.slot) || substr(n.children, 64 * c.slot + 65),
         case when n.level = {first_top} then substr(n.children, 64 * c.slot + 1, 64) else c.subroot end,
         case when n.up_level is null then n.hash end
  from climb c join {nodes} n on n.level = c.up_level and n.number = c.up_number and n.block = c.block)
select start, folded, proof, coalesce(subroot, root) as subroot, root from climb where up_level is null
"""

#: Rows that a recursion may return: its limit is no limit of ours.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def climb(starts: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(start, folded, proof, subroot, root) of every lowest node: what its members' shown leaves fold to at the root, and all siblings above it."""
    spark = starts.sparkSession
    shown = F.transform("members", lambda m: F.when(F.col("level") == 1, folded(F.col("children"), m["slot"], m["shown"])).otherwise(m["shown"]))
    anchors = starts.select(
        "low", F.expr(f"low div {block}").alias("block"), *LINK, shown.alias("folded"), F.when(F.col("up_level").isNull(), F.col("hash")).alias("root")
    )
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return materialize(spark.sql(CLIMB, starts=materialize(anchors, "starts"), nodes=materialize(copies(nodes, block), "nodes"), first_top=TOP + 1), "climb")
    finally:
        spark.conf.set(ROW_LIMIT, limit)


def verified(starts: DataFrame, climbed: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf."""
    met = starts.select("low", "children", F.posexplode("members").alias("k", "m"), "members").drop("members").join(climbed, F.col("low") == F.col("start"))
    slot = F.col("m.slot")
    proof = F.concat(before(F.col("children"), slot), after(F.col("children"), slot), F.col("proof"))
    out = met.select(F.col("m.id").alias("id"), F.col("m.leaf").alias("leaf"), "subroot", "root", digest(proof).alias("proof_sha256"), F.col("folded")[F.col("k")].alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows' leaves, proofs and what the tampered table's leaves fold to."""
    placed = numbered(leaves(rows, fields, id_col, source_col, text_col), ["source", "id", "leaf"], "source")
    starts, nodes = build(placed)
    starts = materialize(starts, "lowest")
    return verified(starts, climb(starts, nodes, block)).withColumnRenamed("id", id_col)
