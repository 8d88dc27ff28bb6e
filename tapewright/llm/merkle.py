"""Merkle manifest of a document table: a tree of hashes per source, a tree of the sources' roots above, stored every few levels.

A leaf is the hash of a document's fields. Leaves of a source ascend by doc_id; every FAN consecutive nodes become one node, until one
remains, the source's subroot; subroots in the order of their sources become the root in the same way. Of a tree only every STRIDE-th
level is written. A proof is extracted from the top down: the stored nodes below one stored node (an aligned subtree, FAN ** STRIDE nodes
at most) are gathered in one row, the levels between are computed again in that row, the siblings of each node are emitted as what lies left and
right of it, and the interior nodes are gone with the row. So a task holds one subtree at a time, whatever the table's size.

Positions come from a range-sorted table: rows are numbered in their partition, and a partition's rows of a source start behind those of the
partitions before it. A source that holds most rows spreads over partitions like any other; texts are hashed where they are read and never move.

Defined results: a null field is hashed as `-`, an empty one as `0:`. Null doc_ids come first in their source; rows of one source and id are ordered by leaf,
so repeated rows, which are interchangeable, have their own positions. Null is a source of its own and the first. An empty
table has no root and no row. Extra columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tapewright.llm.tables import stored

FAN = 16
STRIDE = 2
SUBTREE = FAN**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, size long, pos long, node string"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(text: Column) -> Column:
    """Hash of a document's fields with the given text."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" else F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(F.concat(*parts))


# ---- positions ---------------------------------------------------------------------------------


def _sorted(rows: DataFrame, order: list[str], purpose: str) -> DataFrame:
    """The rows in a stored table whose partitions are ranges of the order, with partition and place there."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stored(dealt.withColumns({"part": F.spark_partition_id(), "place": place}), purpose)


def _before(spans: DataFrame, *keys: str) -> DataFrame:
    """Rows in the partitions before; a key has as many spans as there are partitions, no more."""
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _leaves(docs: DataFrame, claimed_text: Column | None) -> tuple[DataFrame, DataFrame]:
    """Level 0 of the sources' trees, and (source, tree, size), trees numbered in the order of sources."""
    claim = F.lit(None).cast("string") if claimed_text is None else F.when(claimed_text.isNotNull(), leaf(claimed_text))
    rows = docs.select("source", "doc_id", leaf(F.col("text")).alias("node"), claim.alias("claim"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    # The row number spreads repeated rows over partitions.
    placed = _sorted(rows, ["source", "doc_id", "node", "row"], "merkle-placed").drop("row")
    spans = stored(placed.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")), "merkle-spans")
    sizes = _sorted(spans.groupBy("source").agg(F.sum("n").alias("size")), ["source"], "merkle-sources")
    parts = _before(sizes.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    sources = sizes.join(parts, "part").select("source", (F.col("place") + F.col("before")).alias("tree"), "size")
    sources = stored(sources, "merkle-trees")
    spans = _before(spans, "source").alias("s").join(sources.alias("t"), F.expr("s.source <=> t.source"))
    spans = spans.select("s.part", "s.source", "s.first", "s.before", "t.tree", "t.size")
    level = placed.alias("p").join(spans.alias("s"), F.expr("p.part = s.part AND p.source <=> s.source"))
    pos = F.col("p.place") - F.col("s.first") + F.col("s.before")
    return level.select("s.tree", "s.size", pos.alias("pos"), "p.node", "p.doc_id", "p.claim"), sources


# ---- subtrees ----------------------------------------------------------------------------------


def _blocks(level: DataFrame, *payload: str) -> DataFrame:
    """One row for each aligned subtree of a level's nodes, in order."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "node", *payload))).alias("rows")
    block = F.floor(F.col("pos") / SUBTREE).alias("block")
    grouped = level.groupBy("tree", block).agg(F.first("size").alias("size"), rows)
    return grouped.withColumn("level0", F.col("rows.node"))


def _parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FAN + 1, FAN), "")))


def _interior(blocks: DataFrame) -> DataFrame:
    """The subtree's levels that are not stored, level1 to level{STRIDE}."""
    for k in range(STRIDE):
        blocks = blocks.withColumn(f"level{k + 1}", _parents(F.col(f"level{k}")))
    return blocks


def _top(size: Column) -> Column:
    """The level below the next stored one at which one node remains, as a choice of the blocks' level columns."""
    choice = F.col("level0")
    for k in range(STRIDE):
        choice = F.when(size > FAN**k, F.col(f"level{k + 1}")).otherwise(choice)
    return choice[0]


def _levels(path: str, level: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of a forest, lowest first, and (tree, root). Level numbers count stored levels."""
    spark = level.sparkSession

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    levels, roots, number = [written(level, "level=0")], [], 0
    while True:
        above = _interior(_blocks(levels[-1])).select("tree", "size", F.col("block").alias("pos"), _top(F.col("size")).alias("node"))
        if largest <= SUBTREE:
            roots.append(above)
            break
        # Trees that end here and trees that go on are written together, once.
        number += 1
        above = written(above, f"level={number}")
        roots.append(above.where(F.col("size") <= SUBTREE))
        going = above.where(F.col("size") > SUBTREE)
        levels.append(going.withColumn("size", F.ceil(F.col("size") / SUBTREE)))
        largest = -(-largest // SUBTREE)
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    return levels, every.select("tree", F.col("node").alias("root"))


def _paths(levels: list[DataFrame], trees: DataFrame, *payload: str) -> DataFrame:
    """(tree, pos, node, payload, path) of the lowest level's nodes; `trees` has (tree, size, path) of each tree's root.

    A path lists, level by level up to the root, the siblings left and right of the way.
    """
    above = None
    for number in reversed(range(len(levels))):
        size = F.col("size")
        for _ in range(number):
            size = F.ceil(size / SUBTREE)
        ended = trees.select("tree", size.alias("at"), "size", "path")
        # A tree's highest stored level is the one that fits one subtree, where the level below did not.
        here = F.col("at") <= SUBTREE
        if number:
            below = F.col("size")
            for _ in range(number - 1):
                below = F.ceil(below / SUBTREE)
            here = here & (below > SUBTREE)
        upper = ended.where(here).select("tree", F.lit(0).cast("long").alias("block"), "path")
        if above is not None:
            upper = upper.unionByName(above.select("tree", F.col("pos").alias("block"), "path"))
        extra = payload if number == 0 else ()
        blocks = _interior(_blocks(levels[number], *extra)).join(upper, ["tree", "block"])
        nodes = F.posexplode(_ways()).alias("at", "low")
        rows = blocks.select("tree", "rows", "path", nodes)
        row = F.col("rows")[F.col("at")]
        above = rows.select(
            "tree", row["pos"].alias("pos"), row["node"].alias("node"), *(row[p].alias(p) for p in extra), F.concat("low", "path").alias("path")
        )
    return above


def _ways() -> Column:
    """For each node of a block, the siblings left and right at each level inside the subtree."""
    places = F.sequence(F.lit(0), F.size("rows") - 1)

    def way(i: Column) -> Column:
        steps = []
        for k in range(STRIDE):
            nodes, at = F.col(f"level{k}"), F.floor(i / FAN**k).cast("int")
            run = F.floor(at / FAN).cast("int") * FAN
            left = F.array_join(F.slice(nodes, run + 1, at - run), "")
            right = F.array_join(F.slice(nodes, at + 2, run + FAN - 1 - at), "")
            # A small tree ends inside the subtree.
            steps.append(F.when(F.col("size") > FAN**k, F.struct(left.alias("left"), right.alias("right"))))
        return F.filter(F.array(*steps), lambda s: s.isNotNull())

    return F.transform(places, way)


# ---- manifest ----------------------------------------------------------------------------------


def write_manifest(docs: DataFrame, path: str, claimed_text: Column | None = None) -> None:
    """Write the trees of a table below `path`.

    `claimed_text` is a text that another copy of a row claims, null where it claims nothing; its leaf is kept beside the row's own.
    """
    level, sources = _leaves(docs, claimed_text)
    largest = sources.agg(F.max("size")).first()[0] or 1
    _, subroots = _levels(f"{path}/documents", level, largest)
    named = sources.join(subroots, "tree")
    n = named.count()
    top = named.select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("size"), F.col("tree").alias("pos"), F.col("root").alias("node"))
    _, root = _levels(f"{path}/sources", top, n or 1)
    named.write.parquet(f"{path}/subroots")
    root.select("root", F.lit(n).cast("long").alias("size")).write.parquet(f"{path}/root")


def _read_levels(spark: SparkSession, path: str, largest: int, lowest: str) -> list[DataFrame]:
    levels = [spark.read.schema(lowest).parquet(f"{path}/level=0")]
    while largest > SUBTREE:
        rows = spark.read.schema(NODE).parquet(f"{path}/level={len(levels)}").where(F.col("size") > SUBTREE)
        levels.append(rows.withColumn("size", F.ceil(F.col("size") / SUBTREE)))
        largest = -(-largest // SUBTREE)
    return levels


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, source's subroot, root, the path of siblings, and what the path makes of the claimed leaf, for every document.

    `path` lists (left, right) from the leaf to the root; `folded_root` starts from the claimed leaf, or the row's own where there is no claim.
    """
    kept = "tree long, source string, size long, root string"
    subroots = spark.read.schema(kept).parquet(f"{path}/subroots")
    root = spark.read.schema("root string, size long").parquet(f"{path}/root")
    facts = subroots.agg(F.max("size").alias("largest"), F.count(F.lit(1)).alias("n")).first()
    empty = F.array().cast("array<struct<left:string,right:string>>")
    whole = root.select(F.lit(0).cast("long").alias("tree"), "size", empty.alias("path"))
    above = _paths(_read_levels(spark, f"{path}/sources", facts.n, NODE), whole)
    trees = above.select(F.col("pos").alias("tree"), F.col("path")).join(subroots.drop("source"), "tree")
    doc_id = _doc_id_type(spark, path)
    lowest = StructType([*spark.createDataFrame([], NODE).schema, doc_id, *spark.createDataFrame([], "claim string").schema])
    found = _paths(_read_levels(spark, f"{path}/documents", facts.largest or 1, lowest), trees, "doc_id", "claim")
    top = root.first()
    found = found.join(subroots.select("tree", F.col("root").alias("subroot")), "tree").withColumn("root", F.lit(top and top.root).cast("string"))
    folded = F.aggregate("path", F.coalesce("claim", "node"), lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    found = found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "path", digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _doc_id_type(spark: SparkSession, path: str) -> StructField:
    """The ids keep their own type; an empty table's is not known and is long."""
    fields = {f.name: f for f in spark.read.parquet(f"{path}/documents/level=0").schema}
    return fields.get("doc_id", StructField("doc_id", LongType()))
