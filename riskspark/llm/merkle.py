"""Merkle manifest of a dataset, with proofs by checkpoint and recompute.

Rows become leaves. Leaves of one group, in order, are hashed in twos, level by level, to the group's subroot; the
subroots, in order of their groups, are hashed alike to one root. Of a tree's levels only every STRIDE-th is written.
What lies between is made twice and never stored: once on the way up, where an aligned subtree of 2^STRIDE nodes becomes
one stored node, and once when proofs are taken, where a subtree's inner levels are made again from its stored
descendants, each descendant's siblings are emitted, and the levels are dropped. A proof is what a node emits in its own
subtree followed by the proof of the stored node above.

Nothing is hashed in Python. A group is cut into subtrees of bounded size, however many rows it has; places in a group come
from a range partitioning, whose ranges are numbered by a small table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import pick, stored, with_row_id

STRIDE = 8  # levels from one stored level to the next: subtrees of 256 nodes
ROWS_PER_RANGE = 500_000  # at most; a smaller table is still dealt to the session's shuffle partitions
LEAST_RANGE_ROWS = 10_000
PROOF = "array<struct<left:boolean,digest:string>>"
_PLACE_BITS = 33  # monotonically_increasing_id: a partition's number above the place in it


def field(value: Column) -> Column:
    """How a field is hashed: `-` for null, else its length in UTF-8 bytes, `:`, and its text; numbers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def row_digest(fields: list[Column]) -> Column:
    return digest(*map(field, fields))


def group_key(group: Column) -> Column:
    """A key that is never null and orders as the group does: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (with a column `grp`), stored, with their `place` in their group by `order`, from 0, and the group's `size`.

    Rows are dealt to ranges of (grp, order), so a large group fills many ranges; the row number, last in the order, deals
    equal rows to several as well. A range's rows are sorted where they are written, and the only table that is put in
    sequence has a row per range and group.
    """
    number = rows.count()
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-number // ROWS_PER_RANGE), min(usual, -(-number // LEAST_RANGE_ROWS)))
    keys = ["grp", *order, "_row"]
    placed = with_row_id(rows, "_row").repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = stored(placed.drop("_row").withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_at", _PLACE_BITS))
    counts = placed.groupBy("grp", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy("grp")
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "grp", "_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_add"), F.sum("_rows").over(group).alias("size")
    )
    return placed.join(offsets, ["grp", "_range"]).withColumn("place", F.col("_at") + F.col("_add")).drop("_at", "_range", "_add")


def height(size: Column) -> Column:
    """Levels above the leaves: the least h with 2^h >= size."""
    return (F.char_length(F.bin(size - 1)) * (size > 1).cast("int")).cast("int")


def steps(size: Column, level: int, stride: int) -> Column:
    """Numbers 0, 1, ... of the levels made above a stored level, at most up to the group's top."""
    made = F.greatest(F.least(height(size) - level, F.lit(stride)), F.lit(0))
    return F.slice(F.array(*map(F.lit, range(stride))), F.lit(1), made)


def parents(nodes: Column) -> Column:
    """Twos of a level hashed; the last one alone if their number is odd."""
    return F.transform(
        F.filter(nodes, lambda x, i: i % 2 == 0), lambda x, i: digest(x, F.coalesce(F.get(nodes, 2 * i + 1), F.lit("")))
    )


@dataclass
class Tree:
    """Stored levels of the trees of all groups: grp, place, size (leaves of the group), digest. The last has only subroots."""

    levels: list[DataFrame]
    stride: int

    @property
    def subroots(self) -> DataFrame:
        return self.levels[-1].select("grp", "digest")


def _subtrees(nodes: DataFrame, stride: int, payload: list[str] = []) -> DataFrame:
    """grp, above (place of the stored node above), size and nodes (sorted) of every aligned subtree."""
    keyed = nodes.withColumn("above", F.shiftright("place", stride))
    return keyed.groupBy("grp", "above", "size").agg(F.sort_array(F.collect_list(F.struct("place", "digest", *payload))).alias("nodes"))


def build(leaves: DataFrame, stride: int = STRIDE, name: str = "merkle") -> Tree:
    """Trees over numbered leaves (grp, place, size, digest): every stride-th level is stored, up to the subroots."""
    levels = [leaves]
    most = leaves.agg(F.max(height(F.col("size")))).first()[0] or 0
    for level in range(0, most, stride):
        subtrees = _subtrees(levels[-1].select("grp", "place", "size", "digest"), stride)
        made = steps(F.col("size"), level, stride)
        top = F.aggregate(made, F.transform("nodes", lambda n: n["digest"]), lambda held, _: parents(held))
        # Where the group's top lies inside the subtree, one node is left all the same.
        levels.append(stored(subtrees.select("grp", F.col("above").alias("place"), "size", F.get(top, F.lit(0)).alias("digest")), name))
    return Tree(levels, stride)


def proofs(tree: Tree, payload: list[str]) -> DataFrame:
    """The leaves (grp, place, digest and the payload columns) with `proof`: siblings up to the subroot, lowest first.

    An entry says whether the sibling stands left; where a node is alone in its two, its digest is empty.
    """
    stride = tree.stride
    above = tree.levels[-1].select("grp", F.col("place").alias("above"), F.lit([]).cast(PROOF).alias("rest"))
    for number in range(len(tree.levels) - 2, -1, -1):
        own = payload if number == 0 else []
        subtrees = _subtrees(tree.levels[number], stride, own).join(above, ["grp", "above"])
        made = steps(F.col("size"), number * stride, stride)
        levels = F.aggregate(
            made,
            F.array(F.transform("nodes", lambda n: n["digest"])),
            lambda held, _: F.concat(held, F.array(parents(F.element_at(held, -1)))),
        )
        inner = subtrees.select("grp", "rest", "nodes", made.alias("made"), levels.alias("levels"))

        def siblings(i: Column) -> Column:
            def sibling(step: Column) -> Column:
                at = F.call_function("shiftright", i, step)
                return F.struct(
                    (at % 2 == 1).alias("left"),
                    F.coalesce(F.get(F.get(F.col("levels"), step), F.when(at % 2 == 1, at - 1).otherwise(at + 1)), F.lit("")).alias("digest"),
                )

            return F.concat(F.transform("made", sibling), F.col("rest"))

        proven = inner.select("grp", F.explode(F.transform("nodes", lambda n, i: F.struct(n.alias("n"), siblings(i).alias("proof")))).alias("e"))
        above = proven.select("grp", F.col("e.n.place").alias("above"), F.col("e.proof").alias("rest"), "e.n")
        if number:
            above = stored(above.drop("n"), "merkle-proofs")
        else:
            return above.select("grp", F.col("above").alias("place"), "n.digest", *[f"n.{c}" for c in own], F.col("rest").alias("proof"))
    leaves = tree.levels[0]
    return leaves.select("grp", "place", "digest", *payload, F.lit([]).cast(PROOF).alias("proof"))


def fold(leaf: Column, *proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    for part in proof:
        leaf = F.aggregate(
            part, leaf, lambda held, s: F.when(s["left"], digest(s["digest"], held)).otherwise(digest(held, s["digest"]))
        )
    return leaf


def proof_digest(*proof: Column) -> Column:
    """Digest of the siblings of a proof from leaf to root; absent ones add nothing."""
    return digest(*[F.array_join(F.transform(part, lambda s: s["digest"]), "") for part in proof])


def manifest(
    rows: DataFrame,
    id_column: str = "doc_id",
    group_column: str = "lang",
    fields: list[str] | None = None,
    claimed: dict[str, Column] | None = None,
    stride: int = STRIDE,
) -> DataFrame:
    """doc_id, grp, leaf, subroot, root, proof (in the group), top_proof (of the subroot) of every row, and for each name
    in `claimed` the leaf of that row digest, to be checked against the proof.

    `fields` are the columns hashed to a leaf, in order; a leaf digest in `claimed` is made of columns named f0, f1, ...
    after them. Null fields hash as `-`. Leaves of a group ascend by id (null first), rows of one id by their digest;
    equal rows are leaves of their own with equal digests. A null group is the first. An empty table gives no rows. Extra
    columns are left out and may have any names. `rows` may come from any plan: they are numbered once they are stored.
    """
    fields = fields or [id_column, group_column]
    names = {f"f{i}": column for i, column in enumerate(fields)}
    plain = pick(rows, doc_id=id_column, grp_value=group_column, **names)
    claims = claimed or {}
    leaves = plain.select(
        group_key(F.col("grp_value")).alias("grp"),
        "doc_id",
        row_digest([F.col(n) for n in names]).alias("digest"),
        *[made.alias(name) for name, made in claims.items()],
    )
    tree = build(numbered(leaves, ["doc_id", "digest"], "merkle-leaves"), stride)
    tops = tree.subroots.withColumnRenamed("grp", "key").withColumn("grp", F.lit(""))
    top_tree = build(numbered(tops, ["key"], "merkle-subroots"), stride)
    root = top_tree.subroots.select(F.col("digest").alias("root"))
    top_proofs = proofs(top_tree, ["key"]).select(F.col("key").alias("grp"), F.col("digest").alias("subroot"), F.col("proof").alias("top_proof"))
    proven = proofs(tree, ["doc_id", *claims]).withColumnRenamed("digest", "leaf")
    return proven.join(top_proofs, "grp").withColumn("root", root.scalar()).drop("place")
