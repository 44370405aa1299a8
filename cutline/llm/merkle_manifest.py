"""A Merkle tree over the rows of a table, by source: what a row's proof is made of, and whether a row still fits the root.

A level of a tree is a DataFrame: nodes are numbered within their group, their numbers divided by the
fanout give their parents, and a parent's hash is that of its children's in order. The proofs go down
again by a join at every level, each of the size of that level: a parent hands its own proof to its
children, and each of them puts the hashes of its siblings before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.operators.positions import positions

from .common import cut, small

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 (hex) of the values one after the other: `-` if null, else the number of UTF-8 bytes, a colon, the value."""

    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(told, values)), 256)


def numbered(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The leaves, stored, with `ix` (place within their group, in the given order) and `n` (leaves of the group); groups must not be null.

    Places within groups come from places in the whole table, so that a group of any size is dealt over many tasks.
    """
    placed = positions(leaves, [group, *order], "place")
    sizes = positions(placed.groupBy(group).agg(F.count("*").alias("n")), [group], "before", weight="n")
    return cut(placed.join(small(sizes, sizes.count()), group).withColumn("ix", F.col("place") - F.col("before")).drop("place", "before"))


def tree(leaves: DataFrame, group: str, fanout: int) -> list[DataFrame]:
    """The levels above the leaves (group, ix, n, hash), each stored: (group, ix, n, hash, children) of the parents at that level, n of them in the group.

    A group's last level has one node of it; a group of one leaf has none. Runs of children may be short at the end, even of one.
    """
    levels = []
    below = leaves.select(group, "ix", "n", "hash").where("n > 1")
    while below.take(1):
        runs = below.groupBy(group, F.expr(f"ix div {fanout}").alias("ix"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")).agg(F.array_sort(F.collect_list(F.struct("ix", "hash"))).alias("run"))
        children = F.transform("run", lambda c: c["hash"])
        levels.append(cut(runs.withColumn("children", children).withColumn("hash", F.sha2(F.array_join("children", ""), 256)).select(group, "ix", "n", "hash", "children")))
        below = levels[-1].drop("children").where("n > 1")
    return levels


def tops(leaves: DataFrame, levels: list[DataFrame], group: str) -> DataFrame:
    """(group, hash): the one node that remains of each group."""
    found = leaves.where("n = 1").select(group, "hash")
    for level in levels:
        found = found.unionByName(level.where("n = 1").select(group, "hash"))
    return found


def proofs(levels: list[DataFrame], group: str, fanout: int, above: DataFrame, lone: DataFrame) -> DataFrame:
    """(group, ix, proof, carried columns) of every leaf, given `above` (group, proof, columns to carry) for each group's last node.

    A proof is a list of steps from the leaf up: the hashes of the siblings on the left and on the right,
    each joined to one text. lone: the leaves (group, ...) of groups of one.
    """
    carried = [c for c in above.columns if c not in (group, "proof")]
    alone = lone.select(group).join(above, group).select(group, F.lit(0).cast("long").alias("ix"), "proof", *carried)
    found = None
    for level in reversed(levels):
        top = level.where("n = 1").select(group, "ix", "children").join(above, group)
        parents = top if found is None else top.unionByName(level.where("n > 1").select(group, "ix", "children").join(found, [group, "ix"]))
        side = lambda a, n: F.array_join(F.slice("children", a, n), "")
        made = parents.select(group, F.col("ix").alias("up"), "children", "proof", *carried, F.posexplode("children").alias("at", "_hash"))
        step = F.struct(side(F.lit(1), F.col("at")).alias("left"), side(F.col("at") + 2, F.lit(fanout)).alias("right"))
        found = made.select(group, (F.col("up") * fanout + F.col("at")).alias("ix"), F.concat(F.array(step), "proof").alias("proof"), *carried)
    return alone if found is None else found.unionByName(alone)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = 3, fields: tuple[str, ...] = FIELDS, id: str = "doc_id", group: str = "source") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Leaves are hashes of `fields`; those of a group, ordered by id, make a tree with a subroot, and the
    subroots, ordered by group (null first, else by bytes), one with the root. `tampered` is the text as
    it is found later (default: unchanged); folded_root follows from the leaf made with it and the
    original proof, and verified says whether that is the root.

    A null id comes first in its group; rows of one id are told apart by their leaves, and equal rows are
    leaves of their own. Null and empty texts have different leaves. Texts are read once and only their
    hashes are kept; a very long text is hashed like any other. No rows give no rows. Other columns take no part.
    """
    if fanout < 2:
        raise ValueError("a parent has 2 children or more")
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    text = fields[-1]
    changed = [tampered if f == text and tampered is not None else F.col(f) for f in fields]
    rows = cut(docs.select(F.col(id).alias("id"), key.alias("group"), leaf_hash([F.col(f) for f in fields]).alias("hash"), leaf_hash(changed).alias("found")))
    leaves = numbered(rows, "group", ["id", "hash"])
    levels = tree(leaves, "group", fanout)
    subroots = cut(tops(leaves, levels, "group"))
    heads = numbered(subroots.withColumn("all", F.lit(0)).withColumn("key", F.col("group")).drop("group"), "all", ["key"])
    upper = tree(heads, "all", fanout)
    root = tops(heads, upper, "all").first()
    if root is None:
        root = (None, None)
    first = heads.select("all").distinct().withColumn("proof", F.array().cast(STEPS))
    of_heads = proofs(upper, "all", fanout, first, heads.where("n = 1"))
    above = cut(heads.join(of_heads, ["all", "ix"]).select(F.col("key").alias("group"), "proof", F.col("hash").alias("subroot")))
    below = proofs(levels, "group", fanout, small(above, above.count()), leaves.where("n = 1"))
    rows = leaves.join(below, ["group", "ix"])
    joined = F.array_join(F.flatten(F.transform("proof", lambda s: F.array(s["left"], s["right"]))), "")
    rows = rows.select(F.col("id").alias(id), F.col("hash").alias("leaf"), "subroot", F.lit(root[1]).alias("root"), F.sha2(joined, 256).alias("proof_sha256"), folded(F.col("found"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
