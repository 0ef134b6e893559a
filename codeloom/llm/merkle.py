"""Merkle manifest of a table: a digest per row, a subroot per source, one root, and a proof per row.

The rows of a source, in order, are the leaves of a tree in which every
``ARITY`` consecutive nodes, fewer in the last run, have one parent. Superblocks of
``ARITY**HEIGHT`` consecutive nodes are whole subtrees. Upwards, each superblock is reduced to
its top node, and these nodes are the leaves of the next layer, until a source has one
node; the subroots are reduced in the same way. Downwards, a superblock meets
the nodes outside that its rows need: both are cogrouped, and one task finishes
the local reduction, joins the proofs and folds the claimed leaves. A group holds
``ARITY**HEIGHT`` rows at most, whatever the size of a source.

Fields that are NULL have a digest of their own. Leaves of one source are ordered by
doc_id, NULL first, then by digest, so rows that tie are alike in all that is
digested; repeated rows are leaves each. A NULL source comes first. A lone leaf is its
own subroot, with an empty proof there. Very long texts are digested in the JVM and
never shuffled. An empty table gives an empty one. Columns beyond the digested fields are
not carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.tables import saved

ARITY = 3
HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<before:string,after:string>>"
_OUTER = f"grp bigint, block bigint, subroot string, steps {_STEPS}"
_SHIFT = 33  # monotonically_increasing_id has the partition above this bit


def digest(fields: Sequence[Column]) -> Column:
    """sha256 in lowercase hex over the fields: ``-`` if NULL, else byte count, ``:``, value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, claimed_text: Column) -> DataFrame:
    """doc_id, source, leaf, and claimed: the leaf of the row with ``claimed_text`` for its text."""
    fields = [F.col(name) for name in FIELDS]
    return docs.select("doc_id", "source", digest(fields).alias("leaf"), digest([*fields[:-1], claimed_text]).alias("claimed"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _up(nodes: Sequence[str]) -> list[str]:
    return [_sha("".join(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]


def _reduced(nodes: Sequence[str], total: int, height: int) -> list[list[str]]:
    """The levels of a superblock: to one node, or to full height if its group has more superblocks."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1 or (total > ARITY**height and len(levels) <= height):
        levels.append(_up(levels[-1]))
    return levels


def _proofs(levels: list[list[str]]) -> Iterator[list[tuple[str, str]]]:
    """For each bottom node the siblings before and after it, level by level."""
    for at in range(len(levels[0])):
        steps = []
        for nodes in levels[:-1]:
            first = at - at % ARITY
            steps.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + ARITY])))
            at //= ARITY
        yield steps


def _dicts(steps: Sequence[tuple[str, str]]) -> list[dict]:
    return [{"before": a, "after": b} for a, b in steps]


def _pairs(outer: pd.DataFrame) -> list[tuple[str, str]]:
    return [(s["before"], s["after"]) for s in outer["steps"].iloc[0]]


def _top(height: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The top node of a superblock."""

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        total = int(nodes["total"].iloc[0])
        top = _reduced(nodes["node"], total, height)[-1]
        return pd.DataFrame({"grp": nodes["grp"].iloc[:1], "pos": nodes["block"].iloc[:1], "node": top, "total": -(-total // ARITY**height)})

    return run


def _descend(height: int, to_subroots: bool = False) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The outer nodes of every node of a superblock: its own steps, then those of the superblock.

    Above the sources what comes out of the lowest layer are subroots.
    """

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty:
            return pd.DataFrame(columns=["grp", "block", "subroot", "steps"], dtype=object)
        nodes = nodes.sort_values("pos")
        above = _pairs(outer)
        steps = [_dicts(own + above) for own in _proofs(_reduced(nodes["node"], int(nodes["total"].iloc[0]), height))]
        return pd.DataFrame({"grp": nodes["grp"], "block": nodes["pos"], "subroot": nodes["node"] if to_subroots else outer["subroot"].iloc[0], "steps": steps})

    return run


def _finish(height: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Local reduction, proofs and folds of the leaves of a superblock."""

    def run(leaves_: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves_ = leaves_.sort_values("pos")
        above = _pairs(outer)
        proofs, folded = [], []
        for node, own in zip(leaves_["claimed"], _proofs(_reduced(leaves_["node"], int(leaves_["total"].iloc[0]), height))):
            steps = own + above
            for before, after in steps:
                node = _sha(before + node + after)
            proofs.append(_dicts(steps))
            folded.append(node)
        return pd.DataFrame({"doc_id": leaves_["doc_id"], "source": leaves_["source"], "leaf": leaves_["node"], "subroot": outer["subroot"].iloc[0], "proof": proofs, "folded_root": folded})

    return run


def _numbered(table: DataFrame, group: Sequence[str], order: Sequence[str], purpose: str) -> DataFrame:
    """Rows with pos, their 0-based place in their group by ``order``, and total, the group's size.

    A sort by ranges; what is counted by windows is one row per range and group.
    ``order`` must be total and start with ``group``.
    """
    parts = table.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranges = table.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    ranges = saved(ranges.withColumn("_n", F.monotonically_increasing_id()), purpose)
    part = F.shiftright("_n", _SHIFT).alias("_part")
    counts = ranges.groupBy(*group, part).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_count"))
    by_group = Window.partitionBy(*group)
    places = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_of"), "_first",
        (F.sum("_count").over(by_group.orderBy("_part")) - F.col("_count")).alias("_before"), F.sum("_count").over(by_group).alias("total"),
    )
    same = part.eqNullSafe(F.col("_of"))
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    found = ranges.join(places, same)
    return found.select(*table.columns, (F.col("_n") - F.col("_first") + F.col("_before")).alias("pos"), "total")


def _met(nodes: DataFrame, outer: DataFrame):
    return nodes.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block"))


def _block(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**height).cast("bigint"))


def _layers(nodes: DataFrame, height: int, purpose: str) -> list[DataFrame]:
    """Layers of (grp, pos, node, total, block), the last with one node per group."""
    layers = [_block(nodes, height)]
    biggest = nodes.agg(F.max("total")).first()[0] or 0
    while biggest > 1:
        up = layers[-1].groupBy("grp", "block").applyInPandas(_top(height), "grp bigint, pos bigint, node string, total bigint")
        layers.append(_block(saved(up, purpose), height))
        biggest = -(-biggest // ARITY**height)
    return layers


def manifest(table: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof, folded_root, verified of a table as ``leaves`` makes it.

    ``proof`` holds, from the leaf to the root, what to put before and after a
    digest before it is digested again. ``folded_root`` is what the claimed leaf and
    the proof of the original come to; ``verified`` says whether that is the root.
    """
    spark = table.sparkSession
    # A row number, stored, breaks ties the same way whenever a task is run again.
    table = saved(table.withColumn("_id", F.monotonically_increasing_id()), "merkle-leaves")
    placed = _numbered(table, ["source"], ["source", "doc_id", "leaf", "_id"], "merkle-ranges")
    sources = placed.filter("pos = 0").select("source", F.lit(0).alias("_all"))
    sources = saved(_numbered(sources, ["_all"], ["_all", "source"], "merkle-sources"), "merkle-source-numbers")
    number = sources.select(F.col("source").alias("_s"), F.col("pos").cast("bigint").alias("grp"))
    placed = placed.join(number, F.col("source").eqNullSafe(F.col("_s"))).select("grp", "pos", "total", F.col("leaf").alias("node"), "claimed", F.col("doc_id").cast("string").alias("doc_id"), "source")
    placed = saved(_block(placed, height), "merkle-placed")

    within = _layers(placed.select("grp", "pos", "node", "total"), height, "merkle-nodes")
    tops = within[-1].select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("pos"), "node", F.lit(sources.count()).cast("bigint").alias("total"))
    across = _layers(tops, height, "merkle-subroots")
    last = across[-1].first()
    root = last["node"] if last else None

    outer = spark.createDataFrame([(0, 0, None, [])], _OUTER)
    for layer in reversed(across[:-1] or across):
        outer = saved(_met(layer, outer).applyInPandas(_descend(height, to_subroots=True), _OUTER), "merkle-outer")
    # A node of the upper tree is a source, that is the only superblock of the source's last layer.
    outer = outer.select(F.col("block").alias("grp"), F.lit(0).cast("bigint").alias("block"), "subroot", "steps")
    for layer in reversed(within[1:-1]):
        outer = saved(_met(layer, outer).applyInPandas(_descend(height), _OUTER), "merkle-outer")
    done = _met(placed, outer).applyInPandas(_finish(height), f"doc_id string, source string, leaf string, subroot string, proof {_STEPS}, folded_root string")
    top = F.lit(root).cast("string")
    return done.select(
        F.col("doc_id").cast(table.schema["doc_id"].dataType).alias("doc_id"), "source", "leaf", "subroot", top.alias("root"),
        "proof", "folded_root", (F.col("folded_root") == top).alias("verified"),
    )
