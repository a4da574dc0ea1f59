"""A Merkle manifest of a table: a tree of SHA-256 digests per language, their roots in a tree of their own, and a proof for every row.

Leaves are digested by column functions and numbered inside their group by range. Blocks of FAN**HEIGHT neighbours are then folded, block
by block, until each group is one digest: no task holds more than a block. On the way down a task rebuilds its block's parents. A parent
is hashed child by child and retains a copy of the hash state before each slot; a changed child is folded by resuming the state of its slot
with the replacement and the siblings to its right, so the siblings to its left are never hashed again. The same holds above the block:
the block brings one run of digests for each level over it, whose states are made once and resumed by every row.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.llm.ordered import numbered
from countersign.llm.text import mapped
from countersign.session import checkpointed

FAN = 8  # children of a parent
HEIGHT = 4  # levels that one task folds: blocks of 4,096 nodes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Parent:
    """A run of children: its digest, and the hash state before each child."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: list[str]):
        state, self.children, self.states = sha256(), children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, replacement: str) -> str:
        """The digest with another child in one slot."""
        state = self.states[slot].copy()
        state.update("".join([replacement, *self.children[slot + 1 :]]).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> str:
        return "".join(self.children[:slot] + self.children[slot + 1 :])


def levels(digests: list[str], height: int) -> list[list[Parent]]:
    """Parents over a block, bottom level first; none over a single digest at the top of its tree."""
    out: list[list[Parent]] = []
    for _ in range(height):
        out.append([Parent(digests[i : i + FAN]) for i in range(0, len(digests), FAN)])
        digests = [p.digest for p in out[-1]]
    return out


def height_of(n: int, most: int | None = None) -> int:
    """Levels over n nodes, up to `most`."""
    height = 0
    while n > 1 and height != most:
        n, height = -(-n // FAN), height + 1
    return height


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon, and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256, in lower-case hexadecimal, of the fields of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """Nodes sorted block by block; a row of a negative `pos`, -1 less the number of the block, may lead it."""
    block = F.expr(f"if(pos < 0, -1 - pos, pos div {FAN**height})")
    keyed = nodes.withColumn("block", block)
    return keyed.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("pos") >= 0, "pos")


def _runs(batches: Iterator[dict], names: list[str]) -> Iterator[tuple[str, int, list[tuple]]]:
    """Whole blocks of a sorted partition."""
    key, rows = None, []
    for b in batches:
        for tree, block, *row in zip(b["tree"], b["block"], *(b[n] for n in names)):
            if key != (tree, block):
                if rows:
                    yield *key, rows
                key, rows = (tree, block), []
            rows.append(row)
    if rows:
        yield *key, rows


def _many(rows: Iterator[tuple], names: tuple[str, ...], size: int = 500) -> Iterator[dict]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield dict(zip(names, map(list, zip(*held))))
            held = []
    if held:
        yield dict(zip(names, map(list, zip(*held))))


NODE = "tree string, pos long, n long, digest string"
PATH = "tree string, pos long, levels array<array<string>>"


def ascended(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes, then the roots of their blocks, and so on until every tree is one node. `nodes`: tree, pos, n (of the tree), digest."""
    out = [nodes]
    while not out[-1].where("n > 1").isEmpty():

        def fold(batches: Iterator[dict]) -> Iterator[dict]:
            def roots() -> Iterator[tuple]:
                for tree, block, rows in _runs(batches, ["n", "digest"]):
                    n, digests = rows[0][0], [r[1] for r in rows]
                    top = levels(digests, height_of(n, height))
                    yield tree, block, -(-n // FAN**height), top[-1][0].digest if top else digests[0]

            yield from _many(roots(), ("tree", "pos", "n", "digest"))

        out.append(checkpointed(mapped(_blocks(out[-1].select("tree", "pos", "n", "digest"), height), fold, NODE)))
    return out


def _paths_down(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """The path of every node: per level the run it stands in and, first, its slot there. `above`: paths of the blocks."""
    led = nodes.select("tree", "pos", "n", "digest", F.lit(None).cast("array<array<string>>").alias("levels")).unionByName(
        above.select("tree", (-1 - F.col("pos")).alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), "levels")
    )

    def descend(batches: Iterator[dict]) -> Iterator[dict]:
        def paths() -> Iterator[tuple]:
            for tree, _, rows in _runs(batches, ["pos", "n", "digest", "levels"]):
                over, rows = rows[0][3], rows[1:]
                parents = levels([r[2] for r in rows], height_of(rows[0][1], height)) if rows else []
                for i, row in enumerate(rows):
                    own = [[str(i // FAN**k % FAN), *level[i // FAN ** (k + 1)].children] for k, level in enumerate(parents)]
                    yield tree, row[0], own + over

        yield from _many(paths(), ("tree", "pos", "levels"))

    return checkpointed(mapped(_blocks(led, height), descend, PATH))


def merkle_manifest(rows: DataFrame, columns: list[str], *, id_col: str = "doc_id", group_col: str = "lang", changed: Column | None = None, changes: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """`doc_id, group, leaf, subroot, root, proof_sha256, folded_root, verified` of every row.

    Leaves digest `columns` in that order and ascend by id inside a group (ids null first, equal ids by their digests); a group is folded by
    eights to its subroot, and the subroots, null group first, then by bytes, to the root. `proof_sha256` digests all siblings on the way
    up. Where `changed` holds, the row is folded as if `changes` had replaced columns (by default not at all): `verified` says whether
    that still gives the root. A task folds `height` levels. A null or empty field, a very long text and a row without an id are digested like any other value; repeated
    rows are leaves of their own; no rows give an empty result. Columns that are not named are not read.
    """
    group = F.col(group_col).cast("string")
    # Null sorts before every value: a prefix keeps that, and lets null be a key of joins.
    keyed = rows.withColumn("_tree", F.when(group.isNull(), "n").otherwise(F.concat(F.lit("v"), group)))
    changes = changes or {}
    leaf = leaf_digest([F.col(c) for c in columns])
    use = F.lit(False) if changed is None else F.coalesce(changed, F.lit(False))
    other = leaf_digest([changes.get(c, F.col(c)) for c in columns])
    leaves = checkpointed(keyed.select(F.col("_tree").alias("tree"), F.col(id_col).cast("long").alias("doc_id"), leaf.alias("digest"), F.when(use, other).alias("other")))
    placed = checkpointed(numbered(leaves, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")]).withColumnRenamed("group_n", "n"))
    trees = ascended(placed, height)
    # The subroots in order are the leaves of one more tree.
    subroots = trees[-1].select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest")
    tops = checkpointed(numbered(subroots, "all", [F.col("name")]).select(F.col("all").alias("tree"), "pos", F.col("group_n").alias("n"), "digest", "name"))
    over = ascended(tops, height)
    paths = over[-1].select("tree", "pos", F.array().cast("array<array<string>>").alias("levels"))
    for nodes in reversed(over[:-1]):
        paths = _paths_down(nodes, paths, height)
    paths = tops.select(F.col("name"), "pos").join(paths.select("pos", "levels"), "pos").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "levels")
    for nodes in reversed(trees[1:-1]):
        paths = _paths_down(nodes, paths, height)
    return _folded(placed, paths, height)


RESULT = "doc_id long, tree string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _folded(leaves: DataFrame, above: DataFrame, height: int) -> DataFrame:
    led = leaves.select("tree", "pos", "n", "doc_id", "digest", "other", F.lit(None).cast("array<array<string>>").alias("levels")).unionByName(
        above.select("tree", (-1 - F.col("pos")).alias("pos"), *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("doc_id", "long"), ("digest", "string"), ("other", "string"))], "levels")
    )

    def descend(batches: Iterator[dict]) -> Iterator[dict]:
        def results() -> Iterator[tuple]:
            for tree, _, (head, *rows) in _runs(batches, ["n", "doc_id", "digest", "other", "levels"]):
                parents = levels([r[2] for r in rows], height_of(rows[0][0], height)) if rows else []
                over = [(int(slot), Parent(run)) for slot, *run in head[4]]
                # Levels up to the subroot come first; the tree's own height says how many.
                ends = parents[-1][0].digest if parents else rows[0][2]
                upper = "".join(p.siblings(slot) for slot, p in over).encode()
                tops = [ends, *(p.digest for _, p in over)]
                own = height_of(rows[0][0]) - len(parents)
                subroot, root = tops[own], tops[-1]
                for i, (_, doc_id, leaf, other, _) in enumerate(rows):
                    proof, folded = sha256(), leaf if other is None else other
                    for k, level in enumerate(parents):
                        at, slot = divmod(i // FAN**k, FAN)
                        proof.update(level[at].siblings(slot).encode())
                        folded = level[at].folded(slot, folded)
                    proof.update(upper)
                    for slot, p in over:
                        folded = p.folded(slot, folded)
                    yield doc_id, tree, leaf, subroot, root, proof.hexdigest(), folded, folded == root

        yield from _many(results(), ("doc_id", "tree", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))

    return mapped(_blocks(led, height), descend, RESULT).withColumn("group", F.when(F.col("tree") != "n", F.expr("substr(tree, 2)"))).drop("tree")


def manifest_sql(columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), most: int = 9, most_groups: int = 4) -> str:
    """The same as SQL, for up to FAN**most leaves in a language and FAN**most_groups languages."""

    def fields(text: str) -> str:
        value = {c: f"cast({c} as varchar)" for c in columns} | {"text": text}
        return "sha256(" + " || ".join(f"case when {c} is null then '-' else strlen({value[c]}) || ':' || {value[c]} end" for c in columns) + ")"

    crc = (
        "xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(length(cast(doc_id as varchar))), lambda i: cast(ord(cast(doc_id as varchar)[i + 1]) as bigint))), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), cast([0,0,0,0,0,0,0,0] as bigint[])), lambda s, z: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end)), 4294967295)"
    )
    parts = [
        f"with d as (select *, case when doc_id is not null and ({crc}) % 3 = 0 then translate(text, '{UPPER}', '{LOWER}') else text end as other from documents)",
        f"l as (select doc_id, case when lang is null then 'n' else 'v' || lang end as tree, {fields('text')} as leaf, {fields('other')} as tampered from d)",
        "n0 as (select doc_id, tree, leaf, tampered, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n, leaf as digest from l)",
    ]

    def up(name: str, levels_: int, top: str) -> None:
        # A tree that is one node already keeps its digest.
        for k in range(1, levels_ + 1):
            parts.append(
                f"{name}{k} as (select tree, pos // {FAN} as pos, (any_value(n) + {FAN - 1}) // {FAN} as n, any_value(n) > 1 as hashed, list(digest order by pos) as kids, "
                f"case when any_value(n) > 1 then sha256(string_agg(digest, '' order by pos)) else any_value(digest) end as digest from {name}{k - 1} group by tree, pos // {FAN})"
            )
        parts.append(f"{top} as (select tree, digest from {name}{levels_})")

    up("n", most, "sub")
    parts.append("r0 as (select '' as tree, tree as name, row_number() over (order by tree) - 1 as pos, count(*) over () as n, digest from sub)")
    up("r", most_groups, "top")
    parts.append("f0 as (select doc_id, tree, leaf, pos, tampered as now, '' as proof from n0)")

    def fold(source: str, target: str, parents: str, on_tree: str, k: int) -> None:
        slot = f"f.pos // {FAN ** (k - 1)} % {FAN}"
        keep = f"array_to_string(list_concat(p.kids[1 : {slot}], p.kids[{slot} + 2 :]), '')"
        swap = f"sha256(array_to_string(list_concat(list_append(p.kids[1 : {slot}], f.now), p.kids[{slot} + 2 :]), ''))"
        parts.append(
            f"{target} as (select f.* replace (case when p.hashed then {swap} else f.now end as now, case when p.hashed then f.proof || {keep} else f.proof end as proof) "
            f"from {source} f join {parents}{k} p on p.tree = {on_tree} and p.pos = f.pos // {FAN**k})"
        )

    for k in range(1, most + 1):
        fold(f"f{k - 1}", f"f{k}", "n", "f.tree", k)
    parts.append(f"g0 as (select f.* replace (r0.pos as pos), sub.digest as subroot from f{most} f join r0 on r0.name = f.tree join sub on sub.tree = f.tree)")
    for k in range(1, most_groups + 1):
        fold(f"g{k - 1}", f"g{k}", "r", "''", k)
    return ",\n".join(parts) + (
        f"\nselect doc_id, leaf, subroot, top.digest as root, sha256(proof) as proof_sha256, now as folded_root, now = top.digest as verified from g{most_groups} cross join top"
    )
