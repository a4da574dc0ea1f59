"""Prefix trie of conversations, rolled up by centroid decomposition.

A turn has a hash of its place, role and text; the exclusive-or of a conversation's first d of them names its depth-d node, so prefixes come
from window sums over blocks of turns, however long a conversation is. A node is called by its smallest member and its depth: the smallest
member of a prefix is also the smallest member of the longer prefixes it goes on with, so every conversation owns one unbroken chain of nodes, and the chain
hangs from a node of another conversation. That is the parent-edge forest.

The rollup splits it at centroids. Nodes weigh as many as have them as a prefix, hence the weight of a subtree is a plain sum over its
members, known before any rollup. In every component the deepest node with at least half of the weight is the centroid: what hangs from
it falls apart into components of less than half, and so does the rest. The total of the centroid's part is its result as far as the
component goes, and is added to every node on the path from the centroid to the component's top. Rounds run on tables until components are small, then
tasks finish many small components at once. Each round halves the weight of the heaviest component, so rounds grow with the logarithm of
the turns and a node takes part in each round once.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countersign.llm.ordered import numbered
from countersign.llm.text import mapped
from countersign.session import checkpointed

SMALL = 1024  # weight up to which a component is finished in a task; it has no more nodes than that
GATHERED = 16384  # nodes of small components that a task takes apart together
BLOCK = 4096  # turns whose hashes are summed in one window
PIECE = 1 << 16  # characters of an id list that are hashed at a time
WORDS = r"[^\x20\x09-\x0D]+"
TREE = ("rep", "depth", "start", "up", "parent", "weight", "leaf", "tokens")


def read_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv, pos, n` (turns of the conversation), `t1, t2` (hashes of role and text), `words`; conversations by turn, null turns first.

    Null roles and texts are empty. Turns of one number stand by the first 32 characters of the role, the first 64 of the text, then by
    hash. Very long texts are hashed and counted whole, repeated rows are turns of their own. Rows without a conversation belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.substring(role, 1, 32).alias("r"),
        F.substring(text, 1, 64).alias("t"),
        F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), text, role).alias("t2"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), *map(F.col, ("r", "t", "t1", "t2"))]
    return numbered(checkpointed(rows), "conv", order).select("conv", "pos", F.col("group_n").alias("n"), "t1", "t2", "words")


def spliced(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuild every conversation c: the first h turns of conversation c - c % family, then its own from its h-th on; h is crc32(c) % most.

    Returns the turns and, a row for every conversation, `conv, n` with its new length (0 where nothing is left).
    """
    turns = checkpointed(turns)
    convs = turns.where("pos = 0").select("conv", F.col("n").alias("own")).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    convs = convs.withColumn("donor", F.col("conv") - F.col("conv") % family)
    donors = convs.where(f"conv % {family} = 0").select(F.col("conv").alias("donor"), F.col("own").alias("given"))
    convs = convs.join(donors, "donor", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    convs = checkpointed(convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    heads = turns.where(f"pos < {most - 1} and conv % {family} = 0").select(F.col("conv").alias("donor"), "pos", "t1", "t2", "words")
    first = convs.where("taken > 0").select("conv", "donor", "n", "taken").join(heads, "donor").where("pos < taken")
    rest = turns.drop("n").join(convs.select("conv", "h", "taken", "n"), "conv").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv", "pos", "n", "t1", "t2", "words"]
    return first.select(*columns).unionByName(rest.select(*columns)), convs.select("conv", "n")


def _prefixes(turns: DataFrame) -> DataFrame:
    """`conv, n, depth, a, b` of every prefix, `pa, pb` of the one before it, and the words of its last turn."""
    rows = checkpointed(turns.select("conv", "n", (F.col("pos") + 1).alias("depth"), F.expr(f"pos div {BLOCK}").alias("block"), F.xxhash64(F.lit(3), "pos", "t1", "t2").alias("f"), F.xxhash64(F.lit(4), "pos", "t2", "t1").alias("g"), "words"))
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("a", F.bit_xor("f").over(inside)).withColumn("b", F.bit_xor("g").over(inside))
    # Only conversations longer than a block have blocks before one.
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.where(f"n > {BLOCK}").groupBy("conv", "block").agg(F.bit_xor("f").alias("f"), F.bit_xor("g").alias("g"))
    sums = sums.select("conv", "block", F.bit_xor("f").over(before).alias("a0"), F.bit_xor("g").over(before).alias("b0"))
    whole = local.where(f"n <= {BLOCK}").withColumn("a0", F.lit(0).cast("long")).withColumn("b0", F.lit(0).cast("long"))
    whole = whole.unionByName(local.where(f"n > {BLOCK}").join(sums, ["conv", "block"]))
    a, b = (F.col(c).bitwiseXOR(F.coalesce(F.col(f"{c}0"), F.lit(0))) for c in "ab")
    return whole.select("conv", "n", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("f")).alias("pa"), b.bitwiseXOR(F.col("g")).alias("pb"), "words")


def _forest(members: DataFrame, convs: DataFrame, top: int) -> DataFrame:
    """Nodes with their owner `rep`, the depth `start` at which its chain begins, and the owner `up` of the node that chain hangs from."""
    nodes = members.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.sum(F.col("n") - F.col("depth") + 1).alias("weight"),
        F.min("words").alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.sum(F.col("n") + 1).alias("weight")).select(
        *[zero.alias(c) for c in ("depth", "a", "b", "words", "pa", "pb")], F.lit(top).cast("long").alias("rep"), "n_convs", "weight"
    )
    nodes = checkpointed(nodes.unionByName(root))
    chains = nodes.groupBy("rep").agg(F.min("depth").alias("start"), F.min_by(F.struct("pa", "pb"), "depth").alias("hook"))
    # Chains that hang from the root need no look-up, and they are most of them.
    hung = chains.where("start > 1").join(
        nodes.select((F.col("depth") + 1).alias("start"), F.struct(F.col("a").alias("pa"), F.col("b").alias("pb")).alias("hook"), F.col("rep").alias("up")), ["start", "hook"]
    )
    chains = hung.select("rep", "start", "up").unionByName(chains.where("start <= 1").select("rep", "start", F.when(F.col("start") == 1, top).cast("long").alias("up")))
    tree = checkpointed(nodes.join(chains, "rep").withColumn("parent", F.when(F.col("depth") > F.col("start"), F.col("rep")).otherwise(F.col("up"))))
    kids = tree.where("depth > 0").groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = tree.join(kids, ["rep", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    return checkpointed(
        tree.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("tokens", (F.col("n_convs") - 1) * F.col("words")).drop("pa", "pb", "words")
    )


def _lineage(members: DataFrame, tree: DataFrame, top: int) -> DataFrame:
    """`conv, at, owner, over`: owner of the node, and of its parent, at each depth above the chain of a conversation."""
    chains = tree.where("depth = start and start > 0").select(F.col("rep").alias("conv"), "start")
    above = members.select("conv", "depth", "a", "b").join(chains, "conv").where("depth < start")
    named = above.join(tree.select("depth", "a", "b", F.col("rep").alias("owner"), F.col("parent").alias("over")), ["depth", "a", "b"])
    roots = chains.select("conv", F.lit(0).cast("long").alias("at"), F.lit(top).cast("long").alias("owner"), F.lit(None).cast("long").alias("over"))
    return checkpointed(named.select("conv", F.col("depth").alias("at"), "owner", "over").unionByName(roots))


def centroid_rollup(tree: DataFrame, lineage, small: int = SMALL) -> DataFrame:
    """`rep, depth, n_leaves, saved_tokens`: sums of `leaf` and `tokens` over the subtree of each node of one tree (columns `TREE`).

    `lineage()` gives the table that `_lineage` describes; it is asked for only if a component is too heavy for a task.
    """
    zero = F.lit(0).cast("long")
    top = tree.where("depth = 0").select(F.col("rep").alias("top"))
    first = top.first()
    if first is None:
        return tree.select("rep", "depth", zero.alias("n_leaves"), zero.alias("saved_tokens"))
    comp = ["comp", "comp_depth"]
    # Written, so that the one component of the start is a column to join on and not a constant.
    now = checkpointed(tree.select(F.lit(first["top"]).cast("long").alias("comp"), zero.alias("comp_depth"), *TREE, zero.alias("more_leaves"), zero.alias("more_tokens")))
    finished, light, known = [], [], None
    while True:
        heavy = checkpointed(now.groupBy(*comp).agg(F.max("weight").alias("total")).where(F.col("total") > small))
        if heavy.isEmpty():
            light.append(now)
            break
        known = known if known is not None else lineage()
        light.append(now.join(heavy, comp, "left_anti"))
        half = now.join(heavy, comp).where("2 * weight >= total")
        deepest = F.min_by(F.struct(F.col("rep").alias("c_rep"), F.col("depth").alias("c_depth"), F.col("start").alias("c_start"), F.col("weight").alias("c_weight")), "weight")
        cut = checkpointed(half.groupBy(*comp).agg(deepest.alias("c")).select(*comp, "c.*"))
        sides = _sided(now.join(cut, comp), cut, known)
        sides = checkpointed(sides)
        # Totals of what hangs from the centroid, and itself.
        totals = sides.where("side = 'below' or side = 'centroid'").groupBy(*comp).agg(F.sum("leaf").alias("leaves"), F.sum("tokens").alias("toks"))
        joined = checkpointed(sides.where("side = 'centroid' or side = 'path'").join(totals, comp))
        finished.append(
            joined.where("side = 'centroid'").select("rep", "depth", (F.col("more_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("more_tokens") + F.col("toks")).alias("saved_tokens"))
        )
        path = joined.where("side = 'path'").select(
            *comp, *[c for c in TREE if c not in ("weight", "leaf", "tokens")], (F.col("weight") - F.col("c_weight")).alias("weight"), "leaf", "tokens",
            (F.col("more_leaves") + F.col("leaves")).alias("more_leaves"), (F.col("more_tokens") + F.col("toks")).alias("more_tokens"),
        )
        same = [*comp, *TREE, "more_leaves", "more_tokens"]
        beside = sides.where("side = 'beside'").select(*same)
        below = sides.where("side = 'below'").withColumn("comp", F.col("child")).withColumn("comp_depth", F.col("c_depth") + 1).select(*same)
        now = checkpointed(path.select(*same).unionByName(beside).unionByName(below))
    rest = light[0].select(*comp, *TREE, "more_leaves", "more_tokens")
    for part in light[1:]:
        rest = rest.unionByName(part.select(*comp, *TREE, "more_leaves", "more_tokens"))
    out = mapped(rest.repartition(*comp).sortWithinPartitions(*comp), _finish, "rep long, depth long, n_leaves long, saved_tokens long")
    for part in finished:
        out = out.unionByName(part)
    return out


def _sided(rows: DataFrame, cut: DataFrame, lineage: DataFrame) -> DataFrame:
    """Where each node of a component stands to its centroid: `centroid`, `path` (above it), `below` it (and under which `child`) or `beside`."""
    null = F.lit(None).cast("long")
    level, own = F.col("c_depth") + 1, F.col("rep") == F.col("c_rep")
    deep = rows.where("depth > c_depth")
    # A chain that begins at or above the centroid's depth shows its owner there itself; for others the lineage is asked.
    near = deep.where(own | (F.col("start") <= level))
    inside = own | ((F.col("start") == level) & (F.col("up") == F.col("c_rep")))
    near = near.withColumn("side", F.when(inside, "below").otherwise("beside")).withColumn("child", F.when(inside, F.col("rep")))
    far = deep.where(~own & (F.col("start") > level)).join(
        lineage.select(F.col("conv").alias("rep"), (F.col("at") - 1).alias("c_depth"), "owner", "over"), ["rep", "c_depth"], "left"
    )
    inside = F.coalesce(F.col("over") == F.col("c_rep"), F.lit(False))
    far = far.withColumn("side", F.when(inside, "below").otherwise("beside")).withColumn("child", F.when(inside, F.col("owner"))).drop("owner", "over")
    high = rows.where("depth <= c_depth")
    plain = high.where(own | (F.col("depth") == F.col("c_depth")))
    here = F.when(own & (F.col("depth") == F.col("c_depth")), "centroid").when(own, "path").otherwise("beside")
    plain = plain.withColumn("side", here).withColumn("child", null)
    # The part of the path above the centroid's own chain.
    path = cut.where("comp_depth < c_start").select("comp_depth", "c_start", F.col("c_rep").alias("conv")).join(lineage, "conv").where("at >= comp_depth and at < c_start")
    path = path.select(F.col("owner").alias("rep"), F.col("at").alias("depth"), F.lit(True).alias("hit"))
    other = high.where(~own & (F.col("depth") < F.col("c_depth"))).join(path, ["rep", "depth"], "left")
    other = other.withColumn("side", F.when(F.col("hit"), "path").otherwise("beside")).withColumn("child", null).drop("hit")
    return near.unionByName(far).unionByName(plain).unionByName(other)


def _finish(batches: Iterator[dict]) -> Iterator[dict]:
    """Whole components of a sorted partition, many at a time."""
    names = ("comp", "comp_depth", *TREE, "more_leaves", "more_tokens")
    held: list[dict] = []
    rows = 0

    def done(part: dict) -> dict:
        leaves, tokens = decompose(part)
        return {"rep": part["rep"], "depth": part["depth"], "n_leaves": leaves, "saved_tokens": tokens}

    for b in batches:
        held.append({n: np.array([0 if v is None else v for v in b[n]], np.int64) for n in names})
        rows += len(held[-1]["rep"])
        if rows < GATHERED:
            continue
        whole = {n: np.concatenate([h[n] for h in held]) for n in names}
        last = (whole["comp"] == whole["comp"][-1]) & (whole["comp_depth"] == whole["comp_depth"][-1])
        end = int(np.argmax(last))  # sorted: the last component may go on
        if end:
            yield done({n: v[:end] for n, v in whole.items()})
        held = [{n: v[end:] for n, v in whole.items()}]
        rows = len(held[0]["rep"])
    if rows:
        yield done({n: np.concatenate([h[n] for h in held]) for n in names})


def _keys(*columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), [(f"f{i}", np.int64) for i in range(len(columns))])
    for i, c in enumerate(columns):
        out[f"f{i}"] = c
    return out


def decompose(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Subtree sums of `leaf` and `tokens` for the nodes of whole components, all components split at once in each round."""
    n = len(t["rep"])
    _, comp = np.unique(_keys(t["comp"], t["comp_depth"]), return_inverse=True)
    _, node = np.unique(np.concatenate([_keys(t["rep"], t["depth"]), _keys(t["parent"], t["depth"] - 1)]), return_inverse=True)
    where = np.full(2 * n, -1)
    where[node[:n]] = np.arange(n)
    parent = where[node[n:]]
    # A parent in another component does not count: this node is its component's top.
    parent = np.where((parent >= 0) & (comp[parent] == comp), parent, -1)
    size = np.ones(n, np.int64)
    by_depth = np.argsort(t["depth"], kind="stable")
    cuts = np.flatnonzero(np.diff(t["depth"][by_depth])) + 1
    groups = np.split(by_depth, cuts)
    for g in reversed(groups):
        inner = g[parent[g] >= 0]
        np.add.at(size, parent[inner], size[inner])
    # Preorder: components one behind another, siblings by their places.
    sibling = np.lexsort((np.arange(n), np.where(parent >= 0, parent, -1)))
    total = np.cumsum(size[sibling]) - size[sibling]
    p = parent[sibling]
    begin = np.concatenate([[True], p[1:] != p[:-1]]) if n else np.empty(0, bool)
    offset = np.empty(n, np.int64)
    offset[sibling] = total - np.maximum.accumulate(np.where(begin, total, 0))
    at = np.empty(n, np.int64)
    for g in groups:
        over = parent[g]
        at[g] = np.where(over >= 0, at[over] + 1 + offset[g], offset[g])
    order = np.argsort(at)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    parent = np.where(parent[order] >= 0, back[parent[order]], -1)
    end, weight = np.arange(n) + size[order], t["weight"][order].copy()
    values = np.stack([t["leaf"][order], t["tokens"][order]])
    more = np.stack([t["more_leaves"][order], t["more_tokens"][order]])
    label = np.arange(n)  # top of each node's component
    for g in groups:
        g = back[g]
        label[g] = np.where(parent[g] >= 0, label[parent[g]], g)
    result = np.zeros((2, n), np.int64)
    alive = np.arange(n)
    while len(alive):
        lab = label[alive]
        heavy = alive[2 * weight[alive] >= weight[lab]]
        centre = np.full(n, -1)
        np.maximum.at(centre, label[heavy], heavy)  # heavy nodes form a path: the deepest is the last
        c = centre[lab]
        below = (alive > c) & (alive < end[c])
        path = (alive < c) & (c < end[alive])
        part = below | (alive == c)
        totals = np.zeros((2, n), np.int64)
        for k in range(2):
            np.add.at(totals[k], lab[part], values[k][alive[part]])
        middle = alive[alive == c]
        result[:, middle] = more[:, middle] + totals[:, label[middle]]
        up = alive[path]
        more[:, up] += totals[:, label[up]]
        weight[up] -= weight[c[path]]
        down, at_ = alive[below], c[below]
        by_comp = np.argsort(label[down], kind="stable")
        down, at_ = down[by_comp], at_[by_comp]
        child = np.maximum.accumulate(np.where(parent[down] == at_, np.arange(len(down)), 0))
        label[down] = down[child]
        alive = alive[alive != c]
    return result[0][back], result[1][back]


def _ends(members: DataFrame, convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """`depth, a, b, ends_sha256`: digest of the ids of the conversations that end at a node, ascending and joined by commas.

    Ids are cut by range over node and id and joined piece by piece; then the pieces of a node pass through one hash in order, so that a
    node where very many conversations end is never held as a whole.
    """
    zero = F.lit(0).cast("long")
    rows = members.where("depth = n").select("a", "b", "depth", "conv").unionByName(convs.where("n = 0").select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), "conv"))
    rows = rows.repartitionByRange("a", "b", "depth", "conv").sortWithinPartitions("a", "b", "depth", "conv")

    def pieces(batches: Iterator[dict]) -> Iterator[dict]:
        names = ("a", "b", "depth", "first", "ids")
        key, first, held, chars, out = None, 0, [], 0, {n: [] for n in names}

        def close() -> None:
            for name, value in zip(names, (*key, first, ",".join(held))):
                out[name].append(value)

        for batch in batches:
            for a, b, depth, conv in zip(batch["a"], batch["b"], batch["depth"], batch["conv"]):
                if key != (a, b, depth) or chars > piece:
                    if key is not None:
                        close()
                    key, first, held, chars = (a, b, depth), conv, [], 0
                held.append(str(conv))
                chars += len(held[-1]) + 1
            if len(out["a"]) >= 500:
                yield out
                out = {n: [] for n in names}
        if key is not None:
            close()
        yield out

    joined = mapped(rows, pieces, "a long, b long, depth long, first long, ids string")

    def fold(batches: Iterator[dict]) -> Iterator[dict]:
        names = ("a", "b", "depth", "ends_sha256")
        key, state, out = None, None, {n: [] for n in names}

        def close() -> None:
            for name, value in zip(names, (*key, state.hexdigest())):
                out[name].append(value)

        for batch in batches:
            for a, b, depth, ids in zip(batch["a"], batch["b"], batch["depth"], batch["ids"]):
                if key == (a, b, depth):
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    close()
                key, state = (a, b, depth), sha256(ids.encode())
            if len(out["a"]) >= 500:
                yield out
                out = {n: [] for n in names}
        if key is not None:
            close()
        yield out

    by_node = joined.repartition("a", "b", "depth").sortWithinPartitions("a", "b", "depth", "first")
    return mapped(by_node, fold, "a long, b long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, small: int = SMALL) -> DataFrame:
    """A row for every distinct prefix: `conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`.

    `turns` as of `read_turns` or `spliced`, `convs` with every conversation and its length. `saved_tokens` counts the words that need not
    be processed again where conversations share a prefix, over the subtree; components up to a weight of `small` are finished in tasks. Prefixes are told apart by 128 bits of hash. Conversations
    without turns end at the root; equal conversations share all nodes; without conversations there is no node, not even a root.
    """
    convs = checkpointed(convs)
    top = convs.agg(F.min("conv")).first()[0]
    if top is None:
        return convs.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    members = checkpointed(_prefixes(turns))
    tree = _forest(members, convs, top)
    sums = centroid_rollup(tree, lambda: _lineage(members, tree, top), small)
    nothing = F.lit(sha256(b"").hexdigest())
    whole = tree.join(sums, ["rep", "depth"]).join(_ends(members, convs), ["a", "b", "depth"], "left")
    return whole.select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are; columns and edge cases as in `read_turns` and `prefix_trie`, other columns are not read."""
    turns = checkpointed(read_turns(conversations))
    return prefix_trie(turns, turns.where("pos = 0").select("conv", "n"))


def trie_sql() -> str:
    """The trie of rebuilt conversations as SQL. Turns of one number stand by role and text."""
    crc = (
        "xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(length(cast(conv_id as varchar))), lambda i: cast(ord(cast(conv_id as varchar)[i + 1]) as bigint))), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), cast([0,0,0,0,0,0,0,0] as bigint[])), lambda s, z: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end)), 4294967295)"
    )
    return f"""with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos from conversations where conv_id is not null),
c as (select conv_id, {crc} % 4 as h from t where pos = 0),
b as (select c.conv_id, t.pos, t.role, t.text from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and t.pos < c.h
  union all select c.conv_id, t.pos, t.role, t.text from c join t on t.conv_id = c.conv_id and t.pos >= c.h),
s as (select conv_id, list(role || chr(31) || sha256(text) order by pos) as path, list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) order by pos) as words from b group by conv_id),
m as (select c.conv_id, coalesce(path, []) as path, coalesce(words, []) as words from c left join s on s.conv_id = c.conv_id),
p as (select conv_id, unnest(range(len(path) + 1)) as depth, path, words from m),
q as (select conv_id, depth, len(path) as n, array_to_string(path[1 : depth], chr(30)) as key, case when depth = 0 then 0 else words[depth] end as words,
  array_to_string(path[1 : depth - 1], chr(30)) as up from p),
n as (select depth, key, min(conv_id) as conv_id, any_value(up) as up, count(*) as n_convs, any_value(words) as words,
  sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where n = depth), '')) as ends_sha256 from q group by depth, key),
k as (select depth - 1 as depth, up as key, count(*) as n_children from n where depth > 0 group by all),
v as (select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * n.words as own from n left join k on k.depth = n.depth and k.key = n.key),
a as (select q.depth, q.key, sum(case when v.n_children = 0 then 1 else 0 end) as n_leaves, sum(v.own) as saved from v join q on q.conv_id = v.conv_id and q.depth <= v.depth group by q.depth, q.key)
select v.conv_id, v.depth, u.conv_id as parent_conv_id, v.n_convs, cast(v.n_children as bigint) as n_children, cast(a.n_leaves as bigint) as n_leaves, cast(a.saved as bigint) as saved_tokens, v.ends_sha256
from v join a on a.depth = v.depth and a.key = v.key left join n u on v.depth > 0 and u.depth = v.depth - 1 and u.key = v.up"""
