"""Prefix trie of conversations with subtree totals by centroid decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotsets.llm.common import handoff, map_batches, quoted
from hotsets.llm.ranks import ranked

#: a conversation without an id sorts before all others, under this one inside this module
NO_ID = -(1 << 63)
#: consecutive turns, or consecutive ids, that are handled together
BLOCK = 4096
#: components of fewer nodes are decomposed inside a task
LOCAL = 1024
#: rows of one component that meet in one task
SALTED = 16_384


def turn_digests(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``digest`` (of role and text) and ``chars`` (code points of the text): all that the trie needs
    of a turn.  NULL role and text count as empty."""
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return rows.select(quoted(conv_col).cast("long").alias("conv"), quoted(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def _prefixes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv``, ``depth``, ``turns`` (of the conversation), ``key`` (equal for equal prefixes), ``chars``.

    The key digests the depth and four sums over the prefix of 32-bit digests of (depth, turn): sums
    can be added up by blocks of turns, so a conversation of any length is dealt over tasks.
    """
    placed = ranked(turns, ["conv"], [c for c in turns.columns if c not in ("conv", "chars")])
    tagged = F.sha2(F.concat((F.col("pos") + 1).cast("string"), F.lit(":"), F.col("digest")), 256)
    rows = placed.select("conv", (F.col("pos") + 1).alias("depth"), F.col("total").alias("turns"), "chars", tagged.alias("x"), F.expr(f"pos div {BLOCK}").alias("block"))
    lanes = [f"s{i}" for i in range(4)]
    rows = rows.withColumns({lane: F.conv(F.substring("x", 8 * i + 1, 8), 16, 10).cast("long") for i, lane in enumerate(lanes)}).drop("x")
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "block").agg(*[F.sum(c).alias(c) for c in lanes])
    sums = sums.select("conv", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"o{c}") for c in lanes])
    rows = rows.withColumns({c: F.sum(c).over(inside) for c in lanes}).join(sums, ["conv", "block"])
    text = F.concat_ws(".", F.col("depth").cast("string"), *[(F.col(c) + F.col(f"o{c}")).cast("string") for c in lanes])
    rows = handoff(rows.select("conv", "depth", "turns", F.unhex(F.left(F.sha2(text, 256), F.lit(32))).alias("key"), "chars"))
    roots = conversations.join(rows.where("depth = 1").select("conv", F.col("turns").alias("n")), "conv", "left")
    roots = roots.select("conv", F.lit(0).cast("long").alias("depth"), F.coalesce("n", F.lit(0)).cast("long").alias("turns"),
                         F.lit(b"").alias("key"), F.lit(0).cast("long").alias("chars"))
    return rows.unionByName(roots)


def _ends(members: DataFrame) -> DataFrame:
    """``conv``, ``depth`` of nodes where conversations end, and the digest of those conversations' ids.

    Ids are put in order over all tasks and joined to strings of ``BLOCK`` ids; only these pass through
    the one hash that a node's digest is, piece by piece.
    """
    ends = members.where("depth = turns").select(F.col("first").alias("owner"), "depth", "conv")
    ids = ranked(ends, ["owner", "depth"], ["conv"]).withColumn("piece", F.expr(f"pos div {BLOCK}"))
    named = F.transform(F.sort_array(F.collect_list("conv")), lambda c: F.when(c == NO_ID, F.lit("")).otherwise(c.cast("string")))
    pieces = ids.groupBy("owner", "depth", "piece").agg(F.array_join(named, ",").alias("ids"))
    pieces = pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def batch(done):
            return pa.record_batch([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv", "depth", "ends_sha256"])

        for b in batches:
            done = []
            for owner, depth, ids in zip(*(b.column(c).to_pylist() for c in ("owner", "depth", "ids"))):
                if (owner, depth) != at:
                    if at:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield batch(done)
        if at:
            yield batch([(*at, digest.hexdigest())])

    return map_batches(pieces, run, "conv long, depth long, ends_sha256 string")


def _sizes(paths: DataFrame) -> DataFrame:
    """``conv``, ``depth``, ``size``: the nodes of every node's subtree.

    A conversation owns the nodes of which it is the smallest member, the lower end of its path; at
    every node of its path it adds those it owns from there on down.
    """
    owned = paths.where("conv = owner").groupBy("conv").agg(F.min("depth").alias("from"), F.max("depth").alias("to"))
    owned = owned.withColumn("block", F.explode(F.expr(f"sequence(0, to div {BLOCK})")))
    rows = paths.withColumn("block", F.expr(f"depth div {BLOCK}")).join(owned, ["conv", "block"])
    return rows.groupBy(F.col("owner").alias("conv"), "depth").agg(F.sum(F.col("to") - F.greatest("depth", "from") + 1).alias("size"))


def local_rollup(nodes: list[tuple[int, int]], sizes: list[int], values: list[list[int]], added: list[list[int]]) -> list[list[int]]:
    """Subtree totals of one component by centroid decomposition.

    ``nodes``: (node, parent) positions, -1 for the top; ``sizes``: nodes of the subtrees;
    ``values`` of the nodes and what has been ``added`` to them.  A component's centroid is its deepest
    node with half of the component below or at it.  Its subtree's total goes to all nodes between it
    and the top; then the subtrees of its children and what is left above are components.
    """
    parent = [-1] * len(nodes)
    children: list[set[int]] = [set() for _ in nodes]
    for v, p in nodes:
        parent[v] = p
        if p >= 0:
            children[p].add(v)
    out, todo, width = [list(a) for a in added], [v for v, p in nodes if p < 0], range(len(values[0]) if values else 0)
    while todo:
        top = todo.pop()
        c, half = top, (sizes[top] + 1) // 2
        while (below := next((u for u in children[c] if sizes[u] >= half), None)) is not None:
            c = below
        total, walk = [0 for _ in width], [c]
        while walk:
            v = walk.pop()
            walk += children[v]
            for k in width:
                total[k] += values[v][k]
        for k in width:
            out[c][k] += total[k]
        v, cut = c, sizes[c]
        while v != top:
            v = parent[v]
            sizes[v] -= cut
            for k in width:
                out[v][k] += total[k]
        todo += children[c]
        if c != top:
            children[parent[c]].discard(c)
            todo.append(top)
    return out


def _finish(live: DataFrame, values: list[str]) -> DataFrame:
    """Components of bounded size, each decomposed inside a task."""
    comps = live.groupBy("tconv", "tdepth").agg(F.collect_list(F.struct("conv", "depth", "pconv", "size", *values, *[f"a_{v}" for v in values])).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for top_conv, top_depth, nodes in zip(*(b.column(c).to_pylist() for c in ("tconv", "tdepth", "nodes"))):
                at = {(x["conv"], x["depth"]): i for i, x in enumerate(nodes)}
                edges = [(i, -1 if (x["conv"], x["depth"]) == (top_conv, top_depth) else at[x["pconv"], x["depth"] - 1]) for i, x in enumerate(nodes)]
                done = local_rollup(edges, [x["size"] for x in nodes], [[x[v] for v in values] for x in nodes], [[x[f"a_{v}"] for v in values] for x in nodes])
                out += [(x["conv"], x["depth"], *r) for x, r in zip(nodes, done)]
            yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(2 + len(values))], ["conv", "depth", *values])

    return map_batches(comps, run, f"conv long, depth long, {', '.join(f'{v} long' for v in values)}")


def _split(live: DataFrame, paths: DataFrame, values: list[str], bound: int) -> tuple[DataFrame, DataFrame | None]:
    """Split every component of ``bound`` nodes or more at its centroid.

    Returns the nodes that stay, in their new components, and the centroids with their totals (None
    if no component is that large).
    """
    salts = max(1, 2 * bound // SALTED)
    top = ["tconv", "tdepth"]

    def meet(rows: DataFrame, comps: DataFrame, how: str) -> DataFrame:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("conv", "depth"), F.lit(salts)))
        return rows.join(comps.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [*top, "salt"], how).drop("salt")

    heavy = live.where(F.col("size") * 2 >= bound).select(*top, "conv", "depth", "size")
    totals = heavy.groupBy(top).agg(F.max("size").alias("total")).where(F.col("total") >= bound)
    found = meet(heavy, totals, "inner").where("size * 2 >= total").groupBy(top).agg(F.min(F.struct("size", "conv", "depth")).alias("c"))
    centroids = handoff(found.select(*top, F.col("c.conv").alias("cconv"), F.col("c.depth").alias("cdepth"), F.col("c.size").alias("csize")))
    if centroids.isEmpty():
        return live, None

    # a node lies below the centroid if its path has the centroid at that depth
    step = paths.select("conv", F.col("depth").alias("cdepth"), F.col("owner").alias("at"), "next")
    met = meet(live, centroids, "left").join(step, ["conv", "cdepth"], "left")
    below = F.coalesce((F.col("depth") >= F.col("cdepth")) & (F.col("at") == F.col("cconv")), F.lit(False))
    met = handoff(met.select(*live.columns, "cconv", "cdepth", "csize", "next", below.alias("below")))
    sums = handoff(met.where("below").groupBy(*top, "cconv", "cdepth", "csize").agg(*[F.sum(v).alias(f"s_{v}") for v in values]))

    along = sums.where("cdepth > tdepth").withColumn("depth", F.explode(F.sequence("tdepth", F.col("cdepth") - 1))).alias("x")
    along = along.join(paths.alias("p"), (F.col("x.cconv") == F.col("p.conv")) & (F.col("x.depth") == F.col("p.depth")))
    along = along.select(F.col("p.owner").alias("conv"), F.col("x.depth").alias("depth"), F.col("x.csize").alias("cut"), *[f"x.s_{v}" for v in values])
    itself = F.coalesce((F.col("conv") == F.col("cconv")) & (F.col("depth") == F.col("cdepth")), F.lit(False))
    rest = met.where(~itself).join(along, ["conv", "depth"], "left")
    rest = rest.select(
        "conv", "depth", F.when(F.col("below"), F.col("next")).otherwise(F.col("tconv")).alias("tconv"),
        F.when(F.col("below"), F.col("cdepth") + 1).otherwise(F.col("tdepth")).alias("tdepth"), "pconv",
        (F.col("size") - F.coalesce("cut", F.lit(0))).alias("size"), *values,
        *[(F.col(f"a_{v}") + F.coalesce(f"s_{v}", F.lit(0))).alias(f"a_{v}") for v in values])
    done = met.where(itself).join(sums.select(F.col("cconv").alias("conv"), F.col("cdepth").alias("depth"), *[f"s_{v}" for v in values]), ["conv", "depth"])
    done = done.select("conv", "depth", *[(F.col(f"a_{v}") + F.col(f"s_{v}")).alias(v) for v in values])
    return handoff(rest), handoff(done)


def centroid_rollup(nodes: DataFrame, paths: DataFrame, values: list[str], local: int = LOCAL) -> DataFrame:
    """``conv``, ``depth`` and, for each of ``values``, its total over the node's subtree.

    ``nodes``: ``conv``, ``depth`` (a node's name), ``tconv``, ``tdepth`` (its root's), ``pconv`` (its parent
    is (pconv, depth - 1)), ``size`` (nodes of its subtree) and ``values``.  ``paths``: ``conv``, ``depth``, ``owner``, ``next``:
    the names of the nodes on the path to the nodes of ``conv``, and of the one after.

    Centroid decomposition of the parent-edge forest, all components of a size class at once:
    in a round with bound t every component has fewer than 2 t nodes, and those of t or more are split
    at the deepest node that has half of the component's nodes in its subtree.  The total of
    that subtree inside the component is added to the centroid, which is done, and along its path to
    the component's top; the children's subtrees and the rest above are the next components, of at
    most half the size.  So rounds grow with the logarithm of the largest component, whatever
    the depth of the forest.  Components of fewer than ``local`` nodes are decomposed in one task
    each, the same way.  A component's rows are salted when they meet its centroid, so that no key
    has more than about ``SALTED`` rows.
    """
    live = handoff(nodes.select("conv", "depth", "tconv", "tdepth", "pconv", "size", *values, *[F.lit(0).cast("long").alias(f"a_{v}") for v in values]))
    done = []
    most = live.agg(F.max("size")).first()[0] or 0
    bound = 1 << max(most.bit_length() - 1, 0)
    while bound * 2 > local:
        live, split = _split(live, paths, values, bound)
        done += [split] if split is not None else []
        bound //= 2
    out = _finish(live, values)
    for d in done:
        out = out.unionByName(d)
    return out


def prefix_trie(turns: DataFrame, conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of all conversations, one row per node.

    ``turns``: ``conv`` (long), columns to order its turns by, ``digest`` and ``chars`` (see
    ``turn_digests``); ``conversations``: every ``conv`` once, those without turns too.  Turns
    that the order does not tell apart follow each other by digest, repeated rows side by side.  A
    node is a distinct sequence of first turns, the root the empty one; its name is (smallest member,
    depth).  Returns ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` (over the node's subtree: childless nodes, and the code points
    of last turns that members after the first need not store again), ``ends_sha256``.  The id
    ``NO_ID`` comes back as NULL and is empty in the digest.  No conversations, no nodes.

    Equal prefixes meet by a key of 128 bits.  Members are put in order over all tasks, so a
    first turn that a third of all conversations share, or one conversation with a third of all
    turns, is dealt out; subtree totals come from ``centroid_rollup``.
    """
    members = ranked(_prefixes(turns, conversations), ["depth", "key"], ["conv"])
    named = members.select("conv", "depth", F.col("first").alias("owner"))
    nodes = members.where("pos = 0").select("conv", "depth", F.col("total").alias("n_convs"), "chars")
    paths = named.join(nodes.select("conv").distinct(), "conv", "left_semi")
    paths = handoff(paths.join(named.select("conv", (F.col("depth") - 1).alias("depth"), F.col("owner").alias("next")), ["conv", "depth"], "left"))
    edges = paths.where("next = conv").select("conv", F.col("owner").alias("pconv"), (F.col("depth") + 1).alias("depth"))
    children = edges.groupBy(F.col("pconv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    name = ["conv", "depth"]
    root = conversations.agg(F.min("conv")).first()[0]
    nodes = nodes.join(edges, name, "left").join(children, name, "left").join(_sizes(named), name)
    nodes = handoff(nodes.select(*name, F.lit(root).cast("long").alias("tconv"), F.lit(0).cast("long").alias("tdepth"), "pconv", "size", "n_convs",
                                 F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("n_leaves"),
                                 ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")))
    totals = centroid_rollup(nodes, paths, ["n_leaves", "saved_tokens"], local)
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, name).join(_ends(members), name, "left")

    def public(c: str):
        return F.when(F.col(c) != NO_ID, F.col(c))

    return out.select(public("conv").alias("conv_id"), "depth", public("pconv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
