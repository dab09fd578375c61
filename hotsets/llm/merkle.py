"""Merkle manifest of a dataset: a tree for each group of rows, one root over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotsets.llm.common import handoff
from hotsets.llm.ranks import ranked

#: levels of a tree that are built and looked up together: 2 ** 5 nodes make a bucket
BAND = 5


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (lowercase hex) of the values, each as its UTF-8 byte count, ``:`` and itself; ``-`` for NULL."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and a proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, p: F.sha2(F.concat(_hex(p["left"]), acc, _hex(p["right"])), 256))


def proof_text(proof: Column) -> Column:
    """All sibling digests of a proof, leaf to root, left to right, as one string of hex digits."""
    return F.array_join(F.transform(proof, lambda p: F.concat(_hex(p["left"]), _hex(p["right"]))), "")


def _band(nodes: DataFrame, arity: int, level: int) -> DataFrame:
    """The next ``BAND`` levels above ``nodes``: a row for each bucket of at most ``arity ** BAND`` of them.

    ``nodes``: ``tree``, ``n`` (its leaves), ``lo``, ``hi`` (the interval of leaf ranks that a node
    covers) and ``digest``.  A bucket's ``parents`` are its nodes of the levels above with their
    intervals and children, in ascending levels; ``top`` is the last.  A tree that has come to
    one node grows no further.
    """
    rows = nodes.groupBy("tree", "n", F.expr(f"lo div {arity ** (level + BAND)}").alias("bucket")).agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("run"))
    made = []
    for step in range(BAND):
        grows, run, kids = F.col("n") > arity ** (level + step), F.col("run"), f"kids{step}"
        first = F.sequence(F.lit(0), F.expr(f"(size(run) - 1) div {arity}").cast("int"))
        rows = rows.withColumn(kids, F.when(grows, F.transform(first, lambda i: F.slice(run, i * arity + 1, F.lit(arity)))))
        rows = rows.withColumn("run", F.when(grows, F.transform(kids, lambda k: F.struct(
            k[0]["lo"].alias("lo"), F.element_at(k, -1)["hi"].alias("hi"),
            F.unhex(F.sha2(_hex(F.transform(k, lambda c: c["digest"])), 256)).alias("digest")))).otherwise(run))
        made.append(F.transform(kids, lambda k: F.struct(k[0]["lo"].alias("lo"), F.element_at(k, -1)["hi"].alias("hi"), k.alias("kids"))))
    parents = F.flatten(F.filter(F.array(*made), lambda p: p.isNotNull()))
    return handoff(rows.select("tree", "n", "bucket", parents.alias("parents"), F.get("run", F.lit(0)).alias("top")))


def _build(leaves: DataFrame, arity: int, largest: int) -> list[DataFrame]:
    """Bands from the leaves to the roots; ``largest``: leaves of the largest tree."""
    bands, nodes, level = [], leaves, 0
    while not bands or arity ** level < largest:
        bands.append(_band(nodes, arity, level))
        nodes = bands[-1].select("tree", "n", "top.lo", "top.hi", "top.digest")
        level += BAND
    return bands


def _siblings(parents: Column, lo: Column, hi: Column) -> Column:
    """For every parent whose interval contains [lo, hi), what is left of it without the child that does."""
    around = F.filter(parents, lambda p: (p["lo"] <= lo) & (hi <= p["hi"]))
    return F.transform(around, lambda p: F.struct(
        F.transform(F.filter(p["kids"], lambda c: c["hi"] <= lo), lambda c: c["digest"]).alias("left"),
        F.transform(F.filter(p["kids"], lambda c: c["lo"] >= hi), lambda c: c["digest"]).alias("right")))


def _attach(nodes: DataFrame, band: DataFrame, arity: int, level: int, columns: list[str]) -> DataFrame:
    """Containment join of nodes of ``level`` with the bucket of ancestors that covers them.

    ``band`` also has ``proof`` (from its top on) and ``columns``; the nodes come back with
    their own ``proof`` and those.  At most ``arity ** BAND`` nodes meet a bucket.
    """
    a, b = nodes.alias("a"), band.alias("b")
    bucket = F.expr(f"a.lo div {arity ** (level + BAND)}")
    inside = (F.col("b.top.lo") <= F.col("a.lo")) & (F.col("a.hi") <= F.col("b.top.hi"))
    joined = a.join(b, (F.col("a.tree") == F.col("b.tree")) & (bucket == F.col("b.bucket")) & inside)
    return joined.select("a.*", F.concat(_siblings(F.col("b.parents"), F.col("a.lo"), F.col("a.hi")), F.col("b.proof")).alias("proof"), *[F.col(f"b.{c}") for c in columns])


def _descend(leaves: DataFrame, bands: list[DataFrame], arity: int, roots: DataFrame, columns: list[str]) -> DataFrame:
    """Proofs of all leaves: from the roots (``tree``, ``proof``, ``columns``) down, band by band."""
    upper = bands[-1].join(roots, "tree")
    for k in range(len(bands) - 2, -1, -1):
        tops = bands[k].withColumns({"lo": F.col("top.lo"), "hi": F.col("top.hi")})
        upper = _attach(tops, upper, arity, BAND * (k + 1), columns)
    return _attach(leaves, upper, arity, 0, columns)


def dataset_manifest(rows: DataFrame, arity: int = 2) -> DataFrame:
    """``rows`` with ``subroot``, ``root`` (lowercase hex) and ``proof``.

    ``rows``: ``id``, ``group`` (string), ``leaf`` (hex digest), and any others, which are kept.
    Within a group leaves ascend by id (NULL first, equal ids by leaf); every ``arity``
    consecutive nodes become the digest of their hex digests until one is left, the subroot
    (a lone leaf itself); the subroots, by group (NULL first, bytewise), likewise make the
    root.  ``proof``: for each level the digests to the ``left`` and ``right`` of the path, which
    ``fold`` takes back to the root.

    Every node carries the interval of leaf ranks it covers.  Levels are built in bands of
    ``BAND``, a bucket of at most ``arity ** BAND`` nodes to a row; a containment join hands each
    node the bucket of ancestors above it, and the siblings are what a parent's interval holds
    besides the child on the path.  So no join key has more than ``arity ** BAND`` rows on one
    side and one on the other, whatever the size of a group.  One row per input row, repeated rows
    included (each is a leaf); an empty table gives an empty result.
    """
    if arity < 2:
        raise ValueError("arity must be at least 2")
    keep = rows.columns
    tree = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit("-"))  # sorts as the group does, NULL first
    placed = ranked(rows.withColumn("tree", tree), ["tree"], ["id", "leaf"])
    leaves = placed.withColumns({"lo": F.col("pos"), "hi": F.col("pos") + 1, "n": F.col("total")}).drop("pos", "total", "first")
    nodes = leaves.select("tree", "n", "lo", "hi", F.unhex("leaf").alias("digest"))
    bands = _build(nodes, arity, leaves.agg(F.max("n")).first()[0] or 0)

    subroots = ranked(bands[-1].select("tree", "top.digest"), [], ["tree"])
    subroots = subroots.select(F.lit("").alias("tree"), F.col("total").alias("n"), F.col("pos").alias("lo"), (F.col("pos") + 1).alias("hi"),
                               "digest", F.col("tree").alias("of"), F.lower(F.hex("digest")).alias("subroot"))
    above = _build(subroots, arity, subroots.agg(F.max("n")).first()[0] or 0)
    none = F.array().cast("array<struct<left:array<binary>,right:array<binary>>>")
    root = above[-1].select("tree", none.alias("proof"), F.lower(F.hex("top.digest")).alias("root"))
    proofs = _descend(subroots, above, arity, root, ["root"])
    roots = handoff(proofs.select(F.col("of").alias("tree"), "proof", "subroot", "root"))
    return _descend(leaves, bands, arity, roots, ["subroot", "root"]).select(*[F.col(f"`{c}`") for c in keep], "subroot", "root", "proof")
