"""SimHash near duplicates: byte-position inverted index with count filtering."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotsets.llm.common import handoff, keep_columns, map_batches, quoted, same
from hotsets.llm.components import connected_components

BITS = 64
BYTES = 8
#: distinct fingerprints of one posting that are compared in one block
BLOCK = 2048
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_WINDOW = 1 << 16


def text_fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of one text (module docstring of the operator has the rules)."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    ones, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, _WINDOW):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + _WINDOW], ends[at:at + _WINDOW])], "<u8")
        by = h.view(np.uint8).reshape(-1, BYTES)
        for p in range(BYTES):
            ones[p * 8:p * 8 + 8] += np.bincount(by[:, p], minlength=256) @ _BYTE_BITS
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) of every row.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a shingle is
    ``shingle`` words joined by one space; its hash is XXH64 with seed 42.  A bit is set where
    over half of the shingles (repeats included) have it.  Fewer words than a shingle: the
    whole sequence is the one shingle.  NULL, empty or white text: fingerprint 0.
    """
    src = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([text_fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def _byte(fp, p: int):
    return F.shiftright(fp, 8 * p).bitwiseAND(F.lit(255))


def _postings(fps: DataFrame, max_bits: int) -> DataFrame:
    """One row per fingerprint and per set of byte positions that a link must share.

    ``max_bits`` differing bits touch at most that many bytes, so two linked fingerprints agree
    in at least ``8 - max_bits`` byte positions: the guaranteed number of matches.  The posting
    of a *set* of that many (position, byte) entries holds exactly the fingerprints that reach
    this count on these positions, so a pair that shares no posting has too small a tally.
    """
    keys = []
    for k, chosen in enumerate(itertools.combinations(range(BYTES), BYTES - max_bits)):
        mask = F.lit(_signed(sum(255 << (8 * p) for p in chosen))).cast("long")
        keys.append(F.struct(F.lit(k).cast("short").alias("k"), F.col("fp").bitwiseAND(mask).alias("bytes")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("p")).select("p.k", "p.bytes", "fp")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _half_byte_postings(postings: DataFrame, max_bits: int) -> DataFrame:
    """Rows of large postings under sets of half bytes, counted the same way one level down.

    The fingerprints of a posting agree in ``8 - max_bits`` bytes; the ``max_bits`` bits in which
    two of them may differ touch at most half of the half bytes of the others, so a linked pair
    shares a set of ``max_bits`` of these too.  Each row comes under every such set.  For four
    bits that fixes 48 bits: no posting of this level holds more than 65 536 fingerprints.
    """
    sets = list(itertools.combinations(range(BYTES), BYTES - max_bits))
    rows = []
    for k, chosen in enumerate(sets):
        fixed = sum(255 << (8 * p) for p in chosen)
        free = [h for h in range(2 * BYTES) if h // 2 not in chosen]
        rows += [(k, _signed(fixed | sum(15 << (4 * h) for h in halves))) for halves in itertools.combinations(free, max_bits)]
    masks = postings.sparkSession.createDataFrame([(k, len(sets) + at, mask) for at, (k, mask) in enumerate(rows)], "k short, under short, mask long")
    # some thousand masks, a number that only max_bits sets
    found = postings.join(F.broadcast(masks), "k")
    return found.select(F.col("under").alias("k"), F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"), "fp")


def _tally(a, b):
    """Number of byte positions in which two fingerprints agree."""
    x = a.bitwiseXOR(b)
    return sum(F.when(_byte(x, p) == 0, 1).otherwise(0) for p in range(BYTES))


def _block_links(max_bits: int):
    """Links of the blocks in one bundle, of each block as few as keep its pieces together."""
    popcount = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)

    def block(left: np.ndarray, right: np.ndarray, a_out: list, b_out: list) -> None:
        nodes = np.union1d(left, right)
        label = np.arange(len(nodes))
        at_right = np.searchsorted(nodes, right)
        for i, f in zip(np.searchsorted(nodes, left).tolist(), left):
            x = right ^ f
            near = np.flatnonzero((x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - max_bits)
            bits = popcount[x[near].view(np.uint16).reshape(-1, 4)].sum(axis=1)
            linked = at_right[near[bits <= max_bits]]
            apart = linked[label[linked] != label[i]]
            if len(apart):
                groups, first = np.unique(label[apart], return_index=True)
                a_out += [nodes[i]] * len(groups)
                b_out += nodes[apart[first]].tolist()
                label[np.isin(label, groups)] = label[i]

    def run(rows: pa.Table) -> pa.Table:
        names = ["k", "bytes", "i", "j", "side", "fp"]
        k, by, i, j, side, fp = (rows.column(n).to_numpy().astype(np.int64) for n in names)
        order = np.lexsort((fp, side, j, i, by, k))
        k, by, i, j, side, fp = (v[order] for v in (k, by, i, j, side, fp))
        new = np.flatnonzero((np.diff(k) != 0) | (np.diff(by) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        a_out: list[int] = []
        b_out: list[int] = []
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(k)]):
            if hi - lo > 1:
                block(fp[lo:hi][side[lo:hi] != 2], fp[lo:hi][side[lo:hi] != 1], a_out, b_out)
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def _sizes(postings: DataFrame) -> DataFrame:
    return handoff(postings.groupBy("k", "bytes").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))


def _pairs(sizes: DataFrame, max_bits: int) -> DataFrame:
    """Links of the postings of two, checked in place."""
    pairs = sizes.where("n = 2").where(_tally(F.col("a"), F.col("b")) >= BYTES - max_bits)
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")


def _by_blocks(postings: DataFrame, large: DataFrame, max_bits: int, block: int) -> DataFrame:
    """Links within the postings named by ``large``, every two blocks of a posting compared."""
    large = large.select("k", "bytes", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp", "k"), F.col("parts")).cast("int")
    blocks = handoff(postings.join(large.hint("shuffle_hash"), ["k", "bytes"]).withColumn("own", own)
                     .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                     .select("k", "bytes", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp",
                             F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side")))
    # blocks share a task call in bundles of a few blocks' worth of rows
    bundles = max(1, -(-blocks.count() // (4 * block)))
    bundle = F.pmod(F.xxhash64("k", "bytes", "i", "j"), F.lit(bundles)).alias("bundle")
    return blocks.select("*", bundle).groupBy("bundle").applyInArrow(_block_links(max_bits), "a long, b long")


def links(fps: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Verified links (``a``, ``b``) that connect what fingerprints within ``max_bits`` connect.

    ``fps``: one row per distinct fingerprint, column ``fp``.  Postings of one entry link
    nothing; a posting of two is a pair, whose tally of shared bytes and bit distance are
    checked in place.  Larger postings are dealt into blocks of at most about ``block``
    fingerprints and every two blocks are compared, by tally, then by bits; of the links found
    there a spanning forest is kept, so a group of thousands of near copies costs rows in
    proportion to its size.  A posting of so many blocks that sets of half bytes make fewer
    copies of a row is indexed by these first: from there on, the copies of a row no longer grow
    with the posting.
    """
    # a fingerprint becomes 70 rows: a table of few files is dealt out first
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = _postings(fps.repartition(tasks, "fp"), max_bits)
    sizes = _sizes(postings)
    most = block * math.comb(2 * max_bits, max_bits)
    found = _pairs(sizes, max_bits).union(_by_blocks(postings, sizes.where((F.col("n") > 2) & (F.col("n") <= most)), max_bits, block))
    larger = sizes.where((F.col("n") > 2) & (F.col("n") > most)).select("k", "bytes")
    if not larger.isEmpty():
        halves = handoff(_half_byte_postings(postings.join(larger.hint("shuffle_hash"), ["k", "bytes"]), max_bits))
        sizes = _sizes(halves)
        found = found.union(_pairs(sizes, max_bits)).union(_by_blocks(halves, sizes.where("n > 2"), max_bits, block))
    return found.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 4, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` of every row of ``docs``.

    Rows whose fingerprints differ in at most ``max_bits`` bits are linked; ``component_id`` is
    the smallest doc_id that can be reached.  All rows with one fingerprint are one entry of the
    index, so exact copies cost one row each.  NULL, empty and white texts have fingerprint 0
    and are linked like any other.  Repeated rows come back as often as given.  A NULL doc_id is
    never the smallest unless no other is there.  Other columns are ignored; an empty table
    gives an empty result.
    """
    if not 0 <= max_bits < BYTES:
        raise ValueError(f"max_bits must be between 0 and {BYTES - 1}")
    rows = handoff(fingerprints(docs, id_col, text_col, shingle))
    nodes = handoff(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = connected_components(links(nodes.select("fp"), max_bits, block))
    linked = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    """The 64 bits as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one document of each SimHash group: the one with the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together; rows without a doc_id
    cannot be named as the smallest and stay.
    """
    found = simhash_components(docs, shingle=shingle, max_bits=max_bits)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone_id")).distinct()
    kept = docs.join(gone, same(F.col("doc_id"), F.col("__gone_id")), "left_anti")
    return keep_columns(kept, docs.columns)
