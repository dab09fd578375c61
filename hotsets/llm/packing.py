"""Sequence packing as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotsets.llm.common import handoff, map_batches, quoted

#: tokens in one step of the length histogram; a length counts as the next full step
STEP = 8
#: words whose ids a task remembers
CACHE_WORDS = 300_000


#: what the vocabulary's own rules do to ASCII and precomposed Latin letters can be said in one
#: pattern; other words go through the whole tokenizer
_PLAIN = re.compile("[\x21-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u017E]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u017E]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u017E]+")


def _byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordEncoder:
    """Token ids (as little-endian 32-bit words) of texts, by white-space separated pieces.

    The vocabulary's pre-tokenizer never joins text across a blank, line break or tab and drops
    them, so a text's ids are those of the pieces between them, which repeat often.  A plain
    piece is cut further into runs of letters, digits and signs, whose ids are kept as well.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        raw = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        ids = array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
        if len(self.parts) >= CACHE_WORDS:
            self.parts.clear()
        self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            parts = self.parts
            return b"".join([parts.get(p) or self._part(p) for p in _PARTS.findall(word.lower())])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").split(" ")
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._word(w) if w else b""
        return b"".join([known[w] for w in words])


def token_pieces(docs: DataFrame, tokenizer_json: str, size: int = 4096, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's ids, ``end_id`` last, cut after each ``size`` ids.

    Returns ``doc_id``, ``start``, ``length``, ``ids_crc32`` (of the ids as little-endian
    unsigned 32-bit numbers), ``doc_tokens`` and, if asked for, ``ids``.  NULL and empty texts
    are one piece of one id.
    """
    src = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one file of fixed size
    kind = src.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(vocabulary.value)
        for b in batches:
            at, start, length, crc, total, ids = [], [], [], [], [], []
            for i, t in enumerate(b.column("text")):
                raw = encode(t.as_py() or "") + end
                for a in range(0, len(raw), 4 * size):
                    piece = raw[a:a + 4 * size]
                    at.append(i)
                    start.append(a // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(raw) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
            out = [b.column("doc_id").take(pa.array(at, pa.int64()))] + [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                out, names = out + [pa.array(ids, pa.list_(pa.int32()))], names + ["ids"]
            yield pa.record_batch(out, names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return map_batches(src, run, schema)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes that fits ``room``: unbounded knapsack by room used."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")
    for v in range(1, room + 1):
        best[v] = best[v - 1]
        if fits[v]:
            gain = worth[:fits[v]] + best[v - sizes[:fits[v]]]
            j = int(gain.argmax())
            if gain[j] > best[v] + 1e-12:
                best[v], choice[v] = gain[j], j
    counts, v = np.zeros(len(sizes), np.int64), room
    while v > 0:
        if choice[v] < 0:
            v -= 1
        else:
            counts[choice[v]] += 1
            v -= sizes[choice[v]]
    return float(best[room]), counts


def cutting_stock(demand: dict[int, int], room: int, gap: float = 2e-4, max_columns: int = 20_000) -> list[tuple[dict[int, int], int]]:
    """Patterns (size -> copies) and how often each is used, so that every demanded size is placed.

    Starts from patterns of one size, prices new ones by the linear program's duals with a
    knapsack, and stops when no pattern is worth more than 1 + ``gap`` (the value is then within
    that share of the least number of sequences).  Uses are rounded down; the few sizes that
    remain (at most one use of each pattern) are placed largest first where they fit best.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    m = len(sizes)
    patterns = [np.eye(m, dtype=np.int64)[i] * int(room // sizes[i]) for i in range(m)]
    inverse = np.diag([1.0 / p.max() for p in patterns])
    target = need * (1 + 1e-9 * np.arange(m))  # breaks ties, so that the simplex cannot cycle
    uses = inverse @ target
    for _ in range(max_columns):
        value, column = best_pattern(sizes, inverse.sum(axis=0), room)
        if value <= 1 + gap:
            break
        direction = inverse @ column
        ratio = np.full(m, np.inf)
        up = direction > 1e-9
        ratio[up] = uses[up] / direction[up]
        out = int(ratio.argmin())
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        uses = uses - direction * ratio[out]
        uses[out] = ratio[out]
        patterns[out] = column
    left = need.astype(np.int64)
    plan = []
    for p, x in zip(patterns, uses):
        n = int(np.floor(x + 1e-6))
        fit = p > 0
        n = min(n, int((left[fit] // p[fit]).min()))
        if n > 0:
            left = left - n * p
            plan.append(({int(sizes[i]): int(p[i]) for i in np.flatnonzero(p)}, n))
    return plan + _best_fit({int(s): int(n) for s, n in zip(sizes, left) if n}, room)


def _best_fit(sizes: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    open_by_room: list[list[dict[int, int]]] = [[] for _ in range(room + 1)]
    for s in sorted(sizes, reverse=True):
        for _ in range(sizes[s]):
            at = next((r for r in range(s, room) if open_by_room[r]), room)
            seq = open_by_room[at].pop() if at < room else {}
            seq[s] = seq.get(s, 0) + 1
            open_by_room[at - s].append(seq)
    return [(seq, 1) for level in open_by_room for seq in level]


def pack(pieces: DataFrame, size: int = 4096, step: int = STEP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: where each one stands.

    ``pieces``: ``doc_id``, ``start``, ``length`` (1 to ``size``) and other columns.  Only the
    histogram of lengths (``size / step`` numbers) reaches the driver, which plans patterns for
    it.  Pieces of a length class are ranked in salted groups, so no class, however common,
    lands in one task; rank ranges of a class map to pattern uses by arithmetic over a table
    whose size depends on the number of classes alone.  Equal rows are interchangeable; an
    empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("__c", F.ceil(F.col("length") / step).cast("int"))
    histogram = {r["__c"]: r["n"] for r in pieces.groupBy("__c").agg(F.count("*").alias("n")).collect()}
    rows, base, taken = [], 0, dict.fromkeys(histogram, 0)
    for pattern, uses in cutting_stock(histogram, size // step):
        for c, copies in pattern.items():
            rows.append((c, taken[c], taken[c] + copies * uses, copies, base))
            taken[c] += copies * uses
        base += uses
    slots = spark.createDataFrame(rows, "__c int, __from long, __to long, __copies long, __base long")
    salts = 16 + sum(histogram.values()) // 50_000
    pieces = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("__c", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__c").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__c", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = pieces.join(counts, ["__c", "__salt"])
    rank = F.row_number().over(Window.partitionBy("__c", "__salt").orderBy(F.desc("length"), "doc_id", "start"))
    ranked = ranked.withColumn("__rank", F.col("__before") + rank - 1)
    placed = ranked.join(F.broadcast(slots), "__c").where("__from <= __rank and __rank < __to")
    at = F.col("__rank") - F.col("__from")
    placed = placed.withColumn("sequence_id", F.col("__base") + F.floor(at / F.col("__copies")).cast("long"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("__c"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long"))
    return placed.drop("__c", "__salt", "__before", "__rank", "__from", "__to", "__copies", "__base")


def pack_documents(docs: DataFrame, tokenizer_json: str, size: int = 4096, end_id: int = 2,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of all documents (see ``token_pieces``) with their places (see ``pack``)."""
    return pack(handoff(token_pieces(docs, tokenizer_json, size, end_id, id_col, text_col, with_ids)), size)
