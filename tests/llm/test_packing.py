import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hotsets.llm import packing
from tests.conftest import SF_SMALL
from tests.llm.cases import awkward, clashing, empty


@pytest.fixture(scope="module")
def vocabulary():
    return open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


def test_ids_equal_the_tokenizer(vocabulary):
    encode, whole = packing.WordEncoder(vocabulary), Tokenizer.from_str(vocabulary)
    rnd = random.Random(3)
    letters = "aAbZ09'’sStrevmld.,!*|<>éÉßøØÿŸŒœžŽ中Я́\x7f\x00   -_İK\n\t\r\x0b"
    texts = ["", " ", "it's I'LL don't <|endoftext|> x<|startoftext|>y", "é ́ ﬁ ΣΑΣ"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_cutting_stock_places_every_size():
    rnd = random.Random(2)
    for _ in range(25):
        room = rnd.choice([10, 64, 100])
        demand = {rnd.randint(1, room): rnd.choice([1, 7, 500]) for _ in range(rnd.randint(1, 30))}
        plan = packing.cutting_stock(demand, room)
        placed = {}
        for pattern, uses in plan:
            assert uses > 0 and sum(s * k for s, k in pattern.items()) <= room
            for s, k in pattern.items():
                placed[s] = placed.get(s, 0) + k * uses
        assert placed == demand
        least = -(-sum(s * n for s, n in demand.items()) // room)
        assert sum(u for _, u in plan) >= least
    # many pieces that fill up exactly are packed without loss
    assert sum(u for _, u in packing.cutting_stock({3: 1000, 7: 1000}, 10)) == 1000
    assert packing.cutting_stock({}, 10) == []


def test_best_pattern_against_search():
    sizes, worth = np.array([2, 3, 5]), np.array([0.3, 0.5, 0.9])
    best = max(a * 0.3 + b * 0.5 + c * 0.9 for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= 11)
    value, counts = packing.best_pattern(sizes, worth, 11)
    assert value == pytest.approx(best) and counts @ sizes <= 11 and counts @ worth == pytest.approx(best)


def holds(spark, df, packed, vocabulary, size):
    whole = Tokenizer.from_str(vocabulary)
    rows = packed.collect()
    left = sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)
    pieces = {}
    for r in rows:
        assert 1 <= r["length"] <= size
        pieces.setdefault(r["doc_id"], []).append(r)
    for d, text in left:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        starts = [r for r in pieces[d] if r["doc_tokens"] == len(ids)]
        at = 0
        while at < len(ids):
            r = next(r for r in starts if r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes()))
            pieces[d].remove(r)
            starts.remove(r)
            at += r["length"]
    assert not any(pieces.values())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return sum(r["length"] for r in rows) / (size * max(1, len(sequences)))


def test_round_trip_and_padding(spark, vocabulary):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert holds(spark, df, packing.pack_documents(df, vocabulary), vocabulary, 4096) > 0.95
    assert holds(spark, df, packing.pack_documents(df, vocabulary, size=256), vocabulary, 256) > 0.95


def test_ids_on_request(spark, vocabulary):
    df = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    rows = packing.pack_documents(df, vocabulary, with_ids=True).collect()
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert [r["ids"] for r in rows if r["doc_id"] == 2] == [[2]]


def test_awkward_rows(spark, vocabulary):
    df = clashing(awkward(spark))
    holds(spark, df, packing.pack_documents(df, vocabulary), vocabulary, 4096)
    assert packing.pack_documents(empty(spark), vocabulary).count() == 0


def test_one_length_for_all(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(1000).cast("long").alias("length"))
    out = packing.pack(pieces)
    assert out.select("sequence_id").distinct().count() == 1250 and out.groupBy("sequence_id").count().agg(F.max("count")).first()[0] == 4
