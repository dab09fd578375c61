import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from hotsets.llm import simhash
from hotsets.llm.components import connected_components
from tests.llm.cases import awkward, clashing, empty, plain


def brute_fingerprint(text, k=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids_fps, bits):
    parent = list(range(len(ids_fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids_fps)):
        for j in range(i):
            if bin((ids_fps[i][1] ^ ids_fps[j][1]) & (2**64 - 1)).count("1") <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(ids_fps):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def test_fingerprint_against_definition(spark):
    df = awkward(spark)
    got = simhash.fingerprints(clashing(df)).collect()
    want = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.collect()]
    assert plain((r["doc_id"], r["fp"] & (2**64 - 1)) for r in got) == plain(want)
    assert simhash.hex_fingerprint is not None
    h = spark.range(1).select(simhash.hex_fingerprint(F.lit(-1)).alias("a"), simhash.hex_fingerprint(F.lit(10)).alias("b")).first()
    assert tuple(h) == ("f" * 16, "000000000000000a")


@pytest.mark.parametrize("block", [4, 2048])
def test_links_connect_what_brute_force_connects(spark, block):
    rnd = random.Random(3)
    fps = set()
    for _ in range(25):  # chains and clusters of close fingerprints
        f = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 5, 30])):
            fps.add(f)
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                f ^= 1 << b
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.links(df, 4, block)
    for r in found.collect():
        assert bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4
    roots = {r["node"]: r["root"] for r in connected_components(found).collect()}
    want = brute_components([(s, s) for s in signed], 4)
    groups = {}
    for s in signed:
        groups.setdefault(roots.get(s, s), set()).add(s)
    wanted = {}
    for s in signed:
        wanted.setdefault(want[s], set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_a_hot_posting_is_split_by_half_bytes(spark):
    rnd = random.Random(5)
    head = rnd.getrandbits(32) << 32  # four bytes that all share: one posting holds every fingerprint
    fps = set()
    while len(fps) < 700:
        f = rnd.getrandbits(32)
        for _ in range(rnd.choice([1, 1, 2, 6])):
            fps.add(head | f)
            for b in rnd.sample(range(32), rnd.randint(1, 5)):
                f ^= 1 << b
    for bits in (4, 3):
        signed = [f - 2**64 if f >> 63 else f for f in sorted(fps)]
        found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, 4)  # 175 blocks, over the 70 sets of half bytes
        assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= bits for r in found.collect())
        roots = {r["node"]: r["root"] for r in connected_components(found).collect()}
        want = brute_components([(s, s) for s in signed], bits)
        named = {}
        for s in signed:
            named.setdefault(roots.get(s, s), set()).add(want[s])
        assert all(len(x) == 1 for x in named.values()) and len(named) == len(set(want.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_ids_on_awkward_rows(spark):
    df = awkward(spark)
    got = simhash.simhash_components(clashing(df)).collect()
    named = [(r["doc_id"], r["fp"]) for r in got if r["doc_id"] is not None]
    want = brute_components(named, 4)
    assert len(got) == df.count()
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    df = clashing(awkward(spark))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 0, 1, 2 and 11 have no words; 6 is a copy of 5, whose repeated row is the same document
    assert 0 in ids and not {1, 2, 6, 11} & set(ids) and ids.count(5) == 2 and ids.count(None) == 2
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0
