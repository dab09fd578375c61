import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hotsets.llm import merkle, queries
from tests.llm.cases import DOCS, awkward, clashing, empty

ROWS = "id long, group string, leaf string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, arity):
    """Root and proofs (list of (left, right) by level), the plain way."""
    proofs, at, run = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(run) > 1:
        for i, a in enumerate(at):
            start = a - a % arity
            proofs[i].append((run[start:a], run[a + 1:start + arity]))
        run = [sha("".join(run[i:i + arity])) for i in range(0, len(run), arity)]
        at = [a // arity for a in at]
    return run[0], proofs


def manifest(rows, arity):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: (sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))) for g in order}
    trees = {g: tree([r[2] for r in made[g]], arity) for g in order}
    root, above = tree([trees[g][0] for g in order], arity)
    return sorted(((r[0], r[1], r[2], trees[g][0], root, trees[g][1][i] + above[k]) for k, g in enumerate(order) for i, r in enumerate(made[g])), key=repr)


def found(df):
    return sorted(((r["id"], r["group"], r["leaf"], r["subroot"], r["root"], [([bytes(x).hex() for x in p["left"]], [bytes(x).hex() for x in p["right"]]) for p in r["proof"]])
                   for r in df.collect()), key=repr)


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_against_the_plain_way(spark, arity):
    rnd = random.Random(arity)
    sizes = {"en": 150, "de": 1, None: 2, "": 33, "é": 7, "z" * 40: 64}
    rows = [(rnd.choice([None, 5, i, i, i]), g, sha(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    rows += [(9, "en", sha("same"))] * 3  # repeated rows are leaves of their own
    rnd.shuffle(rows)
    got = merkle.dataset_manifest(spark.createDataFrame(rows, ROWS).repartition(5), arity)
    assert found(got) == manifest(rows, arity)
    folded = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof")))
    assert folded.where("folded != root").count() == 0
    other = got.withColumn("folded", merkle.fold(F.lit(sha("other")), F.col("proof")))
    assert other.where("folded = root").count() == 0


def test_one_group_and_one_row_and_none(spark):
    rows = [(i, "en", sha(str(i))) for i in range(70)]
    assert found(merkle.dataset_manifest(spark.createDataFrame(rows, ROWS))) == manifest(rows, 2)
    assert found(merkle.dataset_manifest(spark.createDataFrame(rows[:1], ROWS))) == manifest(rows[:1], 2)
    none = merkle.dataset_manifest(spark.createDataFrame([], ROWS))
    assert none.count() == 0 and none.columns == ["id", "group", "leaf", "subroot", "root", "proof"]
    with pytest.raises(ValueError):
        merkle.dataset_manifest(none, arity=1)


def encoded(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def test_query_on_awkward_rows(spark, tmp_path):
    """Changed rows are found, all others verify; whatever the texts, and with other columns about."""
    docs = awkward(spark).union(spark.createDataFrame([(100 + i, f"t{i}", "de" if i % 3 else None, "s", i) for i in range(40)], DOCS))
    for n, df in enumerate((docs, clashing(docs), empty(spark))):
        df.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got = queries.op13_merkle(spark, f"{tmp_path}/{n}").collect()
        rows = [(r["doc_id"], r["lang"], encoded(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]), r["n_chars"]) for r in df.collect()]
        want = manifest([r[:3] for r in rows], 2) if rows else []
        proofs = sorted((i, leaf, sub, root, sha("".join("".join(a + b) for a, b in p))) if i is not None else (-1, leaf, sub, root, sha("".join("".join(a + b) for a, b in p)))
                        for i, _, leaf, sub, root, p in want)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == proofs
        chars = {r[2]: r[3] for r in rows}
        for r in got:
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and chars[r["leaf"]] is not None
            assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
