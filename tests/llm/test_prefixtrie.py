import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from hotsets.llm import prefixtrie, queries
from hotsets.llm.ranks import ranked

ROWS = "conv_id long, turn long, role string, text string"


def trie(sequences):
    """The trie's rows, the plain way.  ``sequences``: conv -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = {}

    def visit(k):
        leaves, saved = int(not children[k]), (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        for u in children[k]:
            a, b = visit(u)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in sorted(c for c in members[k] if len(sequences[c]) == len(k)))
        parent = min(members[k[:-1]]) if k else None
        out[min(members[k]), len(k)] = (parent, len(members[k]), len(children[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if sequences:
        visit(())
    return out


def found(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def build(spark, sequences, local):
    rows = [(c, d, r, t) for c, turns in sequences.items() for d, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    digests = prefixtrie.turn_digests(spark.createDataFrame(rows, ROWS))
    ids = spark.createDataFrame([(c,) for c in sequences], "conv long")
    return found(prefixtrie.prefix_trie(digests, ids, local=local))


def random_sequences(seed, n, words, most):
    rnd = random.Random(seed)
    return {c: [(rnd.choice(["user", "assistant"]), rnd.choice(words)) for _ in range(rnd.randint(0, most))] for c in rnd.sample(range(10 * n), n)}


def test_random_tries_in_tasks_and_in_rounds(spark):
    sequences = random_sequences(2, 60, ["", "a", "é中"], 5)
    want = trie(sequences)
    assert build(spark, sequences, 1024) == want
    assert build(spark, sequences, 2) == want  # every component is split by a round over the whole table


def test_deep_chain_and_wide_star_in_rounds(spark):
    """A path of 300 turns with side branches, and 300 conversations that share their first turn."""
    deep = [("user", f"t{i}") for i in range(300)]
    sequences = {1000: deep, 2000: deep[:150] + [("user", "other")], 5: deep[:299] + [("user", "x")], 7: []}
    sequences |= {3000 + i: [("user", "hello"), ("user", f"n{i % 290}")] for i in range(300)}
    assert build(spark, sequences, 64) == trie(sequences)


def test_blocks_of_turns_and_of_ids(spark, monkeypatch):
    """Small blocks: prefixes, sizes and id lists that reach over many of them."""
    monkeypatch.setattr(prefixtrie, "BLOCK", 4)
    monkeypatch.setattr(prefixtrie, "SALTED", 8)
    deep = [("user", f"t{i}") for i in range(30)]
    sequences = {100 - c: deep[: c % 3 * 9 + 3] for c in range(40)} | {200 + c: [("user", "same")] for c in range(25)}
    assert build(spark, sequences, 8) == trie(sequences)


def test_no_conversation_and_only_empty_ones(spark):
    assert build(spark, {4: [], 3: []}, 1024) == trie({4: [], 3: []})
    none = prefixtrie.prefix_trie(prefixtrie.turn_digests(spark.createDataFrame([], ROWS)), spark.createDataFrame([], "conv long"))
    assert none.count() == 0 and none.columns[:3] == ["conv_id", "depth", "parent_conv_id"]


def test_local_rollup_equals_sums():
    rnd = random.Random(9)
    for n in [1, 2, 3, 10, 200]:
        for shape in ("any", "path", "star"):
            parent = [-1] + [{"any": rnd.randrange(i), "path": i - 1, "star": 0}[shape] for i in range(1, n)]
            values = [[rnd.randrange(9), rnd.randrange(9)] for _ in range(n)]
            want, sizes = [list(v) for v in values], [1] * n
            for v in range(n - 1, 0, -1):
                sizes[parent[v]] += sizes[v]
                want[parent[v]] = [a + b for a, b in zip(want[parent[v]], want[v])]
            assert prefixtrie.local_rollup(list(enumerate(parent)), sizes, values, [[0, 0] for _ in range(n)]) == want


def rebuilt(rows):
    """Every conversation with the beginning that its hundred shares."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        if c is None:
            out[prefixtrie.NO_ID] = turns
            continue
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def test_rebuilt_conversations_against_the_plain_way(spark):
    rnd = random.Random(11)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice([None, "", "x", "hello", "é"])) for c in [*range(95, 130), 200, 399, 777] for t in range(rnd.randint(1, 9))]
    rows += [(101, None, "user", "first"), (101, 2, "user", "b"), (101, 2, "user", "a"), (101, 2, "user", "a"), (None, 1, "user", "q"), (None, None, None, None)]
    df = spark.createDataFrame(rows, ROWS).select("*", *[F.lit("extra").alias(c) for c in ("conv", "digest", "pos", "depth", "a.b")]).repartition(5)
    want = {(None if c == prefixtrie.NO_ID else c, d): (None if p == prefixtrie.NO_ID else p, *rest) for (c, d), (p, *rest) in trie(rebuilt(rows)).items()}
    got = found(prefixtrie.prefix_trie(*queries.shared_beginnings(df)))
    assert set(got) == set(want)
    for k, v in want.items():
        # ids without a number are empty in the digest
        assert got[k][:5] == v[:5] and (got[k][5] == v[5] or k[0] is None), k


def test_ranks_over_ranges(spark):
    """A group that fills several ranges, equal rows and NULLs."""
    rows = [("hot", i // 3) for i in range(300)] + [("hot", 7)] * 50 + [(None, None), (None, 1), ("one", None), ("", 2)]
    got = ranked(spark.createDataFrame(rows, "g string, v long").repartition(7), ["g"], ["v"], rows_per_range=20).collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append((r["pos"], r["v"], r["total"], r["first"]))
    for g, found_rows in by.items():
        values = sorted((v for x, v in rows if x == g), key=lambda v: (v is not None, v or 0))
        known = [v for v in values if v is not None]
        assert sorted(found_rows, key=lambda r: r[0]) == [(i, v, len(values), known[0] if known else None) for i, v in enumerate(values)]
