import random
import re

from pyspark.sql import functions as F

from hotsets.llm import decontam
from tests.conftest import SF_SMALL
from tests.llm.cases import awkward, clashing, empty, plain

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        iw = words_of(item)
        for run in {tuple(iw[i:i + window]) for i in range(max(1, len(iw) - window + 1))} - {()}:
            for i in range(len(words) - len(run) + 1):
                if tuple(words[i:i + len(run)]) == run:
                    hit |= set(range(i, i + len(run)))
                    found.add(name)
    return len(words), hit, sorted(found)


def check(spark, docs, items, window, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontam.find_contamination(df, bench, window=window, **options).collect():
        n, hit, found = brute(dict(docs)[r["doc_id"]], [(str(a) if a is not None else "", b) for a, b in items], window)
        assert r["n_words"] == n and r["items"] == found
        assert {i for s in r["spans"] for i in range(s["a"], s["b"])} == hit
        assert all(x["b"] < y["a"] for x, y in zip(r["spans"], r["spans"][1:]))


def test_automaton_against_brute_force():
    rnd = random.Random(1)
    for _ in range(1500):
        letters, window = rnd.choice([2, 3, 5]), rnd.choice([2, 3, 4, 5])
        make = lambda n: [bytes([97 + rnd.randrange(letters)]) for _ in range(n)]
        items = [(i, w) for i in range(rnd.randint(1, 5)) if (w := make(rnd.randint(0, 8)))]
        doc = make(rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 2)):
            if items:
                at = rnd.randint(0, len(doc))
                doc[at:at] = rnd.choice(items)[1]
        spans, hit = decontam.SuffixAutomaton(items, window).scan(doc)
        text = b" ".join(doc).decode()
        _, want, names = brute(text, [(i, b" ".join(w).decode()) for i, w in items], window)
        assert {i for a, b in spans for i in range(a, b)} == want
        assert sorted(items[i][0] for i in hit) == names


def test_one_and_many_automata(spark):
    rnd = random.Random(5)
    vocabulary = ["Ab", "cd", "É", "9", "x-y", "Z"]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, make(rnd.randint(0, 12))) for i in range(20)] + [(3, make(6)), (None, make(7)), (30, None), (31, "...")]
    docs = [(i, make(rnd.randint(0, 20)) + rnd.choice([". ", "\n", "  "]) + (rnd.choice(items)[1] or "").upper() + " " + make(4)) for i in range(40)] + [(90, None), (91, "")]
    check(spark, docs, items, 5)
    check(spark, docs, items, 5, per_automaton=8)


def test_test_tables_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    index = {}
    for name, item in items:
        w = words_of(item)
        for i in range(max(1, len(w) - 9)):
            index.setdefault(tuple(w[i:i + 10]), set()).add(str(name))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.find_contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert any(r["spans"] for r in got.values())
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in index}:
            for i in range(len(w) - n + 1):
                if (names := index.get(tuple(w[i:i + n]))):
                    hit |= set(range(i, i + n))
                    found |= names
        assert {i for s in got[d]["spans"] for i in range(s["a"], s["b"])} == hit and got[d]["items"] == sorted(found)


def test_removal_leaves_no_window_and_keeps_clean_texts(spark):
    item = "the quick brown fox jumps over the lazy dog near a river bank"
    clean = "nothing of the kind is found here, not the quick brown fox alone"
    docs = [(1, clean), (2, "Before it. " + item.upper() + "! And " + "much more " * 20), (3, item + " the end"), (4, None), (5, "")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for size in (200_000, 4):
        out = decontam.remove_contamination(df, bench, per_automaton=size)
        assert out.columns == df.columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert got[1] == clean and got[4] is None and got[5] == "" and set(got) == {1, 2, 4, 5}
        assert got[2].startswith("Before it.") and "fox" not in got[2].lower() and got[2].count("much more") == 20
        assert decontam.find_contamination(out, bench).where("size(spans) > 0").count() == 0


def test_awkward_rows(spark):
    df, bench = clashing(awkward(spark)), spark.createDataFrame([(1, "gamma delta epsilon"), (2, None)], "item_id long, text string")
    got = decontam.find_contamination(df, bench)
    assert got.count() == df.count()
    assert plain((r["doc_id"],) for r in got.where(F.size("spans") > 0).collect()) == plain([(5,), (5,), (6,)])
    assert decontam.find_contamination(df, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontam.find_contamination(empty(spark), bench).count() == 0
    assert decontam.remove_contamination(empty(spark), bench).count() == 0
