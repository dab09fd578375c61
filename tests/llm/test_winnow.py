import hashlib
import random
import re

import regex
import xxhash
from pyspark.sql import functions as F

from hotsets.llm import winnow
from tests.llm.cases import awkward, clashing, empty, plain

U = 2**64 - 1


def spark_hash(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v & U).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def brute_words(text):
    unspaced = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")
    out = []
    for run in (x for x in re.split(r"[^\w]|_", (text or "").lower()) if x):
        pieces = [""]
        for c in run:  # a character of these scripts is a word by itself
            pieces += [c, ""] if unspaced.match(c) else [pieces.pop() + c]
        for p in pieces:
            out += list(p) if len(p) > 32 else [p] * bool(p)
    return out


def brute_marks(text, k=4, w=8):
    words = brute_words(text)
    grams = [spark_hash(x) for x in words]
    if 0 < len(words) < k:
        grams = [spark_hash(" ".join(words))]
    else:
        step = 1
        while step < k:
            grams = [spark_hash(a, b) for a, b in zip(grams, grams[step:])]
            step *= 2
    grams = [g >> 33 for g in grams]
    if len(grams) < w:
        return list(enumerate(grams))
    out = []
    for i in range(len(grams) - w + 1):
        low = min(grams[i:i + w])
        at = max(j for j in range(i, i + w) if grams[j] == low)
        if not out or (at, low) not in out:
            out.append((at, low))
    return out


def test_marks_against_definition(spark):
    texts = ["", None, "one", "one two three", " ".join("abcdefghijklmnop"), "a b a b a b a b a b a b a b a b", "Été à la MER, l'été; x_y 12 ab " * 9, "." * 50,
             "数据清洗是训练语料的第一步,重复的段落要去掉。abc数12据 ラーメンを食べたい " * 2, "x" * 32 + " " + "aB3" * 11 + " é" + "q" * 33, "𠀀𠀁中"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for k, w in ((4, 8), (2, 3), (1, 5), (8, 1)):
        rows = winnow.with_marks(df, "text", "m", k, w).select("i", F.transform("m", winnow.mark_position).alias("p"), F.transform("m", winnow.mark_hash).alias("h")).collect()
        for r in rows:
            assert list(zip(r["p"], r["h"])) == brute_marks(texts[r["i"]], k, w), (k, w, texts[r["i"]])


def test_shared_passage_shares_a_mark(spark):
    passage = " ".join(f"p{i}" for i in range(11))  # gram + window - 1 words
    a = " ".join(f"a{i}" for i in range(30)) + " " + passage + " " + " ".join(f"b{i}" for i in range(30))
    b = " ".join(f"c{i}" for i in range(17)) + " " + passage + " d1 d2 d3"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = winnow.with_marks(winnow.with_marks(df, "a", "ma"), "b", "mb")
    assert df.select(winnow.likeness("ma", "mb")).first()[0] > 0


def test_edits_in_order_of_ids(spark):
    df = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    ids = sorted(texts)
    for buckets in (1, 3, 40):
        got = winnow.fingerprint_edits(clashing(df), buckets=buckets).select("*", winnow.marks_text(F.col("marks")).alias("f")).collect()
        assert plain((r["doc_id"],) for r in got) == plain((i,) for i in ids)
        for r in got:
            t, nxt = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
            q = len(t) // 4
            edited = t[:len(t) - q] + nxt[:q]
            assert r["n_chars"] == len(t) and hashlib.sha256(r["edited"].encode()).digest() == hashlib.sha256(edited.encode()).digest()
            sets = [{h for _, h in brute_marks(x)} for x in (t, edited, nxt)]
            alike = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
            if len(t) < 1000:
                assert [r["near_edited"], r["near_next"]] == alike
    same = {r["doc_id"]: r["f"] for r in got}
    assert same[5] == same[6] and same[0] == same[1] == ""


def test_repeated_and_null_ids_and_empty_table(spark):
    df = awkward(spark)
    assert winnow.fingerprint_edits(df, buckets=4).count() == df.count()
    assert winnow.fingerprint_edits(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")
    assert winnow.fingerprint_edits(one).first()["edited"] == "abcd efab"


def test_texts_without_blanks(spark):
    rnd = random.Random(2)
    chinese = "".join(chr(0x4E00 + rnd.randrange(900)) for _ in range(400))
    letters = "".join(chr(97 + rnd.randrange(26)) for _ in range(600))
    for text in (chinese, letters):
        df = spark.createDataFrame([(1, text), (2, text[:300] + "end here"), (3, "other words of a text that shares none of it")], "doc_id long, text string")
        got = {r["doc_id"]: r for r in winnow.fingerprint_edits(df).collect()}
        assert len(got[1]["marks"]) > 20 and 0.3 < got[1]["near_edited"] < 1 and 0.3 < got[1]["near_next"] < 1 and got[2]["near_next"] == 0


def test_ids_of_any_type_that_can_be_ordered(spark):
    docs = [(f"{'xé' if i % 2 else 'X'}-{i % 5}-{i}", f"text number {i}") for i in range(40)] + [(None, "no id")]
    for cast in ("string", "binary", "struct<a:string>"):
        df = spark.createDataFrame(docs, "doc_id string, text string")
        df = df.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("a")))) if "struct" in cast else df.withColumn("doc_id", F.col("doc_id").cast(cast))
        order = sorted(docs, key=lambda d: (d[0] is not None, (d[0] or "").encode()))
        following = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
        for buckets in (None, 7, 100):
            got = winnow.with_next(df, buckets=buckets).where("not __guest").collect()
            assert {r["text"]: r["next_text"] for r in got} == following and len(got) == len(docs)


def test_buckets_follow_the_bytes(spark, monkeypatch):
    df = spark.range(200).selectExpr("id AS doc_id", "repeat('ab ', 100) AS text")
    assert winnow.with_next(df).select("__bucket").distinct().count() == 1
    monkeypatch.setattr(winnow, "BUCKET_BYTES", 3000)
    assert winnow.with_next(df).select("__bucket").distinct().count() > 10
    dates = df.withColumn("doc_id", F.expr("timestamp'2024-03-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id as int))"))
    assert winnow.with_next(dates).where("not __guest").count() == 200
