import re

from pyspark.sql import functions as F

from hotsets.llm import licenses
from tests.conftest import SF_MID
from tests.llm.cases import awkward, clashing, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_places(words):
    out = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return sorted(out)


def test_places_on_the_test_table(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    texts = {r["doc_id"]: words_of(r["text"]) for r in docs.collect()}
    some = 0
    for r in licenses.scan_licenses(docs).collect():
        words = texts[r["doc_id"]]
        assert r["n_words"] == len(words)
        assert sorted((p["start"], p["label"]) for p in r["places"]) == brute_places(words)
        some += len(r["places"])
        for f in r["found"]:  # every finding's mandatory phrase stands in its place
            assert any(label == f["label"] and words[f["start"] + licenses._offset(t):][:len(phrase.split())] == phrase.split()
                       for t, (label, _, phrase) in enumerate(licenses.TEMPLATES))
        assert {p["label"] for p in r["places"]} <= {f["label"] for f in r["found"]}
    assert some > 10


def test_templates_are_found_where_they_stand(spark):
    pad = " lorem ipsum" * 40
    docs = [(t, pad + " " + words.upper() + "." + pad) for t, (_, words, _) in enumerate(licenses.TEMPLATES)]
    docs += [(100 + t, pad + " " + " x ".join(words.split()) + pad) for t, (_, words, _) in enumerate(licenses.TEMPLATES)]  # words apart
    docs += [(200, " ".join(words for _, words, _ in licenses.TEMPLATES)), (201, "mit mit license mit license license"), (202, "cc\u0130by cc by cc-by")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for t, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert (label, 80, 1.0) in {(f["label"], f["start"], f["share"]) for f in got[t]["found"]}, label
        if len(licenses.TEMPLATES[t][2].split()) > 1:
            assert not got[100 + t]["found"]
    assert {f["label"] for f in got[200]["found"]} == {x[0] for x in licenses.TEMPLATES}
    assert [p["start"] for p in got[201]["places"]] == [1, 3]
    assert [p["start"] for p in got[202]["places"]] == [1, 3]


def test_mandatory_phrases_as_first_words(spark):
    pad = " lorem ipsum" * 40
    docs = []
    for t, (_, words, phrase) in enumerate(licenses.TEMPLATES):
        rest = " ".join(words.split()[licenses._offset(t):])
        docs += [(t, phrase.title() + pad + " licensed"), (100 + t, pad + " " + phrase + pad + " licensed"), (200 + t, rest + pad), (300 + t, pad + " " + rest + pad)]
    docs += [(400, "Apache License, Version 2.0"), (401, "license version 2.0 apache")]
    got = {r["doc_id"]: {(f["label"], f["start"]) for f in r["found"]} for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for t, (label, _, _) in enumerate(licenses.TEMPLATES):
        at = licenses._offset(t)
        for first, later in ((t, 100 + t), (200 + t, 300 + t)):  # what is found later is found at the start
            assert (label, -at) in got[first] or (label, 80 - at) not in got[later], label
        if label in ("apache-2.0", "gpl-2.0", "gpl-3.0", "mpl-2.0", "cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "unlicense") and at < 6:
            assert (label, -at) in got[200 + t], label
    assert ("apache-2.0", -3) in got[400] and "apache-2.0" not in {f for f, _ in got[401]}


def test_common_words_are_no_postings():
    everywhere = {"by": 400, "mit": 30, "license": 60, "cc": 2, "general": 1000, "public": 1000, "gnu": 1000}
    chosen = {}
    for w, t, _, _ in licenses._index(everywhere, 1000, 3, 0.05):
        chosen.setdefault(licenses.TEMPLATES[t][1], set()).add(w)
    assert chosen["cc by"] == {"cc"} and chosen["mit license"] == {"mit"}
    # a template of common words only keeps the rarest of its phrase
    assert chosen["gnu general public license"] == {"license"}
    assert all(chosen[words] & set(phrase.split()) for _, words, phrase in licenses.TEMPLATES)


def test_labels_do_not_depend_on_how_common_a_word_is(spark):
    docs = [(t, f"x{t} y " + words + " z") for t, (_, words, _) in enumerate(licenses.TEMPLATES)]
    docs += [(100 + i, "by the license of all, and general public words") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [{r["doc_id"]: {f["label"] for f in r["found"]} for r in licenses.scan_licenses(df, common=c).collect()} for c in (1.0, 0.05, 0.0)]
    for t, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert all(label in g[t] for g in got), label
    assert not any(g[100] for g in got)


def test_awkward_rows(spark):
    df = clashing(awkward(spark))
    got = licenses.scan_licenses(df)
    assert got.count() == df.count() and got.where(F.size("places") > 0).count() == 0
    assert {r["n_words"] for r in got.where("doc_id in (0, 1, 2, 11)").collect()} == {0}
    assert licenses.scan_licenses(empty(spark)).count() == 0
