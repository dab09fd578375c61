import itertools
import random
import re

from pyspark.sql import functions as F

from hotsets.llm import urlfilter
from hotsets.llm.queries import URL_RULES
from tests.conftest import SF_MID


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host):])[0]


def brute_rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "://", "a://B.ORG", "a://b.org/", "http://x.EXAMPLE.org/es/1?q#f", "http://example.org/es", "http://example.org/es/",
        "http://notexample.org/es/", "https://com/de/", "https://a.com/de", "http://a.com?x=/de/", "http://a.com#/de/", "http://a.com/fr/a/b.html?x=1&y=2#z",
        "http://a.net/1\n2", "HTTP://É.net/ñ", "x http://q.org/", "http://a.org://b.com/de/", "http://example.org/en/1", "http://example.org/en/12/3"]


def test_hosts_paths_and_listed_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(1, URLS[5]), (None, URLS[6])], "page_id long, url string").select("*", F.lit(1).alias("host"), F.lit(2).alias("rule"), F.lit(3).alias("tokens"))
    got = urlfilter.judge_urls(pages, URL_RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path = brute_parts(r["url"])
        rule, verdict = brute_rule(host, path, URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"]
        if rule:
            assert r["verdict"] == verdict
    assert urlfilter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def brute_rules(rows, least, confidence, z):
    """All rules tokens -> verdict by counting every combination."""
    n, found = len(rows), {}
    for size in range(1, 7):
        for combo in {c for t, _ in rows for c in itertools.combinations(sorted(t), size)}:
            have = [v for t, v in rows if set(combo) <= set(t)]
            for v in ("allow", "block"):
                hits, base = have.count(v), sum(x == v for _, x in rows) / n
                if hits >= least and hits >= confidence * len(have) and (hits / len(have) - base) * (len(have) / (base * (1 - base))) ** 0.5 >= z:
                    found[combo, v] = (hits / len(have), hits / n)
    return {k: x for k, x in found.items()
            if not any((tuple(y for y in k[0] if y != gone), k[1]) in found and found[tuple(y for y in k[0] if y != gone), k[1]][0] >= x[0] for gone in k[0])}


def test_mined_rules_and_matches_against_counting(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        tokens = ["scheme:http", f"top:{rnd.choice('ab')}", f"first:{rnd.choice('xyz')}"] + ["query:q"] * rnd.randint(0, 1) + ["host:pure"] * (i % 40 == 0)
        bad = ("top:a" in tokens and "first:x" in tokens) or rnd.random() < 0.1 or "host:pure" in tokens
        rows.append((tokens, "block" if bad else "allow"))
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(rows)], "page_id long, tokens array<string>, verdict string")
    rules = urlfilter.mine_rules(df, min_count=8, min_confidence=0.6, min_z=2.0)
    got = {(tuple(r["items"]), r["verdict"]): (r["confidence"], r["support"]) for r in rules.collect()}
    want = brute_rules(rows, 8, 0.6, 2.0)
    assert got.keys() == want.keys() and (("first:x", "top:a"), "block") in got and (("host:pure",), "block") in got
    for k in got:
        assert abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9
    for r in urlfilter.match_rules(df, rules).collect():
        fits = [(c, s, len(k), v == "block", list(k), v) for (k, v), (c, s) in got.items() if set(k) <= set(r["tokens"])]
        assert r["mined"] == (max(fits)[-1] if fits else None)


def test_of_equally_sure_rules_the_blocking_one_decides(spark):
    rules = spark.createDataFrame([(["a"], "allow", 0.9, 0.1), (["b"], "block", 0.9, 0.1), (["c"], "allow", 0.9, 0.2), (["a", "d"], "allow", 0.9, 0.1)],
                                  "items array<string>, verdict string, confidence double, support double")
    pages = [(["a", "b"], "block"), (["a", "b", "c"], "allow"), (["a", "b", "d"], "allow"), (["a"], "allow"), (["b", "d"], "block"), (["d"], None), ([], None)]
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(pages * 3)], "page_id long, tokens array<string>, want string")
    got = urlfilter.match_rules(df, rules).collect()
    assert len(got) == 3 * len(pages) and all(r["mined"] == r["want"] for r in got)


def test_labels_that_say_nothing_make_no_rules(spark):
    rows = spark.range(5000).select(F.array(F.lit("scheme:http"), F.concat(F.lit("host:h"), F.col("id") % 40), F.concat(F.lit("first:f"), F.col("id") % 7)).alias("tokens"),
                                    F.when(F.xxhash64("id") % 6 == 0, "block").otherwise("allow").alias("verdict"))
    assert urlfilter.mine_rules(rows).count() == 0
    assert urlfilter.mine_rules(rows.withColumn("verdict", F.lit("allow"))).count() == 0
    assert urlfilter.mine_rules(rows.limit(0)).count() == 0


def test_awkward_urls_and_clashing_columns(spark):
    longest = "http://long.example.com/" + "/".join(f"s{i}" for i in range(3000)) + "?" + "&".join(f"k{i}=1" for i in range(3000))
    rows = [(i, u) for i, u in enumerate([None, "", longest, longest, "http://a.b/c"] * 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit("extra").alias(c) for c in ("tokens", "token", "__id", "c", "items", "block", "a.b")])
    marks = spark.createDataFrame([(i, int(u != longest)) for i, u in rows], "doc_id long, quality int")
    got = urlfilter.judge_urls(pages, [], marks, min_count=3).collect()
    assert len(got) == 30 and all(r["verdict"] == ("block" if r["url"] == longest else "allow") for r in got)
    assert urlfilter.judge_urls(pages.limit(0), [], marks).count() == 0 and urlfilter.judge_urls(pages, [], marks.limit(0)).where("verdict = 'allow'").count() == 30


def test_labels_teach_unlisted_urls(spark):
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet")
    marks = pages.select(F.col("page_id").alias("doc_id"), F.when(F.col("url").contains("/es/"), 0).otherwise(1).alias("quality"))
    got = urlfilter.judge_urls(pages, [], marks).collect()
    assert all(r["verdict"] == ("block" if "/es/" in r["url"] else "allow") for r in got)


def test_every_part_of_a_url_can_make_a_rule(spark):
    parts = ["http://bad.x.y.example.net/a/b", "http://h.net/a/b/c/bad/e", "http://h.net/a/b/bad.html", "http://h.net/a?x=1&y=2&bad=3", "http://h.net/a/abcdefgh-bad/c"]
    good = ["http://ok.x.y.example.net/a/b", "http://h.net/a/b/c/ok/e", "http://h.net/a/b/ok.html", "http://h.net/a?x=1&y=2&ok=3", "http://h.net/a/abcdefgh-ok/c"]
    urls = [u for u in parts + good for _ in range(6)]
    extra = parts + good  # without a label
    pages = spark.createDataFrame(list(enumerate(urls + extra)), "page_id long, url string")
    marks = spark.createDataFrame([(i, 0 if "bad" in u else 1) for i, u in enumerate(urls)], "doc_id long, quality int")
    got = urlfilter.judge_urls(pages, [], marks, min_count=3, min_z=2.0).collect()
    assert len(got) == len(urls) + len(extra)
    assert all(r["verdict"] == ("block" if "bad" in r["url"] else "allow") and r["mined"] for r in got)


def test_a_small_share_of_many_labels_makes_a_rule(spark):
    few = spark.range(30).select(F.array(F.lit("scheme:http"), F.lit("host:rare")).alias("tokens"), F.lit("block").alias("verdict"))
    many = spark.range(20000).select(F.array(F.lit("scheme:http"), F.concat(F.lit("host:"), F.col("id") % 7)).alias("tokens"), F.lit("allow").alias("verdict"))
    rules = {(tuple(r["items"]), r["verdict"]): r["confidence"] for r in urlfilter.mine_rules(few.union(many)).collect()}
    assert rules == {(("host:rare",), "block"): 1.0}  # 'allow' is what nearly all rows have: no host says more


def test_long_urls_do_not_multiply(spark):
    tokens = F.array(*[F.lit(f"query:k{i}") for i in range(40)])
    rows = spark.range(200).select(F.concat(tokens, F.array(F.concat(F.lit("host:"), F.col("id") % 2))).alias("tokens"), F.when(F.col("id") % 4 == 0, "block").otherwise("allow").alias("verdict"))
    assert urlfilter.mine_rules(rows).where(F.size("items") > 1).count() == 0
