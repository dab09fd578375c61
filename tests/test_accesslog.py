from pyspark.sql import functions as F

from hotsets.operators.accesslog import clean_accesses
from hotsets.operators.weekly import access_popularity
from tests.conftest import rows

RAW = ("_corrupt_record string, client_domain string, client_host string, end_time long, "
       "file_lfn string, read_bytes_at_close double, server_domain string, server_host string, "
       "server_site string, server_username string, start_time long")
DAY = 1438387200  # 2015-08-01 00:00:00 UTC


def raw_rows():
    return [
        # corrupt, cdom, host, end, file, bytes, sdom, shost, site, suser, start
        (None, "c1", "h1", DAY + 10, "f1", 100.0, "s1", "x", "S1", "", DAY),          # ok, empty user
        (None, "c1", None, DAY + 20, "f1", 50.0, "s1", "x", "S1", None, DAY),         # ok, NULL host+user
        (None, "c1", "h2", DAY, "f1", 10.0, "s1", "x", "S1", "u", DAY),               # duration 0
        (None, "c1", "h2", DAY - 5, "f1", 10.0, "s1", "x", "S1", "u", DAY),           # negative duration
        (None, "c1", "h2", DAY + 5, "f1", 0.0, "s1", "x", "S1", "u", DAY),            # bytes 0
        (None, "c1", "h2", DAY + 5, "f1", None, "s1", "x", "S1", "u", DAY),           # NULL bytes
        ("{bad", "c1", "h2", DAY + 5, "f1", 10.0, "s1", "x", "S1", "u", DAY),         # corrupt
        (None, "c2", "h3", DAY + 30, "f2", 7.0, "s1", "x", "S1", "u", DAY),           # file twice in catalog
        (None, "c2", "h3", DAY + 30, "f9", 7.0, "s1", "x", "S1", "u", DAY),           # file not in catalog
        (None, "c1", "h4", 1451606399, "f1", 1.0, "s1", "x", "S1", "u", 1451606000),  # 2015-12-31: week 53
    ]


def catalog(spark):
    return spark.createDataFrame([
        ("/A/e-v1/T", "f1", 10.0, "alice"),
        ("/B/e-v2/T", "f2", 3.0, "bob"),
        ("/B/e-v2/T", "f2", 3.0, "bob"),
    ], "dataset_name string, file_lfn string, filesize double, usernameXX string")


def test_clean_filters_and_user(spark):
    clean = clean_accesses(spark.createDataFrame(raw_rows(), RAW))
    got = rows(clean, "file_lfn", "server_username", "proctime", "readbytes", "user_protocol", "TDay")
    assert got == sorted([
        ("f1", "unknown", 10, 100.0, "xrootd", "2015/08/01"),
        ("f1", None, 20, 50.0, "xrootd", "2015/08/01"),
        ("f2", "u", 30, 7.0, "xrootd", "2015/08/01"),
        ("f9", "u", 30, 7.0, "xrootd", "2015/08/01"),
        ("f1", "u", 399, 1.0, "xrootd", "2015/12/31"),
    ], key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))


def _brute_force(raw, cat):
    """Plain-Python weekly table: inner join then group."""
    import datetime as dt
    out = {}
    for r in raw:
        corrupt, cdom, host, end, f, b, sdom, _, site, _, start = r
        if corrupt is not None or b is None or not (end - start > 0 and b > 0):
            continue
        week = dt.datetime.fromtimestamp(end, dt.timezone.utc).isocalendar()[1]
        for (name, lfn, size, user) in cat:
            if lfn != f:
                continue
            k = (week, name, cdom, user, sdom, site, "xrootd")
            a = out.setdefault(k, [0.0, 0, 0, 0.0])
            a[0] += size
            a[1] += 1 if host is not None else 0
            a[2] += end - start
            a[3] += b
    return sorted((*k, *[float(x) for x in v]) for k, v in out.items())


def test_weekly_popularity_against_brute_force(spark):
    raw = raw_rows()
    cat_rows = [tuple(r) for r in catalog(spark).collect()]
    want = _brute_force(raw, cat_rows)
    pop = access_popularity(clean_accesses(spark.createDataFrame(raw, RAW)), catalog(spark))
    got = sorted(tuple(r[c] for c in ("week", "dataset_name", "client_domain", "username", "server_domain",
                                      "server_site", "user_protocol", "dataset_size", "numaccesses",
                                      "proctime", "readbytes")) for r in pop.collect())
    assert got == want
    # the duplicated catalog key doubles the row's metrics; NULL host not counted
    pop = access_popularity(clean_accesses(spark.createDataFrame(raw, RAW)), catalog(spark))
    b = pop.filter(F.col("dataset_name") == "/B/e-v2/T").first()
    assert (b["numaccesses"], b["dataset_size"], b["readbytes"]) == (2.0, 6.0, 14.0)
    a = pop.filter((F.col("dataset_name") == "/A/e-v1/T") & (F.col("week") == 31)).first()
    assert a["numaccesses"] == 1.0 and a["dataset_size"] == 20.0
    assert pop.columns[:7] == ["week", "dataset_name", "primary_dataset", "processed_dataset",
                               "acquisition_era", "processing_version", "datatier"]


def test_shuffled_catalog_gives_the_same_table(spark):
    """The join strategy is Spark's choice by bytes and does not change the table."""
    from hotsets.plans.domain import Domain
    from hotsets.plans.output import rounded
    from tests.conftest import SF_SMALL
    d = Domain(spark, SF_SMALL)
    small = rounded(access_popularity(d.access_clean, d.file_catalog))
    large = rounded(access_popularity(d.access_clean, d.file_catalog.hint("merge")))
    assert small.count() > 0
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0


def test_file_size_once_per_group(spark):
    clean = clean_accesses(spark.createDataFrame(raw_rows(), RAW))
    faithful = access_popularity(clean, catalog(spark))
    once = access_popularity(clean, catalog(spark), file_size_once=True)
    key = (F.col("dataset_name") == "/A/e-v1/T") & (F.col("week") == 31)
    # file f1 (10 bytes) was read twice in week 31: 20 per access, 10 once
    assert faithful.filter(key).first()["dataset_size"] == 20.0
    r = once.filter(key).first()
    assert r["dataset_size"] == 10.0 and r["readbytes"] == 150.0 and r["numaccesses"] == 1.0


def test_hot_file_with_a_third_of_accesses(spark):
    """One file holds a third of all accesses: nothing is dropped, whichever
    way the catalog is joined."""
    import random
    rnd = random.Random(4)
    rows_ = []
    for i in range(3000):
        f = "hot" if i % 3 == 0 else f"f{rnd.randint(0, 200)}"
        end = DAY + rnd.randint(1, 20 * 86400)
        rows_.append((None, rnd.choice(["c1", "c2"]), f"h{i}", end, f, float(rnd.randint(1, 9)),
                      "s1", "x", rnd.choice(["S1", "S2"]), "u", end - rnd.randint(1, 500)))
    clean = clean_accesses(spark.createDataFrame(rows_, RAW))
    cat = spark.createDataFrame([(f"/D{i % 7}/e-v/T", f"f{i}", float(i), "u") for i in range(201)]
                                + [("/HOT/e-v/T", "hot", 1.5, "u")],
                                "dataset_name string, file_lfn string, filesize double, usernameXX string")
    cols = ["week", "dataset_name", "client_domain", "server_site", "numaccesses", "dataset_size", "readbytes"]
    a = sorted(tuple(r[c] for c in cols) for r in access_popularity(clean, cat).collect())
    b = sorted(tuple(r[c] for c in cols) for r in access_popularity(clean, cat.hint("merge")).collect())
    assert a == b
    assert sum(r[4] for r in a) == 3000.0
    hot = [r for r in a if r[1] == "/HOT/e-v/T"]
    assert sum(r[4] for r in hot) == 1000.0
