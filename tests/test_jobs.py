from hotsets.operators.weekly import jobs_popularity, popularity_union
from hotsets.schemas import POPULARITY_COLUMNS

JOBS = ("FinishedTimeStamp long, InputCollection string, TargetCE string, SiteName string, "
        "ProtocolUsed string, GridName string, WrapCPU double, WrapWC double")
# 2015-08-02 23:59:59.999 UTC (Sunday, ISO week 31) and one ms later (week 32)
T0, T1 = 1438559999999, 1438560000000


def test_jobs_weekly_counts_and_nulls(spark):
    jobs = spark.createDataFrame([
        (T0, "/P/era-v1/AOD", "ce1", "S1", "remote", "u1", 1.0, 2.0),
        (T0, "/P/era-v1/AOD", "ce1", "S1", "remote", "u1", 3.0, 4.0),
        (T1, "/P/era-v1/AOD", "ce1", "S1", "remote", "u1", 5.0, 6.0),
        (T0, None, "ce1", "S1", "remote", "u1", 7.0, 8.0),   # no dataset: counted as 0 accesses
    ], JOBS)
    pop = jobs_popularity(jobs)
    assert pop.columns == POPULARITY_COLUMNS
    got = {(r["week"], r["dataset_name"]): (r["numaccesses"], r["proctime"], r["readbytes"],
                                            r["dataset_size"], r["server_domain"], r["acquisition_era"])
           for r in pop.collect()}
    assert got[(31, "/P/era-v1/AOD")] == (2.0, 4.0, 6.0, 0.0, "cern.ch", "era")
    assert got[(32, "/P/era-v1/AOD")] == (1.0, 5.0, 6.0, 0.0, "cern.ch", "era")
    assert got[(31, None)] == (0.0, 7.0, 8.0, 0.0, "cern.ch", None)


def test_union_keeps_both_sources(spark):
    jobs = spark.createDataFrame([(T0, "/P/e-v/T", "c", "S", "p", "u", 1.0, 1.0)], JOBS)
    jp = jobs_popularity(jobs)
    u = popularity_union(jp, jp)
    assert u.count() == 2 and sorted(r[0] for r in u.select("source").collect()) == ["crab", "xrootd"]
