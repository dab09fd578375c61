"""Quality rules judged by document and by host, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotsets.llm.common import handoff, quoted

BLANKS = r"\x20\x09-\x0D"
SYMBOL = "[#*$%&|<>]"
WINDOW = 5

#: a document breaks a rule if its condition holds; the first two also reject the document itself
OWN_RULES = {
    "few_words": lambda: F.col("n_words") < 10,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
}
HOST_RULES = {
    **OWN_RULES,
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("word_chars"),
    "repeated_lines": lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
}


@dataclass(frozen=True)
class BetaPrior:
    """Beta prior of a rule's failure rate: its mean and its weight in documents (None: no host
    differs from the mean by more than chance, so every host has the mean)."""

    mean: float
    weight: float | None

    def shrunk(self, failed: Column, n: Column) -> Column:
        if self.weight is None:
            return F.lit(self.mean)
        return (failed + F.lit(self.mean * self.weight)) / (n + F.lit(self.weight))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``host``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``,
    ``n_repeat_words``, one row per input row.

    Words are runs of other characters than blank, tab, line feed, vertical tab, form feed and
    carriage return; ``word_chars`` counts their code points, ``n_symbols`` the characters
    ``#*$%&|<>``.  ``n_lines`` counts lines with a word, ``n_dup_lines`` those equal to an earlier
    line.  ``n_repeat_words`` counts the words inside any run of five words that the text has
    twice or more, the first included; runs are compared by a 64-bit hash of hashes of their
    words.  NULL text has no words.  The whole text is used: the work is linear in it, but
    for texts that do repeat a run, whose runs are sorted; one text must fit a task.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    df = docs.select(quoted(id_col).alias("doc_id"), quoted(host_col).cast("string").alias("host"), text.alias("text"))
    df = df.withColumns({
        "n_symbols": (F.size(F.split("text", SYMBOL)) - 1).cast("long"),
        "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{BLANKS}]")),
        "run": F.array_remove(F.split("text", f"[{BLANKS}]+"), ""),
    }).drop("text")
    df = df.withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_words": F.size("run").cast("long"),
        "word_chars": F.length(F.array_join("run", "")).cast("long"),
        "run": F.transform("run", lambda w: F.xxhash64(w)),
    }).drop("lines")
    # runs of 2, then 4, then 5 words: each from two runs that overlap or meet
    for step in (1, 2, 1):
        rest = F.greatest(F.size("run") - step, F.lit(0))
        df = df.withColumn("run", F.zip_with(F.slice("run", F.lit(1), rest), F.slice("run", F.lit(step + 1), rest), lambda a, b: F.xxhash64(a, b)))
    placed = F.sort_array(F.transform("run", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(F.size(F.array_distinct("run")) < F.size("run"), placed)).drop("run")
    # equal runs are neighbours now; both their places count
    both = F.zip_with(F.slice("placed", F.lit(1), F.size("placed") - 1), F.slice("placed", F.lit(2), F.size("placed") - 1),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("places", F.when(F.col("placed").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull())))))).drop("placed")
    covered = F.aggregate("places", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                          lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def failures_by_host(stats: DataFrame, rules=HOST_RULES) -> DataFrame:
    """``host``, ``n`` and, for every rule, how many of the host's documents break it (``f_<rule>``).

    Combined before the shuffle, so a host with a third of all documents costs a row per task.
    Documents without a host (NULL) belong to none.
    """
    return stats.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(rule()).alias(f"f_{name}") for name, rule in rules.items()])


def beta_priors(hosts: DataFrame, rules=HOST_RULES) -> dict[str, BetaPrior]:
    """The beta prior of each rule's failure rate, fitted to all hosts by moments.

    The spread of the hosts' rates beyond what chance gives (analysis of variance with unequal
    sizes) is the intra-host correlation r; the prior weighs (1 - r) / r documents.  One row of
    sums reaches the driver.
    """
    n = F.col("n").cast("double")
    sums = [F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("nn")]
    for name in rules:
        f = F.col(f"f_{name}").cast("double")
        sums += [F.sum(f).alias(f"f_{name}"), F.sum(f * f / n).alias(f"ff_{name}")]
    s = hosts.agg(*sums).first()
    out = {}
    for name in rules:
        if not s["n"]:
            out[name] = BetaPrior(0.0, None)
            continue
        mean = s[f"f_{name}"] / s["n"]
        chance, room = mean * (1 - mean), s["n"] - s["nn"] / s["n"] - (s["hosts"] - 1)
        spread = s[f"ff_{name}"] - s["n"] * mean * mean
        r = min(1.0, (spread / chance - (s["hosts"] - 1)) / room) if chance > 0 and room > 0 else 0.0
        out[name] = BetaPrior(mean, (1 - r) / r if r > 1e-9 else None)
    return out


def host_verdicts(hosts: DataFrame, priors: dict[str, BetaPrior], max_rate: float = 0.5) -> DataFrame:
    """``host``, ``n``, ``rates`` (rule to shrunk failure rate), ``blocked`` (a rate above ``max_rate``)."""
    rates = {name: prior.shrunk(F.col(f"f_{name}"), F.col("n")) for name, prior in priors.items()}
    as_map = F.create_map(*[c for name, rate in rates.items() for c in (F.lit(name), rate)])
    return hosts.select("host", "n", as_map.alias("rates"), (F.greatest(*rates.values(), F.lit(0.0)) > max_rate).alias("blocked"))


#: hosts with this share of all documents or more are joined by broadcast: there are at most 1 / share
LARGE_SHARE = 0.001


def judge_documents(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_rate: float = 0.5) -> DataFrame:
    """The statistics of every document, ``base_failed``, ``host_rates``, ``host_blocked`` and ``kept``.

    A document fails by itself if it has fewer than 10 words or over 20 % of its words lie in
    repeated runs of five.  Failures of all rules are added up by host; a host's rates are
    shrunk towards those of all hosts by a beta prior fitted to the table, so that a host of a few
    documents is not judged by chance, and a host with a rate above ``max_rate`` is blocked.
    Kept is what neither fails nor comes from a blocked host.  One row per input row, repeated
    rows included; rows without a host (NULL) are judged by themselves alone; NULL and empty
    texts have no words and fail; an empty table gives an empty result; other columns, whatever
    their names, do not matter.  Texts are read once; what is joined are a few numbers a document.
    """
    stats = handoff(document_statistics(docs, id_col, host_col, text_col))
    hosts = handoff(failures_by_host(stats))
    verdicts = host_verdicts(hosts, beta_priors(hosts), max_rate)
    total = hosts.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") >= F.lit(LARGE_SHARE * total)
    # at most 1 / LARGE_SHARE hosts are that large: a proven bound for the broadcast.  The rest
    # have so few documents each that a shuffle by host deals them out evenly.
    known = stats.join(F.broadcast(verdicts.where(large).select("host", F.col("rates").alias("host_rates"), "blocked")), "host", "left")
    rest = stats.join(F.broadcast(verdicts.where(large).select("host")), "host", "left_anti").where("host is not null")
    rest = rest.join(verdicts.where(~large).select("host", F.col("rates").alias("host_rates"), "blocked"), "host", "left")
    both = known.where("host is null or blocked is not null").unionByName(rest)
    own = F.lit(False)
    for rule in OWN_RULES.values():
        own = own | rule()
    both = both.withColumn("base_failed", own).withColumn("host_blocked", F.coalesce("blocked", F.lit(False)))
    return both.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed",
                       "host_rates", "host_blocked", (~F.col("base_failed") & ~F.col("host_blocked")).alias("kept"))
