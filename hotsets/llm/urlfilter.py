"""URL filter from association rules that Spark's FP-growth mines, with DataFrame functions else."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotsets.llm.common import ascii_lower, handoff, quoted

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
LABELS = {"block": "label:block", "allow": "label:allow"}
#: tasks over which the rows of one token are dealt when they meet what is known of it
SALTS = 16


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], what: str) -> Column:
    """The longest of ``rules`` (verdict, host, path) that fits, as ``rule`` or its ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.lit(h + p if what == "rule" else verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, every suffix of the host, every path segment, the
    first folder, the second one with runs of digits as 9, ending, every query key, fragment.
    """
    host, path, rest = url_host(url), url_path(url), F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))
    labels = F.split(host, r"\.")
    folder = F.split(path, "/")
    second = F.coalesce(F.try_element_at(folder, F.lit(3)), F.lit(""))
    keys = F.transform(F.split(F.regexp_extract(rest, r"^\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    kinds = [
        ("scheme", F.array(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        ("host", F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))),
        ("first", F.array(F.coalesce(F.try_element_at(folder, F.lit(2)), F.lit("")))),
        ("second", F.array(F.regexp_replace(second, "[0-9]+", "9"))),
        ("segment", folder),
        ("ending", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))),
        ("query", keys),
        ("fragment", F.array(F.regexp_extract(rest, "(?s)#(.*)$", 1))),
    ]
    return F.array_distinct(F.concat(*[_tagged(k, v) for k, v in kinds]))


def _tagged(kind: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))


def _meet(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (``__id``, ``token``) joined with ``known`` on ``token``.

    A token that a third of all rows have is dealt over ``SALTS`` tasks; ``known`` has few rows a token.
    """
    salt = F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int")
    spread = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(spread, ["token", "__salt"]).drop("__salt")


def _informative(rows: DataFrame, n: int, min_count: int) -> DataFrame:
    """``token``, ``c``, ``block``: tokens that ``min_count`` rows of one verdict have, but not all rows.

    Tokens that come in exactly the same rows (a host and its folder, say) would only repeat each
    other's rules: the longest stands for them.  Rows are compared by two sums of hashes.
    """
    found = rows.select("__id", "block", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("c"), F.sum("block").alias("block"), F.bit_xor(F.xxhash64("__id")).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(7), "__id"), F.lit(1 << 31))).alias("s"))
    enough = (F.greatest(F.col("block"), F.col("c") - F.col("block")) >= min_count) & (F.col("c") < n)
    return handoff(found.where(enough).groupBy("c", "block", "x", "s").agg(F.max_by("token", F.struct(F.length("token"), "token")).alias("token")).select("token", "c", "block"))


def mine_rules(labelled: DataFrame, min_count: int = 20, min_confidence: float = 0.8, min_z: float = 3.0) -> DataFrame:
    """``items``, ``verdict``, ``confidence``, ``support`` of the rules that hold in ``labelled``.

    ``labelled``: ``tokens`` and ``verdict`` ('block' or 'allow').  Spark's FP-growth mines the token
    sets together with the label as an item; its rules with the label as their consequent are kept if
    at least ``min_count`` labelled URLs have their tokens and agree (an absolute number, the same at every
    size), a share of ``min_confidence`` agrees, and that share lies ``min_z`` standard errors above
    the verdict's share of all rows, so that labels that have nothing to do with the URL make no rules.
    A rule is pruned if a part of its tokens gives the same verdict with no less confidence.

    Three kinds of tokens do not go through FP-growth, because no longer rule could outlive the pruning:
    those that all rows have, those that only repeat another, and those whose rows agree, which
    are rules by themselves.  So the parts of one host do not multiply.  The frequent tokens that are
    left reach the driver, as Spark's FP-growth has it: each stands for ``min_count`` URLs.  An empty table,
    or one verdict alone, gives no rules.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "items array<string>, verdict string, confidence double, support double")
    rows = labelled.where(F.col("verdict").isin(*LABELS))
    rows = handoff(rows.select(F.monotonically_increasing_id().alias("__id"), F.array_distinct("tokens").alias("tokens"), (F.col("verdict") == "block").cast("long").alias("block")))
    total = rows.agg(F.count("*").alias("n"), F.sum("block").alias("block")).first()
    n, blocked = total["n"], total["block"] or 0
    if blocked in (0, n):
        return empty
    known = _informative(rows, n, min_count)
    pure = F.when(F.col("block") == 0, F.lit("allow")).when(F.col("block") == F.col("c"), F.lit("block"))
    rules = known.select(F.array("token").alias("items"), pure.alias("verdict"), F.col("c").alias("hits"), "c").where("verdict is not null")

    mixed = known.where(pure.isNull()).select("token")
    held = _meet(rows.select("__id", "block", F.explode("tokens").alias("token")), mixed)
    label = F.when(F.col("block") == 1, LABELS["block"]).otherwise(LABELS["allow"])
    baskets = handoff(held.groupBy("__id", "block").agg(F.collect_set("token").alias("items")).select(F.concat("items", F.array(label)).alias("items")))
    m = baskets.count()
    if m:
        # a share that Spark rounds up to min_count rows
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_count - 0.5) / m), minConfidence=min_confidence).fit(baskets)
        names = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (v, k)])
        mined = model.associationRules.withColumn("verdict", names[F.col("consequent")[0]]).where("verdict is not null")
        hits = F.round(F.col("support") * m)
        rules = rules.unionByName(mined.select(F.array_sort("antecedent").alias("items"), "verdict", hits.cast("long").alias("hits"),
                                               F.round(hits / F.col("confidence")).cast("long").alias("c")))
    base = F.when(F.col("verdict") == "block", blocked / n).otherwise(1 - blocked / n)
    rules = rules.withColumn("confidence", F.col("hits") / F.col("c"))
    sure = (F.col("confidence") - base) * F.sqrt(F.col("c") / (base * (1 - base))) >= min_z
    rules = handoff(rules.where((F.col("confidence") >= min_confidence) & sure).select("items", "verdict", "confidence", (F.col("hits") / n).alias("support")))
    # a rule with one token less is found by its items, not by comparing all rules
    parts = (rules.withColumn("gone", F.explode("items")).select("items", "verdict", "confidence", F.array_remove("items", F.col("gone")).alias("part"))
             .join(rules.select(F.col("items").alias("part"), "verdict", F.col("confidence").alias("shorter")), ["part", "verdict"])
             .where("shorter >= confidence").select("items", "verdict").distinct())
    return handoff(rules.join(parts, ["items", "verdict"], "left_anti").select("items", "verdict", "confidence", "support"))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with ``tokens``) with ``mined``: the verdict of the surest rule that matches.

    Rules are looked up by inverted index, each under the token that fewest rules have, and verified
    against the page's whole token set.  The surest rule has the highest confidence, then support, then
    most tokens; of rules that are equal in all that, one that blocks comes first.  NULL if none matches.
    """
    items = rules.select(F.explode("items").alias("token"), F.struct("items", "verdict").alias("id"))
    common = items.groupBy("token").agg(F.count("*").alias("n"))
    under = (items.join(common, "token").groupBy("id").agg(F.min(F.struct("n", "token")).alias("rare"))
             .select("id.items", "id.verdict", F.col("rare.token").alias("token")).join(rules, ["items", "verdict"]))
    pages = handoff(pages.withColumn("__id", F.monotonically_increasing_id()))
    rank = F.struct("confidence", "support", F.size("items").alias("n"), (F.col("verdict") == "block").alias("blocks"), "items", "verdict")
    looked = _meet(pages.select("__id", F.explode("tokens").alias("token")), under.select("token", rank.alias("rule"))).groupBy("__id").agg(F.collect_list("rule").alias("rules"))
    fits = F.filter("rules", lambda r: F.size(F.array_except(r["items"], F.col("tokens"))) == 0)
    return pages.join(looked, "__id", "left").withColumn("mined", F.array_max(fits)["verdict"]).drop("__id", "rules")


def judge_urls(pages: DataFrame, listed: list[tuple[str, str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
               label_id: str = "doc_id", label_col: str = "quality", min_count: int = 20, min_confidence: float = 0.8, min_z: float = 3.0) -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path``, ``rule``, ``verdict``, ``mined`` of every row.

    The verdict is that of the longest listed rule that fits; else that of the surest mined rule
    that matches; else 'allow'.  Rules are mined from all pages with a label: the verdict of a
    listed rule, or else the row of ``labels`` with the page's id (0: block, 1: allow;
    contradicting or NULL labels are ignored).  NULL urls, and urls without ``://``, have an
    empty host and path and no tokens; repeated rows are judged alike; an empty table gives an
    empty result; other columns, whatever their names, do not matter.
    """
    url = quoted(url_col).cast("string")
    rows = pages.select(quoted(id_col).alias("page_id"), url.alias("url"))
    rows = rows.select("*", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_tokens(F.col("url")).alias("tokens"))
    rows = rows.withColumn("rule", listed_rule(F.col("host"), F.col("path"), listed, "rule"))
    rows = handoff(rows.withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed, "verdict")))
    labelled = rows.select("page_id", "tokens", F.col("listed").alias("verdict"))
    if labels is not None:
        marks = (labels.select(quoted(label_id).alias("page_id"), quoted(label_col).cast("int").alias("y")).where("y in (0, 1)")
                 .groupBy("page_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z"))
        labelled = labelled.join(marks, "page_id", "left").withColumn("verdict", F.coalesce("verdict", F.when(F.col("y") == 0, "block").when(F.col("y") == 1, "allow")))
    judged = match_rules(rows, mine_rules(labelled.select("tokens", "verdict"), min_count, min_confidence, min_z))
    return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("listed", "mined", F.lit("allow")).alias("verdict"), "mined")
