"""Document fingerprints by winnowing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotsets.llm.common import quoted

#: a mark packs 31 bits of gram hash above 31 bits of inverted position
_POS = (1 << 31) - 1
#: bytes of text in a bucket of the order of documents, and how many buckets there are at most (an
#: id of each reaches the driver): 100 TB make buckets of 2 GB, which tasks sort with spilling
BUCKET_BYTES = 4 << 20
MOST_BUCKETS = 50_000
#: scripts written without blanks, where a character counts as a word
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
_SEAM = rf"(?<=[{_UNSPACED}])(?=[^ ])|(?<=[^ ])(?=[{_UNSPACED}])"
#: a run of more letters and digits is no word of any language: its characters count as words
LONG_WORD = 32


def _doubling(df: DataFrame, column: str, width: int, join) -> DataFrame:
    """Every position's value joined over ``width`` positions from there, in log2(width) passes.

    ``join(a, b)`` combines a run with the run that follows it (for a minimum the runs may
    overlap; for the gram hash ``width`` is built from runs that do not).
    """
    done = 1
    while done < width:
        step = min(done, width - done)
        rest = F.greatest(F.size(column) - step, F.lit(0))
        df = df.withColumn(column, F.zip_with(F.slice(F.col(column), F.lit(1), rest), F.slice(F.col(column), F.lit(step + 1), rest), join))
        done += step
    return df


def with_marks(df: DataFrame, text_col: str, out_col: str, gram: int = 4, window: int = 8) -> DataFrame:
    """``df`` with ``out_col``: the winnowing marks of ``text_col``, packed longs by position.

    Words are runs of letters and digits, lower-cased; in scripts without blanks, and in runs of
    more than ``LONG_WORD``, every character is a word.  A gram is ``gram`` consecutive words
    (``gram`` must be a power of two, so that its hash is built from halves); a text of fewer
    words is one gram.  Of every ``window`` consecutive grams the one with the smallest hash is
    marked, the rightmost of equals; a text of fewer grams than a window marks every gram.  Two
    texts that share ``gram + window - 1`` words in a row share a mark.  NULL, empty or wordless
    text: no marks.  ``mark_position`` and ``mark_hash`` read a mark.  The cost is linear in the
    text: each gram and each window is built from its halves.
    """
    if gram & (gram - 1) or gram < 1 or window < 1:
        raise ValueError("gram must be a power of two and window positive")
    words, n, one = f"__{out_col}_words", f"__{out_col}_n", f"__{out_col}_one"
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    df = df.withColumn(words, clean)
    # only a text with letters beyond ASCII is searched for such scripts
    df = df.withColumn(words, F.when(F.octet_length(words) == F.length(words), F.col(words)).otherwise(F.regexp_replace(words, _SEAM, " ")))
    df = df.withColumn(one, F.xxhash64(F.col(words)))
    df = df.withColumn(words, F.when(F.col(words) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(words), " ")))
    cut = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))
    df = df.withColumn(words, F.when(F.exists(words, lambda w: F.length(w) > LONG_WORD), cut).otherwise(F.col(words)))
    df = df.withColumn(n, F.size(words)).withColumn(words, F.transform(words, lambda w: F.xxhash64(w)))
    df = _doubling(df, words, gram, lambda a, b: F.xxhash64(a, b))
    # a text shorter than a gram is one gram
    df = df.withColumn(words, F.when((F.col(n) > 0) & (F.col(n) < gram), F.array(one)).otherwise(F.col(words)))
    packed = F.transform(words, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 33), 31).bitwiseOR(F.lit(_POS) - i))
    df = df.withColumn(words, packed).withColumn(one, F.size(words) < window)
    marked = df.withColumn(out_col, F.col(words))
    marked = _doubling(marked, out_col, window, lambda a, b: F.least(a, b))
    return (marked.withColumn(out_col, F.when(F.col(one), F.col(words)).otherwise(F.array_distinct(out_col)))
            .drop(words, n, one))


def mark_hash(mark: Column) -> Column:
    return F.shiftright(mark, 31)


def mark_position(mark: Column) -> Column:
    return F.lit(_POS) - mark.bitwiseAND(F.lit(_POS))


def marks_text(marks: Column) -> Column:
    """Marks as a string: ``hash:position`` in hexadecimal, in text order, blank-separated."""
    return F.array_join(F.transform(marks, lambda m: F.concat(F.lower(F.hex(mark_hash(m))), F.lit(":"), F.lower(F.hex(mark_position(m))))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of the mark hashes of two columns; two without marks are alike."""
    x, y = F.transform(a, mark_hash), F.transform(b, mark_hash)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``doc_id``, ``text``, ``next_text`` in ascending doc_id, the last one followed by the first;
    also ``__bucket``, ``__wrap`` and ``__guest`` for ``next_value``.

    The order is cut into buckets of about ``BUCKET_BYTES`` at ids that Spark's range partitioning
    of the ids gives (one id per bucket reaches the driver), so no task orders the whole table.
    A bucket also receives the row that opens the next one (marked ``__guest``), which is all
    that a successor needs.  Ids are of any type that Spark can order.  NULL ids come first;
    rows with equal ids follow each other by text, within one bucket; NULL text counts as empty.
    """
    src = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType
    spark = src.sparkSession
    seen = src.agg(F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"), F.sum(F.octet_length("text")).alias("bytes")).first()
    least = None if seen["nulls"] else seen["least"]
    parts = buckets or max(1, min(MOST_BUCKETS, -(-(seen["bytes"] or 0) // BUCKET_BYTES)))
    ranges = src.select("doc_id").where("doc_id is not null").repartitionByRange(parts, "doc_id").withColumn("range", F.spark_partition_id())
    firsts = ranges.groupBy("range").agg(F.min("doc_id").alias("first")).collect()  # one row per bucket
    cuts = [r["first"] for r in sorted(firsts, key=lambda r: r["range"])]
    cuts = cuts if seen["nulls"] else cuts[1:]  # cuts[i] opens bucket i + 1; what lies below the first is bucket 0
    # the cuts of one bucket in `wide`, so that looking an id up takes two short searches
    wide = max(1, int(len(cuts) ** 0.5))
    folded = [cuts[i:i + wide] for i in range(0, len(cuts), wide)]
    one = spark.createDataFrame([([c[0] for c in folded], folded)], f"heads array<{kind.simpleString()}>, cuts array<array<{kind.simpleString()}>>")
    src = src.withColumns({"__heads": one.select("heads").scalar(), "__folded": one.select("cuts").scalar()})

    def below(c: Column) -> Column:
        return F.size(F.filter(c, lambda x: x <= F.col("doc_id")))

    rows = src.withColumn("__row", F.greatest(below(F.col("__heads")) - 1, F.lit(0)))
    rows = rows.withColumn("__cuts", F.coalesce(F.get("__folded", F.col("__row")), F.array().cast(f"array<{kind.simpleString()}>")))
    rows = rows.withColumn("__at", F.when(F.col("doc_id").isNull(), 0).otherwise(below(F.col("__cuts"))))
    own = F.col("__row") * wide + F.col("__at")
    opens = F.coalesce(F.get("__cuts", F.col("__at") - 1) == F.col("doc_id"), F.lit(False))
    opens_all = F.col("doc_id").eqNullSafe(F.lit(least).cast(kind))
    home = F.struct(own.alias("bucket"), F.lit(0).alias("wrap"), F.lit(False).alias("guest"))
    before = F.struct((own - 1).alias("bucket"), F.lit(0).alias("wrap"), F.lit(True).alias("guest"))
    around = F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(1).alias("wrap"), F.lit(True).alias("guest"))
    places = F.filter(F.array(home, F.when(opens, before), F.when(opens_all, around)), lambda p: p.isNotNull())
    rows = rows.withColumn("__p", F.explode(places))
    rows = rows.select("doc_id", "text", F.col("__p.bucket").alias("__bucket"), F.col("__p.wrap").alias("__wrap"), F.col("__p.guest").alias("__guest"))
    return rows.withColumn("next_text", next_value("text"))


def next_value(column: str) -> Column:
    """The column's value in the following row; reuses the order made by ``with_next``."""
    return F.lead(column).over(Window.partitionBy("__bucket").orderBy("__wrap", "doc_id", "text", "__guest"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      gram: int = 4, window: int = 8, buckets: int | None = None) -> DataFrame:
    """Marks of every text and of its edited form, and their likenesses.

    The edited text has its last quarter (whole code points, rounded down) replaced by as many
    first code points of the next document.  Texts are read whole, however long.  Returns ``doc_id``, ``n_chars``, ``edited`` (the
    text), ``marks``, ``edited_marks``, ``near_edited``, ``near_next``.  One row per input row;
    a table of one row is its own next document; NULL texts count as empty; an empty table gives
    an empty result; other columns are ignored.
    """
    rows = with_next(docs, id_col, text_col, buckets)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = (rows.withColumn("n_chars", F.length("text").cast("long"))
            .withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 4) as int))"),
                                           F.coalesce(F.left(F.col("next_text"), quarter), F.lit("")))))
    rows = with_marks(rows, "text", "marks", gram, window).drop("next_text")
    rows = rows.withColumn("next_marks", next_value("marks")).where("not __guest")
    rows = with_marks(rows, "edited", "edited_marks", gram, window)
    return rows.select("doc_id", "n_chars", "edited", "marks", "edited_marks",
                       likeness("marks", "edited_marks").alias("near_edited"), likeness("marks", "next_marks").alias("near_next"))
