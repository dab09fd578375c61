"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotsets.llm.common import handoff, keep_columns, quoted

SPACE = r"[ \t\x0B\f\r]+"
_ID = ["doc_id", "t", "line_no"]


def normal_line(line: Column) -> Column:
    """Lower-cased, runs of white space as one blank, none at the ends."""
    odd = reduce(lambda a, b: a | b, [line.contains(x) for x in ("  ", "\t", "\x0b", "\f", "\r")])
    low = F.lower(line)
    return F.trim(F.when(odd, F.regexp_replace(low, SPACE, " ")).otherwise(low))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _word_count(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = quoted(text_col).cast("string")
    return docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


#: first unit of a line that is compared by its characters; a blank inside such a line
SPELLED, BLANK = "\x02", "\x01"


def _comparable(words: Column, chars: Column, min_words: int, min_chars: int) -> Column:
    """Whether a line is long enough, in words or in characters, that an equal one is no chance."""
    return (words >= min_words) | (chars >= min_chars)


def _units(norm: Column, words: Column, chars: Column, min_near_words: int, min_chars: int) -> tuple[Column, Column]:
    """What edits of a line are counted in, blank-separated, and how many: its words, if it has enough of
    them, or else its characters (scripts without blanks, long strings); NULL for a line too short for either."""
    spelled = F.concat(F.lit(SPELLED), F.regexp_replace(F.translate(norm, " ", BLANK), r"(?s)(.)", " $1"))
    return (F.when(words >= min_near_words, norm).when(chars >= min_chars, spelled),
            F.when(words >= min_near_words, words).when(chars >= min_chars, chars + 1))


def _half(norm: Column, m: Column, side: str) -> Column:
    """Key of the first m/2 units, or of the last m - m/2, of a line seen as having m units."""
    half = F.floor(m / 2).cast("int")
    part = (F.call_function("substring_index", norm, F.lit(" "), half) if side == "first"
            else F.call_function("substring_index", norm, F.lit(" "), half - m))
    return F.xxhash64(F.lit(side), m, part)


def _lines(rows: DataFrame, min_words: int, min_near_words: int, min_chars: int) -> DataFrame:
    """What is looked for elsewhere, as hashes ``h`` and ``g``: the lines that are long enough, with the keys of
    their halves, and the pairs of neighbouring lines of which one is shorter.

    ``line_no`` goes with a copy if ``own``, and so does ``next_no`` unless NULL (a pair's short lines).
    One edited unit leaves either the first or the last half of the shorter line as it was, so
    two lines within one edit share a half key.  A line takes part as the shorter or equal one
    (m = its units) and as the longer one (m = its units - 1).
    """
    # normalised and counted before the lines are dealt out, so that nothing below repeats it
    norms = F.transform(text_lines(F.col("text")), lambda line, i: F.struct(i.alias("i"), normal_line(line).alias("x")))
    known = F.transform(F.filter(norms, lambda p: p["x"] != ""), lambda p: F.struct(
        p["i"].alias("line_no"), F.lit(None).cast("int").alias("next_no"), F.lit(True).alias("own"), p["x"].alias("x"),
        _word_count(p["x"]).cast("int").alias("words"), F.length(p["x"]).alias("chars")))
    held = rows.select("doc_id", "t", known.alias("lines"))

    def long(p: Column) -> Column:
        return _comparable(p["words"], p["chars"], min_words, min_chars)

    rest = F.greatest(F.size("lines") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("lines", F.lit(1), rest), F.slice("lines", F.lit(2), rest), lambda a, b: F.when(~long(a) | ~long(b), F.struct(
        a["line_no"].alias("line_no"), F.when(~long(b), b["line_no"]).alias("next_no"), (~long(a)).alias("own"),
        F.concat_ws("\n", F.lit("pair"), a["x"], b["x"]).alias("x"), F.lit(0).alias("words"), F.lit(0).alias("chars"))))
    both = F.concat(F.filter("lines", long), F.filter(pairs, lambda p: p.isNotNull()))
    found = held.select("doc_id", "t", F.explode(both).alias("p")).select("doc_id", "t", "p.*")
    units, n = _units(F.col("x"), F.col("words"), F.col("chars"), min_near_words, min_chars)
    found = found.withColumns({"units": units, "n": n})
    n, units = F.col("n"), F.col("units")
    keys = F.when(units.isNotNull(), F.array(*[_half(units, m, side) for m in (n, n - 1) for side in ("first", "last")]))
    return found.select("doc_id", "t", "line_no", "next_no", "own", F.xxhash64("x").alias("h"), F.xxhash64(F.lit("second"), "x").alias("g"), keys.alias("halves"))


def _variants(lines: DataFrame) -> DataFrame:
    """Hashed keys ``v`` of every line (``pos`` -1) and of the line without each of its units.

    A sequence is hashed as the exclusive or of its units' hashes salted with their positions;
    what follows a deleted one moves up by one; the number of units is part of the key.  Running
    totals give all keys of a line in one pass over its units.
    """
    words = lines.select(*_ID, "n", F.posexplode(F.split("units", " ")).alias("pos", "word"))
    words = words.select(*_ID, "n", "pos", F.xxhash64("word", "pos").alias("here"), F.xxhash64("word", F.col("pos") - 1).alias("moved"))
    w = Window.partitionBy(*_ID).orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    words = words.select(*_ID, "n", "pos", F.coalesce(F.bit_xor("here").over(before), F.lit(0)).alias("left"),
                         F.bit_xor("moved").over(upto).alias("gone"), F.bit_xor("moved").over(whole).alias("all_moved"),
                         F.bit_xor("here").over(whole).alias("all"))
    cut = F.col("left").bitwiseXOR(F.col("all_moved")).bitwiseXOR(F.col("gone"))
    without = words.select(F.struct(*_ID).alias("id"), "pos", F.xxhash64(F.col("n") - 1, cut).alias("v"))
    entire = words.where("pos = 0").select(F.struct(*_ID).alias("id"), F.lit(-1).alias("pos"), F.xxhash64("n", "all").alias("v"))
    return without.union(entire)


def _within_one_edit(a: Column, b: Column) -> Column:
    """Edit distance of at most one unit, from two blank-separated strings of the same kind."""
    x, y = F.split(a, " "), F.split(b, " ")
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    agree = F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda p, q: p == q)
    first = F.array_position(agree, False)  # 1-based; 0 if one starts with the other
    rest = F.size(long)
    same_length = (first == 0) | (F.slice(short, first.cast("int") + 1, rest) == F.slice(long, first.cast("int") + 1, rest))
    one_more = (first == 0) | (F.slice(short, F.greatest(first.cast("int"), F.lit(1)), rest) == F.slice(long, first.cast("int") + 1, rest))
    alike = a.startswith(SPELLED) == b.startswith(SPELLED)
    return F.when(~alike, False).when(F.size(x) == F.size(y), same_length).when(F.size(long) - F.size(short) == 1, one_more).otherwise(False)


def _near(rows: DataFrame, firsts: DataFrame, min_near_words: int, min_chars: int) -> DataFrame:
    """Ids of the first occurrences that have an earlier line within one edited unit."""
    halves = firsts.where("halves is not null").select("doc_id", "t", "line_no", F.explode(F.array_distinct("halves")).alias("key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    wanted = halves.join(shared, "key", "left_semi").groupBy("doc_id", "t").agg(F.collect_set("line_no").alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), "wanted")
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("t") == F.col("__t")))
    found = texts.select("doc_id", "t", F.explode("wanted").alias("line_no"), text_lines(F.col("text")).alias("lines"))
    found = found.select("doc_id", "t", "line_no", normal_line(F.element_at("lines", F.col("line_no") + 1)).alias("x")).distinct()
    found = found.withColumns({"words": _word_count(F.col("x")).cast("int"), "chars": F.length("x")})
    units, n = _units(F.col("x"), F.col("words"), F.col("chars"), min_near_words, min_chars)
    found = handoff(found.select(*_ID, units.alias("units"), n.alias("n")))
    variants = handoff(_variants(found))
    # most keys belong to one line only: what follows reads the others
    met = variants.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v")
    variants = handoff(variants.join(met, "v", "left_semi"))
    # all lines of equal length without the same unit's place are within one edit of each other,
    # and a line that equals another's variant is within one edit of it: the earliest of each
    # group stands for all, so a template shared by many lines makes no pairs
    groups = handoff(variants.groupBy("v", "pos").agg(F.min("id").alias("first"), F.count("*").alias("c")))
    by_key = (groups.groupBy("v").agg(F.min(F.when(F.col("pos") == -1, F.col("first"))).alias("whole"),
                                      F.min(F.when(F.col("pos") >= 0, F.col("first"))).alias("cut"))
              .where("whole is not null and cut is not null"))
    edited = variants.where("pos >= 0")
    pairs = (edited.join(groups.where("c > 1").select("v", "pos", "first"), ["v", "pos"]).where("first < id").select("id", "first")
             .union(edited.join(by_key.select("v", F.col("whole").alias("first")), "v").where("first < id").select("id", "first"))
             .union(by_key.where("cut < whole").select("whole", "cut"))).distinct()
    one = found.select(F.struct(*_ID).alias("id"), "units")
    other = found.select(F.struct(*_ID).alias("first"), F.col("units").alias("first_units"))
    checked = pairs.join(one, "id").join(other, "first").where(_within_one_edit(F.col("units"), F.col("first_units")))
    return checked.select("id.doc_id", "id.t", "id.line_no").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = 3, min_near_words: int = 5, min_chars: int = 20) -> DataFrame:
    """``doc_id``, ``t`` (hash of the text), ``dropped`` (numbers, from 0, of the lines to drop).

    Only documents that lose a line have a row.  Lines end at ``\\n`` and are compared
    lower-cased with white space runs as one blank, in the order of (doc_id, text hash, line number).

    * A line of ``min_words`` words or ``min_chars`` characters goes if an equal line comes earlier.
    * It also goes if an earlier line (whether or not that one stays) is within one edit: one
      inserted, deleted or replaced word between lines of ``min_near_words`` words or more, one
      character between lines of fewer words but ``min_chars`` characters (scripts without
      blanks, long strings).  One word of five is a similarity of 0.8; longer lines have the same bound.
    * A shorter line goes if it and the line before it, or the line after it (blank lines apart),
      follow each other earlier too: so the short lines of a repeated passage go with it, while
      one that is only equal by chance stays.

    Rows are told apart by doc_id and text, so repeated rows are one document; a NULL doc_id comes
    before all others; NULL or empty text has no lines; an empty table gives an empty result; other
    columns, whatever their names, do not matter.  A line's variants are as many rows as it has
    units, so a very long line is dealt out too; the text itself has to fit a task.
    """
    rows = _rows(docs, id_col, text_col)
    lines = handoff(_lines(rows, min_words, min_near_words, min_chars))
    firsts = handoff(lines.groupBy("h", "g").agg(F.min(F.struct(*_ID)).alias("id"), F.count("*").alias("c"), F.first("halves").alias("halves"))
                     .select("h", "g", "c", "id.*", "halves"))
    near = _near(rows, firsts, min_near_words, min_chars)
    many = firsts.where("c > 1").select("h", "g", F.struct(*_ID).alias("id"))
    copies = lines.join(many, ["h", "g"]).where(F.struct(*_ID) != F.col("id")).select(
        "doc_id", "t", F.explode(F.array(F.when(F.col("own"), F.col("line_no")), F.col("next_no"))).alias("line_no")).where("line_no is not null")
    return copies.union(near).groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_lines``, ``dropped`` for every row of ``docs``."""
    found = repeated_lines(docs, **options).select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), "dropped")
    rows = _rows(docs, options.get("id_col", "doc_id"), options.get("text_col", "text"))
    rows = rows.select("doc_id", "t", F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.size(text_lines(F.col("text")))).cast("long").alias("n_lines"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("t") == F.col("__t")), "left")
    return both.select("doc_id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def _short_firsts(rows: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """``doc_id``, ``t`` of the documents that hold the first of some line too short to be compared."""
    norms = F.transform(text_lines(F.col("text")), normal_line)
    lines = rows.select("doc_id", "t", F.posexplode(norms).alias("line_no", "norm"))
    lines = lines.where((F.col("norm") != "") & ~_comparable(_word_count(F.col("norm")), F.length("norm"), min_words, min_chars))
    firsts = lines.groupBy(F.xxhash64("norm").alias("h"), F.xxhash64(F.lit("second"), "norm").alias("g")).agg(F.min(F.struct(*_ID)).alias("id"))
    return firsts.select("id.doc_id", "id.t").distinct()


def drop_repeated_lines(docs: DataFrame, min_words: int = 3, min_near_words: int = 5, min_chars: int = 20) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``.

    A document that loses lines goes if what is left is blank, or lines too short to be compared
    that all occur earlier as well; one with any other line left keeps all that is left.  A
    document that loses none stays as it is, be it empty or NULL.
    """
    found = (repeated_lines(docs, min_words=min_words, min_near_words=min_near_words, min_chars=min_chars)
             .select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), F.col("dropped").alias("__dropped")))
    own = _short_firsts(_rows(docs, "doc_id", "text"), min_words, min_chars).withColumn("__own", F.lit(True))
    found = (found.join(own, F.col("__d").eqNullSafe(F.col("doc_id")) & (F.col("__t") == F.col("t")), "left")
             .select("__d", "__t", "__dropped", F.coalesce("__own", F.lit(False)).alias("__own")))
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left")
    kept = F.filter(F.transform(text_lines(F.col("text")), lambda line, i: F.when(~F.array_contains("__dropped", i), line)), lambda line: line.isNotNull())
    both = both.withColumn("__kept", F.when(F.col("__dropped").isNotNull(), kept))
    left = F.exists("__kept", lambda line: _comparable(_word_count(normal_line(line)), F.length(normal_line(line)), min_words, min_chars))
    both = both.where(F.col("__dropped").isNull() | F.col("__own") | left)
    both = both.withColumn("text", F.when(F.col("__dropped").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col("text")))
    return keep_columns(both, docs.columns)
