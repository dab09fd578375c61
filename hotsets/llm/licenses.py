"""License scans with a positional index of rare tokens, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotsets.llm.common import ascii_lower, handoff, quoted

# Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License notices (label, words, phrase that must stand in its place).
TEMPLATES = [
    ("gpl", "gnu general public license", "gnu general public license"),
    ("apache", "apache license", "apache license"),
    ("cc-by", "cc by", "cc by"),
    ("mit", "mit license", "mit license"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu", "redistribute it and or modify it under the terms of the gnu"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright", "cc0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: a word that a larger share of the documents has tells no file from another
COMMON = 0.05
#: letters beyond ASCII whose lower case is or holds an ASCII letter
_ODD = "[\u0130\u212A]"


def word_text(text: Column) -> Column:
    """The words of a text, blank-separated: runs of digits, letters and non-ASCII characters.

    A-Z are lower-cased.  Other letters may be as well: no phrase or template holds any.
    """
    low = F.when(text.rlike(_ODD), ascii_lower(text)).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(F.coalesce(low, F.lit("")), _GAP, " "))


def _stands(words: Column, at: Column, phrase: str) -> Column:
    """Whether the phrase's words stand in ``words`` from index ``at`` on."""
    parts = phrase.split(" ")
    return reduce(lambda a, b: a & b, [F.coalesce(F.get(words, at + k), F.lit("")) == w for k, w in enumerate(parts)])


def _base_places(phrase: str, label: str) -> Column:
    at = F.filter("__at", lambda i: _stands(F.col("__words"), i, phrase))
    return F.transform(at, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))


def _index(document_counts: dict[str, int], n_docs: int, rarest: int, common: float) -> list[tuple[str, int, int, int]]:
    """Postings (word, template, place in it, weight): of each template its rarest words without
    those of more than the share ``common`` of all documents.  One word of the mandatory phrase
    is always there, its rarest if need be: it stands wherever the template can be verified.

    The weight is the inverse document frequency over all documents, in thousandths.
    """
    import math

    out = []
    for t, (_, words, phrase) in enumerate(TEMPLATES):
        idf = {w: math.log((n_docs + 1) / (document_counts.get(w, 0) + 1)) + 1 for w in words.split()}
        by_rarity = sorted(idf, key=lambda w: (-idf[w], w))
        chosen = [w for w in by_rarity[:rarest] if document_counts.get(w, 0) <= common * n_docs]
        must = [w for w in by_rarity if w in phrase.split()]
        chosen += [] if set(must) & set(chosen) else must[:1]
        out += [(w, t, k, round(1000 * idf[w])) for k, w in enumerate(words.split()) if w in chosen]
    return out


def license_document_counts(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many of all documents each word of the templates occurs, and how many there are."""
    vocabulary = sorted({w for _, words, _ in TEMPLATES for w in words.split()})
    words = F.split(word_text(quoted(text_col).cast("string")), " ")
    found = docs.select(F.array_intersect(words, F.array(*map(F.lit, vocabulary))).alias("w"))
    rows = found.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in rows}  # one row per template word
    return counts, counts.pop("", 0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: int = 3, common: float = COMMON, least: float = 0.6) -> DataFrame:
    """``doc_id``, ``n_words``, ``places`` (start, label), ``found`` (start, label, share), per row.

    ``places``: where the words of a base phrase stand one after the other.  ``found``: template
    alignments.  The index holds the ``rarest`` words of every template, by document frequency
    over all documents, without those that more than the share ``common`` of them have, but
    always one of the mandatory phrase; of a file all of these words are looked up, the rarest
    first.  Each of their places votes for (template, start); an alignment counts if the template's mandatory
    phrase stands in its place and its votes carry ``least`` of the weight of the looked-up
    words.  A text may begin within a template, up to its mandatory phrase: ``start`` is negative
    then, and the words missing before the text do not count.  NULL and empty texts have no words;
    texts are read whole, however long; rows are told apart by their position in the scan only,
    so repeated rows are reported alike; an empty table gives an empty result; other columns are
    ignored.
    """
    text = quoted(text_col).cast("string")
    counts, n_docs = license_document_counts(docs, text_col)
    postings = _index(counts, n_docs, rarest, common)
    weight = {w: v for w, _, _, v in postings}
    by_rarity = sorted(weight, key=lambda w: (-weight[w], w))
    rows = docs.select(quoted(id_col).alias("doc_id"), word_text(text).alias("__norm"))
    padded = F.concat(F.lit(" "), F.col("__norm"), F.lit(" "))
    n = F.when(F.col("__norm") == "", 0).otherwise(F.length("__norm") - F.length(F.replace("__norm", F.lit(" "), F.lit(""))) + 1)
    has_base = reduce(lambda a, b: a | b, [padded.contains(f" {p} ") for p in PHRASES])
    rows = rows.withColumn("n_words", n.cast("long")).withColumn("__base", has_base)
    rows = rows.withColumn("__words", F.split("__norm", " "))
    # the file's rarest index words, in the order of rarity
    rows = rows.withColumn("__own", F.array_intersect(F.array(*map(F.lit, by_rarity)), F.col("__words")))
    rows = rows.withColumn("__look", F.size("__own") > 0).drop("__norm")
    at = F.when(F.col("__base") | F.col("__look"), F.sequence(F.lit(0), F.size("__words") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    heads = sorted({p.split(" ")[0] for p in PHRASES})
    wanted = F.filter(at, lambda i: F.get("__words", i).isin(heads) | F.array_contains("__own", F.get("__words", i)))
    rows = rows.withColumn("__at", wanted)
    base = [_base_places(p, label) for p, label in PHRASES.items()]
    rows = rows.withColumn("places", F.flatten(F.array(*base)))
    lookup = F.create_map(*[x for w in by_rarity for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k"), F.lit(v).alias("v"), F.lit(k - _offset(t)).alias("least")) for u, t, k, v in postings if u == w]))])
    votes = F.flatten(F.transform(F.filter("__at", lambda i: F.array_contains("__own", F.get("__words", i))),
                                  lambda i: F.transform(F.filter(F.element_at(lookup, F.get("__words", i)), lambda q: i >= q["least"]), lambda q: F.struct(q["t"].alias("t"), (i - q["k"]).alias("start"), q["v"].alias("v")))))
    rows = rows.withColumn("__votes", votes)
    # the looked-up weight of each template, the greatest that an alignment can reach
    full = F.array(*[reduce(lambda a, b: a + b, [F.when(F.array_contains("__own", w), v).otherwise(0) for w, u, _, v in postings if u == t], F.lit(0)) for t in range(len(TEMPLATES))])
    rows = rows.withColumn("__full", F.when(F.size("__votes") > 0, full))
    verified = reduce(lambda chain, t: chain.when(F.col("__v.t") == t, _stands(F.col("__words"), F.col("__v.start") + _offset(t), TEMPLATES[t][2])),
                      range(1, len(TEMPLATES)), F.when(F.col("__v.t") == 0, _stands(F.col("__words"), F.col("__v.start") + _offset(0), TEMPLATES[0][2])))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    rows = handoff(rows.select("doc_id", "n_words", "places", "__votes", "__full", *[F.when(F.size("__votes") > 0, F.col(c)).alias(c) for c in ("__words", "__own")], "__row"))
    voted = rows.where("size(__votes) > 0").withColumn("__v", F.explode("__votes"))
    # words whose place lies before the text's first word cannot vote
    cut = reduce(lambda a, b: a + b, [F.when((F.col("__v.t") == t) & (F.col("__v.start") < -k) & F.array_contains("__own", w), v).otherwise(0) for w, t, k, v in postings if k < _offset(t)], F.lit(0))
    reach = F.get("__full", F.col("__v.t")) - F.when(F.col("__v.start") < 0, cut).otherwise(0)
    tally = (voted.select("__row", F.col("__v.t").alias("t"), F.col("__v.start").alias("start"), F.col("__v.v").alias("v"), verified.alias("ok"), reach.alias("full"))
             .where("ok").groupBy("__row", "t", "start").agg((F.sum("v") / F.max("full")).alias("share")).where(F.col("share") >= least))
    label = F.get(F.array(*[F.lit(x[0]) for x in TEMPLATES]), F.col("t"))
    found = tally.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), label.alias("label"), F.least("share", F.lit(1.0)).alias("share")))).alias("found"))
    out = rows.select("doc_id", "n_words", "places", "__row").join(found, "__row", "left")
    return out.select("doc_id", "n_words", "places", F.coalesce("found", F.expr("cast(array() as array<struct<start:bigint,label:string,share:double>>)")).alias("found"))


def _offset(t: int) -> int:
    """Where the mandatory phrase of a template begins in it, in words."""
    _, words, phrase = TEMPLATES[t]
    w, p = words.split(), phrase.split()
    return next(i for i in range(len(w)) if w[i:i + len(p)] == p)
