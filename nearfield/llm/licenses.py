"""Find license phrases by diagonal voting (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import id_and_text, materialize

# A word is a run of ASCII letters and digits and of any non-ASCII characters.
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The two non-ASCII characters whose lower case has ASCII in it; only A-Z are to be lowered.
_ODD_CASE = "[İK]"
K = 2  # words of a gram: the shortest phrase is two words long
SHIFT = 2  # diagonals at most this far apart are one copy with words put in or left out,
SHIFT_SHARE = 3  # or this part of a template's grams, where that is more
COVERAGE = 0.7  # share of a long template's grams that an edited copy must still have


@dataclass(frozen=True)
class Template:
    """A phrase and its label. ``exact`` phrases must stand word for word."""

    label: str
    words: str
    exact: bool = False


TEMPLATES = (
    # The base phrases and labels.
    Template("cc-by", "cc by", exact=True),
    Template("gpl", "general public license", exact=True),
    Template("reserved", "all rights reserved", exact=True),
    # Public license texts, found also when a few words differ.
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-notice", "this work is licensed under a creative commons attribution license"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
)


def _lower(text: Column) -> Column:
    upper = "".join(chr(c) for c in range(65, 91))
    return F.when(text.rlike(_ODD_CASE), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def _gram_rows(templates: tuple[Template, ...]) -> list[tuple]:
    """``(tpl, label, exact, shift, n_grams, tpl_pos, unit, gram)`` of every gram position. Positions that
    hold the same gram are one unit, so that a gram counts once; of an exact phrase each counts."""
    rows = []
    for t, template in enumerate(templates):
        words = template.words.split(" ")
        grams = [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]
        units = list(range(len(grams))) if template.exact else [grams.index(g) for g in grams]
        shift = 0 if template.exact else max(SHIFT, len(grams) // SHIFT_SHARE)
        rows += [(t, template.label, template.exact, shift, len(set(units)), i, unit, gram)
                 for i, (unit, gram) in enumerate(zip(units, grams))]
    return rows


def template_grams(spark, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per gram position of every template: a table as small as the templates."""
    table = spark.createDataFrame(
        _gram_rows(templates),
        "tpl int, label string, exact boolean, shift int, n_grams int, tpl_pos int, unit int, tpl_gram string")
    return table.withColumn("h", F.xxhash64("tpl_gram"))


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Verified license spans: ``(doc_id, copy, label, exact, first, last, coverage)``.

    ``first`` and ``last`` are word positions from 0, ``copy`` is the hash of the text, which tells
    rows of one id apart. Every word gram of every text is hashed and joined with the gram
    positions of the templates (a table with the size of the parameter, so it is broadcast); gram
    words are compared too. Each match votes for its diagonal (position in the text less position
    in the template). Of an exact phrase every gram must vote on one diagonal. For other templates,
    diagonals up to ``SHIFT`` or a third of the template's grams apart are merged into one region,
    whose span is kept if at least ``COVERAGE`` of the template's different grams voted; a gram that
    stands in it more than once counts once.
    """
    text = id_and_text(docs, id_col, text_col)
    words = F.regexp_extract_all(_lower(F.col("text")), F.lit(f"({_WORDS})"), F.lit(1))
    rest = F.greatest(F.size("words") - (K - 1), F.lit(0))
    pairs = F.zip_with(
        F.slice("words", 1, rest), F.slice("words", K, rest),
        lambda a, b: F.struct(F.concat(a, F.lit(" "), b).alias("gram")),
    )
    grams = text.select("doc_id", F.xxhash64("text").alias("copy"), words.alias("words")).select(
        "doc_id", "copy", F.posexplode(pairs).alias("pos", "g")
    ).select("doc_id", "copy", "pos", F.col("g.gram").alias("gram"), F.xxhash64("g.gram").alias("h"))
    small = F.broadcast(template_grams(docs.sparkSession, templates))
    votes = grams.join(small, (grams.h == small.h) & (grams.gram == small.tpl_gram)).select(
        "doc_id", "copy", "tpl", "label", "exact", "shift", "n_grams", "unit", "pos",
        (F.col("pos") - F.col("tpl_pos")).alias("diagonal"))
    along = Window.partitionBy("doc_id", "copy", "tpl").orderBy("diagonal", "pos")
    step = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("shift"), F.lit(True))
    # distinct: rows that repeat id and text vote once
    regions = votes.distinct().withColumn("new", step.cast("int")).withColumn("region", F.sum("new").over(along)).groupBy(
        "doc_id", "copy", "tpl", "label", "exact", "n_grams", "region"
    ).agg(F.size(F.collect_set("unit")).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    coverage = F.col("votes") / F.col("n_grams")
    enough = F.when(F.col("exact"), F.lit(1.0)).otherwise(F.lit(COVERAGE))
    return regions.filter(coverage >= enough).select(
        "doc_id", "copy", "label", "exact", F.col("first").cast("long").alias("first"),
        (F.col("last") + (K - 1)).cast("long").alias("last"), coverage.alias("coverage"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: word count, exact places, labels and score.

    A null text is empty and an empty one has no words; a null id is an id like any other; rows
    that repeat id and text get equal results; other columns are not read. ``n_base``,
    ``first_word``, ``last_word`` and ``base_labels`` describe the exact phrases, ``labels`` all
    templates, ``score`` is the best coverage (1 for an exact phrase, 0 for none).
    """
    found = materialize(spans(docs, templates, id_col, text_col), "license-spans")
    base = F.col("exact")
    label_list = lambda label: F.concat_ws(",", F.array_sort(F.collect_set(label)))
    summary = found.groupBy(F.col("doc_id").alias("of"), F.col("copy").alias("of_copy")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        label_list(F.when(base, F.col("label"))).alias("base_labels"),
        label_list(F.col("label")).alias("labels"), F.max("coverage").alias("score"))
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("copy"),
        F.regexp_count("text", F.lit(_WORDS)).cast("long").alias("n_words"))
    joined = rows.join(summary, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("copy") == F.col("of_copy")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def sql(table: str = "documents", templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same digest for DuckDB (texts without NUL characters)."""
    rows = ", ".join(
        f"({t}, '{label}', {str(exact).lower()}, {shift}, {n}, {i}, {unit}, '{a}', '{b}')"
        for t, label, exact, shift, n, i, unit, gram in _gram_rows(templates) for a, b in [gram.split(" ")])
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH t(tpl, label, exact, shift, n_grams, tpl_pos, unit, a, b) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}),
g AS (SELECT doc_id, w, unnest(range(len(w) - 1)) AS pos FROM d),
v AS (SELECT doc_id, tpl, label, exact, shift, n_grams, unit, pos, pos - tpl_pos AS diagonal
      FROM g JOIN t ON g.w[pos + 1] = t.a AND g.w[pos + 2] = t.b),
n AS (SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER z > shift, true) THEN 1 ELSE 0 END AS new
      FROM v WINDOW z AS (PARTITION BY doc_id, tpl ORDER BY diagonal, pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tpl ORDER BY diagonal, pos ROWS UNBOUNDED PRECEDING) AS region
      FROM n),
s AS (SELECT doc_id, tpl, label, exact, region, min(pos) AS first,
             count(DISTINCT unit)::DOUBLE / any_value(n_grams) AS coverage FROM r GROUP BY ALL),
f AS (SELECT * FROM s WHERE coverage >= CASE WHEN exact THEN 1.0 ELSE {COVERAGE} END),
m AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(first) FILTER (exact) AS first_word,
             max(first) FILTER (exact) AS last_word,
             array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ',') AS base_labels,
             array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(coverage) AS score
      FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN m USING (doc_id)"""
