"""Mix sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import materialize

SEED = 17
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2

# A document's place in the draw is the md5 of its id; the first digits of it make the cells whose
# sizes are added up before any document is ordered.
_CELL_DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of words, which are runs of anything but ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Never null, so that rows without a source join like any others."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def weigh(sources: DataFrame, weights: Sequence[float] | Mapping[str | None, float]) -> DataFrame:
    """Add ``weight``: of a mapping by name (0 if absent), or of a list that is dealt out again and
    again over the names by code point, null last. One row per source goes through the window."""
    if isinstance(weights, Mapping):
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
        return sources.withColumn("weight", weight)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to ``(…, words, weight)``.

    The targets share ``share`` times all words by weight. A source whose part would exceed
    ``max_epochs`` times its words is clamped there, and what it leaves is shared by the others in
    proportion, until no source is above its cap. Each pass is one aggregate over the sources.
    """
    sources = materialize(sources.withColumn("cap", F.col("words") * F.lit(float(max_epochs))), "sources")
    total = float(sources.agg(F.sum("words")).first()[0] or 0) * share
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        above = above if clamped >= 0 else F.lit(False)
        n, held, free = sources.agg(
            F.count_if(above), F.sum(F.when(above, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
        ).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - held) / free
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    if clamped >= 0 and not free:
        target = F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)
    return sources.withColumn("target", target)


def mix(docs: DataFrame, weights: Sequence[float] | Mapping[str | None, float] = WEIGHTS,
        share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` and ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_copies``.

    ``mix_copies`` says how often the mix takes the document: the whole repetitions of its source
    (``floor(target / words)``), and one more for the documents that come first in the seeded
    order of the source, up to the document in which the fractional repetition ends (taken if at
    least half of it lies inside). A source's words therefore miss its target by at most half a
    document. A null text has no words, null is a source of its own, rows that repeat both id and
    text are taken alike, an empty table gives an empty table. Columns of the same names as the
    added ones are replaced.

    Shuffles carry only the pre-aggregated cells; documents are read in place, and the table of
    sources is joined in the way its written size allows.
    """
    key = _source_key(docs[source_col])
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("null"))))
    tie = F.xxhash64(docs[text_col])
    sized = materialize(
        docs.select(key.alias("key"), docs[source_col].cast("string").alias("source"),
                    place.alias("place"), tie.alias("tie"), n_words(docs[text_col]).alias("size")),
        "mix-sizes",
    )
    cell = F.substring("place", 1, _CELL_DIGITS)
    cells = sized.groupBy("key", cell.alias("cell")).agg(F.sum("size").alias("size"))
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("words"))
    filled = water_fill(weigh(sources, weights), share, max_epochs)
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(F.lit(0))
    plan = filled.withColumn("whole", whole.cast("int")).withColumn(
        "extra", F.col("target") - F.col("whole") * F.col("words"))

    up_to = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ends = cells.withColumn("end", F.sum("size").over(up_to)).join(plan.select("key", "extra"), "key")
    first_partial = ends.filter(F.col("end") > F.col("extra")).groupBy("key").agg(
        F.min_by(F.struct("cell", (F.col("end") - F.col("size")).alias("before"), "extra"), F.col("cell")).alias("cut")
    ).select("key", "cut.*")
    before = Window.partitionBy("key", "cell").orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = sized.withColumn("cell", cell).join(first_partial, ["key", "cell"]).withColumn(
        "start", F.col("before") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    last = inside.filter(F.col("start") + F.col("size") / 2 <= F.col("extra")).groupBy("key").agg(
        F.max(F.struct("place", "tie")).alias("last"))
    rule = materialize(
        plan.join(first_partial.select("key", "cell"), "key", "left").join(last, "key", "left").select(
            "key", F.col("words").alias("mix_source_size"), F.col("target").alias("mix_target"),
            "whole", "extra", "cell", "last"),
        "mix-rule",
    )
    own = [c for c in docs.columns if c.lower() not in
           {"mix_size", "mix_source_size", "mix_target", "mix_copies"}]
    read = docs.select(
        *[docs[f"`{c}`"] for c in own], key.alias("__key"), place.alias("__place"), tie.alias("__tie"),
        n_words(docs[text_col]).alias("mix_size"))
    rule = rule.select([F.col(c).alias(f"__rule_{c}") for c in rule.columns])
    found = read.join(rule, F.col("__key") == F.col("__rule_key"))
    early = (
        F.when(F.col("__rule_extra") <= 0, F.lit(False))
        .when(F.col("__rule_cell").isNull(), F.lit(True))
        .when(F.col("__rule_last").isNull(), F.col("__place") < F.col("__rule_cell"))
        .otherwise(F.struct(F.col("__place").alias("place"), F.col("__tie").alias("tie")) <= F.col("__rule_last"))
    )
    return found.select(
        *[F.col(f"`{c}`") for c in own], "mix_size",
        F.col("__rule_mix_source_size").alias("mix_source_size"), F.col("__rule_mix_target").alias("mix_target"),
        (F.col("__rule_whole") + early.cast("int")).alias("mix_copies"),
    )


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as ``mix_copies`` says, without the added columns."""
    added = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    return mixed.withColumn(
        "mix_copies", F.explode(F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1), F.col("mix_copies"))))
    ).drop(*added)


def op10_water_filled_mix(docs: DataFrame) -> DataFrame:
    return mix(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def sql(table: str = "documents", seed: int = SEED) -> str:
    """The same digest for DuckDB: the level is that of the first source, by cap over weight, that
    need not be clamped."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, md5('{seed}:' || doc_id) AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM {table}),
s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
w AS (
  SELECT source, words, 2.0::DOUBLE * words AS cap,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
o AS (
  SELECT *, row_number() OVER z AS i,
         sum(cap) OVER z - cap AS held, sum(weight) OVER () - sum(weight) OVER z + weight AS free,
         1.5::DOUBLE * sum(words) OVER () AS total
  FROM w WINDOW z AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT (total - held) / free AS level FROM o WHERE cap >= weight * ((total - held) / free)
      ORDER BY i LIMIT 1),
p AS (SELECT source, words, least(cap, weight * level) AS target FROM w, l),
q AS (SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END AS whole FROM p),
x AS (
  SELECT d.doc_id, d.size, q.words, q.target, q.whole, q.target - q.whole * q.words AS extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, words AS source_size, target,
       (size * (whole + CASE WHEN extra > 0 AND start + size / 2 <= extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x"""
