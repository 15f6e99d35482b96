"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Every source gets a share of the wanted words by its weight, but never more than ``EPOCHS`` times its own size; what is over
is shared again among the rest. Sorted by how soon they reach that bound, the sources' targets are the sums
of one pass: the bounded ones come first, all others stand at one level of words per unit of weight.

A source takes whole epochs of all its documents first. The words that are left go to its documents in the order of their
exponential keys, ``-ln(u) / weight``, where ``u`` is a hash of seed and id and the weight tells the quality of the
document: a weighted sample without replacement. The document in which the budget runs out gives its first words, so that each source
meets its target to the word.

Texts are reduced to sizes and weights where they are read. Sums within a source run over ranges of its order
(``ordering.running``), so a source that holds a third of all documents is spread like the others.

A null text has size 0, a null source is a source of its own, which comes last, and a null id is hashed as the word null. Rows
of one id have one ``u``; they follow each other by size, and rows repeated whole are documents like any other. Sources without words
have target 0. An empty table gives an empty result. Further columns are left out and may clash in name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.llm.common import stage, table
from countwatch.llm.ordering import in_order, pick, places, running

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words to take for each word there is.
SHARE = 1.5
#: At most so many copies of a document.
EPOCHS = 2
SEED = 12
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII digits and marks.
OTHER = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 to 4: a point each for words of 2 to 12 letters on average, few digits and marks, and sentence ends often enough."""
    plain = F.length(F.translate(text, OTHER, ""))
    marks = F.length(text) - plain
    letters = F.length(F.translate(text, OTHER + SPACE, ""))
    ends = F.length(text) - F.length(F.translate(text, ".!?", ""))
    points = [letters.between(2 * size, 12 * size) & (size > 0), (marks * 8 <= F.length(text)) & (size > 0), (ends > 0) & (ends * 40 >= size)]
    return F.lit(1) + sum((F.coalesce(p, F.lit(False)).cast("int") for p in points), F.lit(0))


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number between 0 and 1, both excluded, from 52 bits of a hash of seed and key."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row per source.

    ``level`` is the words per unit of weight that would be left if all earlier sources, by their bound per unit of weight, were
    at their bounds; the first source whose bound is not below it ends the bounded ones.
    """
    ranked = places(in_order(sizes, [F.col("source").asc_nulls_last()], "mix-sources"), [])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("pos") % len(weights)).cast("int") + 1)
    bound = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("bound"))
    bound = bound.withColumn("full", F.col("bound") / F.col("weight"))
    sums = bound.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    budget, all_weights = share * (sums["s"] or 0), sums["w"] or 0
    rows = in_order(bound, [F.col("full"), F.col("source")], "mix-bounds")
    spent = running(rows, [], "bound", "weight")
    level = (F.lit(budget) - F.col("bound_before")) / (F.lit(all_weights) - F.col("weight_before"))
    least = spent.where(level <= F.col("full")).agg(F.min_by(level, F.struct("full", "source")).alias("level")).first()["level"]
    at = F.lit(float("inf") if least is None else least)
    return bound.select(
        "source", "source_size", F.when(F.col("full") <= at, F.col("bound").cast("double")).otherwise(at * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", share: float = SHARE, weights: tuple[int, ...] = WEIGHTS,
        epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """How many words of each document the mix takes, repeats counted: (key, size, source_size, target, taken)."""
    rows = pick(docs, key, source, text)
    sized = rows.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), words(F.col(text)).alias("size"))
    drawn = sized.select(
        "id", "source", "size", (-F.log(uniform(F.col("id"), seed)) / quality_weight(F.col("text"), F.col("size"))).alias("draw")
    )
    order = [F.col("source").asc_nulls_last(), F.col("draw"), F.col("id"), F.col("size")]
    ordered = in_order(stage(drawn, "mix-sizes"), order, "mix-draws")
    wanted = targets(ordered.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, epochs)
    wanted = wanted.withColumnRenamed("source", "source_")
    before = running(ordered, ["source"], "size")
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    left = F.floor(F.col("target") - whole * size).cast("long")
    return before.join(wanted, F.col("source").eqNullSafe(F.col("source_"))).select(
        F.col("id").alias(key), F.col("size"), "source_size", "target",
        (whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("size_before")))).alias("taken"),
    )


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    return mix(table(spark, sf_dir, "documents"))


def _sql_text(chars: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in chars)


OP12_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), stats AS (
  SELECT *, length(text) AS chars, length(text) - length(translate(text, {_sql_text(OTHER)}, '')) AS marks,
    length(translate(text, {_sql_text(OTHER + SPACE)}, '')) AS letters, length(text) - length(translate(text, '.!?', '')) AS ends
  FROM sized
), drawn AS (
  SELECT doc_id, source, size,
    -ln((('0x' || md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / (1 + coalesce(size > 0 AND letters BETWEEN 2 * size AND 12 * size, false)::INT + coalesce(size > 0 AND marks * 8 <= chars, false)::INT
       + coalesce(ends > 0 AND ends * 40 >= size, false)::INT) AS draw
  FROM stats
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM drawn GROUP BY source
), bounds AS (
  SELECT *, 2 * source_size AS bound, 2 * source_size / weight AS full_at FROM sources
), levels AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM bounds) - coalesce(sum(bound) OVER before, 0)::DOUBLE)
    / ((SELECT sum(weight) FROM bounds) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM bounds WINDOW before AS (ORDER BY full_at, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), wanted AS (
  SELECT source, source_size, CASE WHEN full_at <= l THEN bound::DOUBLE ELSE l * weight END AS target
  FROM bounds, (SELECT arg_min(level, (full_at, source)) AS l FROM levels WHERE level <= full_at)
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM drawn
), epochs AS (
  SELECT p.*, w.source_size, w.target, CASE WHEN w.source_size > 0 THEN floor(w.target / w.source_size) ELSE 0 END::BIGINT AS epochs
  FROM placed p JOIN wanted w ON w.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)) AS taken
FROM epochs
"""
