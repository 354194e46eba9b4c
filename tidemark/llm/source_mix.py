"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The documents of a source are shuffled by a keyed hash and laid end to end; the stream starts again
when it is used up. It is cut into blocks of ``block_words`` words. Slot ``n`` of the mix has the golden-ratio point
frac((n + 1) * phi); the source whose share of the slots holds this point supplies its next block. The
sequence spreads every source evenly over the mix. All steps are joins, groupings and windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved

GOLDEN = 0.6180339887498949
WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of the shuffle key that name a part of a source, so that no task holds a whole source.
_PART_DIGITS = 3
#: Slots whose source ranks are counted together first.
_SLOT_CHUNK = 16384

WORDS = r"cast(size(array_remove(split(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), '')) AS bigint)"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """Targets of all sources: number, source, source_size, target.

    ``sizes`` has the columns source and source_size. Sources in the order of their names, null last, take the
    weights in turn. Targets share the total by weight; none is above ``most`` times its source's size, and what is
    cut off is shared again by weight until none is above. The level of that sharing is the
    largest (total - caps before) / (weights before left out), over sources in the order of cap / weight.
    """
    weighted = sizes.selectExpr(
        "source", "source_size", "cast(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS int) AS number"
    ).selectExpr("*", f"cast(array({', '.join(map(str, weights))})[number % {len(weights)}] AS bigint) AS weight")
    levelled = weighted.selectExpr(
        "*",
        f"(sum(source_size) OVER () - coalesce(sum({most} * source_size) OVER ({_BEFORE.format(most=most)}), 0)) / "
        f"cast(sum(weight) OVER () - coalesce(sum(weight) OVER ({_BEFORE.format(most=most)}), 0) AS double) AS level",
    )
    return levelled.selectExpr(
        "number", "source", "source_size",
        f"least(cast({most} * source_size AS double), max(level) OVER () * weight) AS target",
    )


_BEFORE = "ORDER BY {most} * source_size / cast(weight AS double), number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def schedule(quotas: DataFrame) -> DataFrame:
    """Slots of the mix: number (of the source), block, position.

    ``quotas`` has number and blocks (how many the source supplies; one row per source). Slots are ranked per
    source; ranks from ``blocks`` on stay empty, and the few blocks that the sequence leaves out come at the end.
    """
    spark = quotas.sparkSession
    placed = quotas.where("blocks > 0").selectExpr(
        "number", "blocks",
        "coalesce(sum(blocks) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
        "sum(blocks) OVER () AS total",
    )
    slots, sources = quotas.selectExpr("coalesce(sum(blocks), 0)", "count(1)").first()
    if not slots:
        return spark.createDataFrame([], "number int, block bigint, position bigint")
    cells = 4 * sources + 1024
    share = placed.selectExpr("number", "blocks", "before / cast(total AS double) AS low", "(before + blocks) / cast(total AS double) AS high")
    # A guide by cells of equal width makes finding the interval of a point an equality join.
    guide = share.withColumn("cell", F.expr(f"explode(sequence(cast(floor(low * {cells}) AS int), cast(floor(high * {cells}) AS int)))"))
    points = spark.range(slots).selectExpr("id AS n", f"(id + 1) * {GOLDEN}D - floor((id + 1) * {GOLDEN}D) AS point")
    points = points.withColumn("cell", F.expr(f"cast(floor(point * {cells}) AS int)"))
    dealt = points.join(guide, "cell").where("low <= point AND point < high")
    dealt = dealt.selectExpr("n", "number", "blocks", f"n div {_SLOT_CHUNK} AS chunk")
    counts = dealt.groupBy("number", "chunk").agg(F.count("*").alias("here"))
    counts = counts.selectExpr(
        "number", "chunk",
        "coalesce(sum(here) OVER (PARTITION BY number ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier",
    )
    ranked = dealt.selectExpr("*", "row_number() OVER (PARTITION BY number, chunk ORDER BY n) - 1 AS within")
    ranked = ranked.join(counts, ["number", "chunk"]).selectExpr("number", "blocks", "earlier + within AS block", "n AS position")
    used = ranked.groupBy("number").agg(F.count("*").alias("used"))
    rest = quotas.join(used, "number", "left").where("coalesce(used, 0) < blocks").selectExpr(
        "number", "coalesce(used, 0) AS used", "explode(sequence(coalesce(used, 0), blocks - 1)) AS block"
    )
    rest = rest.selectExpr("number", "block", f"{slots}L + number + {sources}L * (block - used) AS position")
    return ranked.where("block < blocks").select("number", "block", "position").unionByName(rest)


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    most: int = 3,
    block_words: int = 512,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, first_position, and ``carry`` as a struct ``row``.

    size is the number of words (null: 0); taken counts the words that the mix takes of this document, those
    of every pass over its source; no document is taken more than ``most`` times. first_position is the earliest
    slot with words of it, null when none are taken. Each source supplies floor(target) words.

    A null source is a source of its own. Rows that repeat an id, or whole rows, are documents of their
    own. Rows without an id are shuffled by their text. Nothing depends on how the rows are partitioned.
    """
    key = f"md5(concat('{seed}:', coalesce(cast(`{id_col}` AS string), concat('text ', coalesce(`{text_col}`, '')))))"
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")
    sized = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
        F.expr(WORDS.format(f"`{text_col}`")).alias("size"), F.expr(key).alias("key"), row.alias("row"),
    )
    parts = saved(
        sized.groupBy("source", F.expr(f"substr(key, 1, {_PART_DIGITS})").alias("part")).agg(F.sum("size").alias("words")), "mix-parts"
    )
    sources = saved(source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "mix-targets")
    # A source has at most 16 ** _PART_DIGITS parts, so their order is a small window.
    offsets = _placed_parts(parts, sources)
    keyed = sized.withColumn("part", F.expr(f"substr(key, 1, {_PART_DIGITS})"))
    started = keyed.withColumn(
        "within",
        F.expr(
            "coalesce(sum(size) OVER (PARTITION BY source, part ORDER BY key, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        ),
    )
    placed = started.join(offsets, F.expr("source <=> its_source AND part = its_part")).selectExpr(
        "id", "size", "row", "number", "source_size", "target", "before + within AS start"
    )
    quotas = sources.selectExpr("number", f"cast(ceil(floor(target) / {block_words}.0D) AS bigint) AS blocks")
    pieces = placed.where("size > 0 AND start < floor(target)").selectExpr(
        "number", "start", "size", "cast(floor(target) AS bigint) AS quota",
        f"explode(filter(transform(sequence(0L, {most}L), e -> start + e * source_size), s -> s < floor(target))) AS low",
    )
    pieces = pieces.selectExpr("number", "start", "low", "least(low + size, quota) AS high").selectExpr(
        "number", "start", "low", "high", f"explode(sequence(low div {block_words}, (high - 1) div {block_words})) AS block"
    )
    joined = pieces.join(schedule(quotas), ["number", "block"]).groupBy("number", "start").agg(
        F.expr(f"sum(least(high, (block + 1) * {block_words}) - greatest(low, block * {block_words})) AS taken"),
        F.min("position").alias("first_position"),
    )
    joined = joined.withColumnsRenamed({"number": "of", "start": "at"})
    return placed.join(joined, F.expr("number = of AND start = at AND size > 0"), "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.expr("coalesce(taken, 0L) AS taken"), "first_position", "row"
    )


def _placed_parts(parts: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.withColumnRenamed("source", "name")
    return parts.selectExpr(
        "source AS its_source", "part AS its_part",
        "coalesce(sum(words) OVER (PARTITION BY source ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
    ).join(named, F.expr("its_source <=> name")).drop("name")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a document comes once for every whole time it is taken,
    and once more with its first words when a part of it is taken; n_chars, where there is one, is counted anew.
    """
    mixed = mix_sources(docs, carry=docs.columns, **options).where("taken > 0").selectExpr(
        "row", "size", "taken", "explode(sequence(1L, cast(ceil(taken / cast(size AS double)) AS bigint))) AS copy"
    )
    text = r"IF(copy * size <= taken, row.text, array_join(slice(array_remove(split(row.text, '[\\x20\\x09-\\x0D]+'), ''), 1, cast(taken % size AS int)), ' '))"
    mixed = mixed.withColumn("text", F.expr(text))
    made = {"text": "text", "n_chars": "cast(char_length(text) AS bigint)"}
    return mixed.selectExpr(*[f"{made.get(c, f'row.`{c}`')} AS `{c}`" for c in docs.columns])
