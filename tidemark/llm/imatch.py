"""I-Match fingerprints with randomised lexicon subsets, in native expressions.

The lexicon holds the terms whose inverse document frequency lies in a band. A text keeps its distinct
lexicon terms in sorted order; one hash covers all of them, and one hash covers those in each of several
random subsets of the lexicon, of several sizes. An edit changes only the hashes of subsets that hold one of the terms
it touches, so the share of equal hashes grades the likeness of two texts.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved

#: Band of ln(documents / documents with the term): in 37 % of the documents at most, in 0.25 % at least.
MIN_IDF, MAX_IDF = 1.0, 6.0
#: A term is in a subset when the first four hexadecimal digits of its keyed hash are below the limit.
SUBSETS = tuple(limit for limit in ("1000", "0800", "0400", "0200", "0100", "0080") for _ in range(4))
#: The lexicon is broadcast up to this many terms, some tens of megabytes. It has at most (distinct terms of a
#: mean document) * exp(MAX_IDF) terms, whatever the number of documents. Beyond the limit it is joined by shuffling.
BROADCAST_TERMS = 500_000

_TERMS = r"array_distinct(array_remove(split(lower({}), '[\\x20\\x09-\\x0D]+'), ''))"
#: Fingerprints of texts without lexicon terms begin so.
_BARE = "text-"


def lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, subsets): terms in the band, with the subsets they belong to as bits. All documents count."""
    n = docs.count()
    found = docs.select(F.explode(F.expr(_TERMS.format(f"`{text_col}`"))).alias("term")).groupBy("term").count()
    bits = " + ".join(
        f"IF(substr(md5(concat('{k}:', term)), 1, 4) < '{limit}', {1 << k}L, 0L)" for k, limit in enumerate(SUBSETS)
    )
    band = f"count >= {n * exp(-MAX_IDF)!r}D AND count <= {n * exp(-MIN_IDF)!r}D"
    return found.where(band).select("term", F.expr(f"{bits} AS subsets"))


def fingerprint(terms: str, digest: str) -> Column:
    """The fingerprint from an array of (term, subsets) and a digest of the text for texts without terms."""
    hashed = "substr(md5(array_join(transform({}, t -> t.term), ' ')), 1, 8)"
    chosen = f"transform(array(sort_array({terms})), s -> concat_ws('-', {hashed.format('s')}, {{}}))[0]"
    # A subset without terms of the text has an empty place.
    parts = ", ".join(
        f"transform(array(filter(s, t -> t.subsets & {1 << k}L > 0L)), u -> IF(size(u) = 0, '', {hashed.format('u')}))[0]"
        for k in range(len(SUBSETS))
    )
    return F.expr(f"IF(size({terms}) = 0, concat('{_BARE}', substr({digest}, 1, 32)), {chosen.format(parts)})")


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes among the subsets that hold a term of one text at least; 1 for equal fingerprints."""
    pairs = f"zip_with(split({a}, '-'), split({b}, '-'), (x, y) -> struct(x, y))"
    return F.expr(
        f"CASE WHEN {a} = {b} THEN 1.0D WHEN startswith({a}, '{_BARE}') OR startswith({b}, '{_BARE}') THEN 0.0D "
        f"ELSE transform(array(filter({pairs}, p -> p.x <> '' OR p.y <> '')), "
        "q -> cast(size(filter(q, p -> p.x = p.y)) AS double) / size(q))[0] END"
    )


def _next_documents(docs: DataFrame) -> DataFrame:
    """(key, hash, id, n, copies, next_key, next_hash): each distinct (id, text) and the next one; after the last the first.

    Only ids move: they are range-partitioned, a row finds its successor inside its slice, and the last row of a
    slice takes the first row of the next slice.
    """
    ids = docs.groupBy("id", "key", "hash").agg(F.max(F.char_length("text")).alias("n"), F.count("*").alias("copies"))
    ids = saved(ids.repartitionByRange(F.col("id"), F.col("hash")).withColumn("slice", F.spark_partition_id()), "next-ids")
    inside = ids.selectExpr("*", "lead(struct(key, hash)) OVER (PARTITION BY slice ORDER BY id, hash) AS follower")
    # One row for each slice.
    heads = ids.groupBy("slice").agg(F.expr("min_by(struct(key, hash), struct(id, hash)) AS head")).selectExpr(
        "slice AS its_slice",
        "coalesce(lead(head) OVER (ORDER BY slice), first(head) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS wrap",
    )
    linked = inside.join(heads, F.expr("slice = its_slice")).withColumn("after", F.expr("coalesce(follower, wrap)"))
    return linked.selectExpr("key", "hash", "id", "n", "copies", "after.key AS next_key", "after.hash AS next_hash")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many of the
    next document's, by ascending id and for equal ids by a hash of the text; after the last comes the first.
    Null texts count as empty; a text without lexicon terms has a fingerprint of the whole text. Rows that
    repeat id and text have the same result each. Rows without an id come first in the order. Other columns
    of ``docs`` are not looked at.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.expr(f"coalesce(`{text_col}`, '') AS text"))
    terms = saved(lexicon(docs), "lexicon")
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    # Joins and groupings share one partitioning by (key, hash), hashes of the id and of the text, never null.
    docs = docs.selectExpr("id", "xxhash64(id) AS key", "xxhash64(text) AS hash", "text")
    chain = saved(_next_documents(docs), "next")

    # The exchange of (key, hash, text) serves both joins; only the part that an edit needs moves again.
    wanted = chain.selectExpr("next_key AS key", "next_hash AS hash", "key AS to_key", "hash AS to_hash", "n div 2 AS half")
    heads = docs.join(wanted, ["key", "hash"]).selectExpr(
        "to_key AS key", "to_hash AS hash", "half", "substr(text, 1, cast(half AS int)) AS head"
    )
    both = docs.join(heads, ["key", "hash"]).selectExpr(
        "key", "hash",
        "stack(2, 0, text, 1, concat(substr(text, 1, char_length(text) - cast(half AS int)), head)) AS (edited, body)",
    )
    # An empty term at the end of each list carries what belongs to the text as a whole.
    listed = both.selectExpr(
        "key", "hash", "edited", "char_length(body) AS n", "sha2(body, 256) AS digest",
        f"explode(array_append({_TERMS.format('body')}, '')) AS term",
    ).selectExpr("key", "hash", "edited", "term", "IF(term = '', struct(n, digest), null) AS whole")
    kept = listed.join(terms, "term", "left").where("whole IS NOT NULL OR subsets IS NOT NULL")
    gathered = kept.groupBy("key", "hash", "edited").agg(
        F.expr("collect_set(IF(subsets IS NULL, null, struct(term, subsets))) AS terms"), F.expr("max(whole) AS whole")
    )
    marked = gathered.select("key", "hash", "edited", "whole", fingerprint("terms", "whole.digest").alias("mark"))
    stored = saved(
        marked.groupBy("key", "hash").agg(
            F.expr("max(IF(edited = 0, cast(whole.n AS bigint), null)) AS n_chars"),
            F.expr("max(IF(edited = 1, whole.digest, null)) AS edited_sha256"),
            F.expr("max(IF(edited = 0, mark, null)) AS fingerprint"),
            F.expr("max(IF(edited = 1, mark, null)) AS edited_fingerprint"),
        ),
        "marks",
    )
    following = stored.selectExpr("key AS next_key", "hash AS next_hash", "fingerprint AS next_fingerprint")
    keys = chain.select("key", "hash", "id", "copies", "next_key", "next_hash")
    joined = stored.join(keys, ["key", "hash"]).join(following, ["next_key", "next_hash"])
    return joined.withColumn("copy", F.expr("explode(sequence(1L, copies))")).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
