"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

1. Each text is normalised (runs of ASCII white space become one space) and
   cut into chunks at content-defined places: after a space that follows one
   of a few letters, never before ``MIN_CHUNK`` characters of a chunk and at
   ``MAX_CHUNK`` at the latest.  The cut depends on the text alone, so equal
   texts have equal chunk lists.
2. Chunks are deduplicated: a chunk's SHA-256 is its identifier once an
   aggregation over (identifier, chunk text) has shown that no identifier
   stands for two different texts.  This is the only shuffle that carries text,
   and repeated chunks are merged before it.  Should an identifier ever stand
   for two texts, the chunk texts themselves become the identifiers.
3. A document is its ordered list of verified identifiers (its recipe), which
   is what gets compared: groups are formed on the lists.

Defined results: null text counts as empty; the empty text is a recipe of no
chunks and forms a group like any other; of rows with the smallest doc_id of a
group exactly one is kept, also when that row is repeated; null doc_ids sort
last; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import stored, text_or_empty, unused

SPACE_RUN = r"[\x20\x09-\x0D]+"
MIN_CHUNK = 1024
MAX_CHUNK = 8192
CUT_AFTER = "[aeiy.,] "  # a cut follows one of these letters and a space


def normalised(col: str = "text"):
    return F.regexp_replace(text_or_empty(col), SPACE_RUN, " ")


def _chunks(text):
    pattern = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 2}}}?{CUT_AFTER}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _id(chunk):
    return F.unhex(F.sha2(chunk, 256))


def with_recipes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``__chunks`` (array of chunk texts) and ``text_sha256`` of the normalised text."""
    norm = docs.withColumn("__norm", normalised(text))
    return (norm.withColumn("__chunks", _chunks(F.col("__norm")))
                .withColumn("text_sha256", F.sha2(F.col("__norm"), 256)).drop("__norm"))


def ambiguous_ids(recipes: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk text: none, unless SHA-256 collides.

    Repeated chunks are merged before the shuffle, so a chunk held by a third
    of all rows stays cheap.
    """
    chunk = recipes.select(F.explode("__chunks").alias("chunk")).withColumn("id", _id(F.col("chunk")))
    distinct = chunk.groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")


def recipe_keys(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, recipe (list of verified identifiers), text_sha256."""
    recipes = with_recipes(docs)
    if ambiguous_ids(recipes).isEmpty():
        ids = F.transform("__chunks", _id)
    else:  # the digest proves nothing here: the chunk itself is the identifier
        ids = F.transform("__chunks", lambda c: F.encode(c, "UTF-8"))
    return recipes.select("doc_id", ids.alias("recipe"), "text_sha256")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per row of ``docs``."""
    rows = stored(recipe_keys(docs)
                  .withColumn("rid", F.monotonically_increasing_id()), "exact-rows")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    groups = (rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("k"))
              .filter("group_size > 1")
              .select("recipe", "group_size", F.col("k.d").alias("keep_id"), F.col("k.r").alias("keep_rid")))
    # stored, so that both sides of the join are plain shuffles, which the skew
    # join may split where a third of all rows share one recipe
    groups = stored(groups, "exact-groups")
    alone = F.col("group_size").isNull()
    return (rows.join(groups, "recipe", "left")
            .select("doc_id",
                    F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
                    "text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, all columns as they were.

    Of a row repeated whole (same doc_id and normalised text) one stays; if the
    repeats differ in other columns, which one is left open.
    """
    key = F.unhex(F.sha2(normalised(), 256))
    id_, sha, digest = unused(docs, "__d", "__s", "__key")
    fate = exact_groups(docs).groupBy("doc_id", "text_sha256").agg(
        F.sum(F.col("kept").cast("long")).alias("keep"), F.count(F.lit(1)).alias("n"))
    fate = stored(fate.filter("keep < n").select(
        F.col("doc_id").alias(id_), F.unhex("text_sha256").alias(sha), "keep"), "exact-lost")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (key == F.col(sha))
    rest = docs.join(fate.filter("keep = 0"), same, "left_anti")
    repeated = fate.filter("keep > 0")
    if repeated.isEmpty():
        return rest
    once = (rest.join(repeated, same, "left_semi").withColumn(digest, key)
            .dropDuplicates(["doc_id", digest]).drop(digest))
    return rest.join(repeated, same, "left_anti").unionByName(once)
