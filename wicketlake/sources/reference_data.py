"""Small reference inputs: knowledge entries and player aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicketlake.functions.text import normalize_text, unique_non_empty
from wicketlake.schemas import KNOWLEDGE_DDL


def read_knowledge(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Entries with an id, a title and an answer; list values trimmed and distinct. Malformed files are skipped."""
    raw = spark.read.schema(KNOWLEDGE_DDL).option("multiLine", True).option("mode", "DROPMALFORMED").json(paths)
    none = F.array().cast("array<string>")
    texts = ["id", "category", "sub_intent", "title", "answer"]
    lists = ["aliases", "keywords", "examples", "related_topics"]
    rows = raw.select(
        *[F.trim(F.coalesce(c, F.lit("general" if c == "category" else ""))).alias(c) for c in texts],
        *[unique_non_empty(F.coalesce(c, none)).alias(c) for c in lists],
    )
    return rows.filter("id != '' AND title != '' AND answer != ''").select(
        "id", "category", "sub_intent", "title", "aliases", "keywords", "answer", "examples", "related_topics"
    )


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(``alias_norm``, ``alias``, ``canonical``) from a JSON object of alias to canonical name."""
    text = spark.read.option("wholetext", True).text(path)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("alias", "canonical"))
    # A canonical name is an alias of itself.
    both = pairs.select(F.explode(F.array("alias", "canonical")).alias("alias"), F.trim("canonical").alias("canonical"))
    named = both.select(normalize_text("alias").alias("alias_norm"), F.trim("alias").alias("alias"), "canonical").filter(
        "alias_norm != '' AND canonical != ''"
    )
    # Aliases that agree after normalising agree on the canonical name.
    return named.groupBy("alias_norm").agg(F.min("alias").alias("alias"), F.min("canonical").alias("canonical"))
