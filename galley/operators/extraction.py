"""Whether what was extracted from a text is in it, and whether enough of the text was extracted."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.text import evidence
from galley.operators.matching import token_overlap
from galley.sources.tables import tasks_for

# What stands alone on a line above ingredients, above steps and behind both, and what labels a yield.
INGREDIENT_HEADINGS = ["ingredient", "ingredients", "ingredient checklist", "what you'll need", "what you’ll need"]
STEP_HEADINGS = ["direction", "directions", "instruction", "instructions", "method", "preparation", "procedure", "steps"]
TAIL_HEADINGS = ["special equipment", "equipment", "note", "notes", "nutrition", "nutrition facts", "read more", "related recipe", "related recipes", "review", "reviews"]
YIELD_LABELS = ["yield", "serving", "servings", "serves", "makes"]
#: The least share of a region's words that an extraction has.
LEAST = 0.88


def _line(labels: list[str], behind: str = r"\s*$") -> str:
    return rf"(?im)^\s*(?:{'|'.join(labels)})\s*:?{behind}"


def _evidences(lines: Column | str) -> Column:
    """``evidence`` of each text of an array; null is empty."""

    @F.pandas_udf("array<string>")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda texts: [re.sub(r"\W+", " ", unicodedata.normalize("NFKC", t or "").casefold()).strip() for t in texts])

    return of(lines)


def checked(docs: DataFrame, whole: bool = False, least: float = LEAST) -> DataFrame:
    """(id, issues, coverage): what is wrong with each extraction; none for one that stands.

    docs: id, source, title, yield_text, ingredients, steps (arrays of text). Ingredients and steps have to be copied from the
    source, a labelled yield has to be there, and a title may not be an address. Where the source has both headings, coverage is the
    lesser share of the words of its two regions and has to reach ``least``; else it is the share of the whole source, which has to
    reach it only if ``whole`` is set. A source without a word is covered; nulls are empty.
    """
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(
        "id", text("source").alias("source"), text("title").alias("title"), text("yield_text").alias("yield_text"),
        F.coalesce("ingredients", none).alias("ingredients"), F.coalesce("steps", none).alias("steps"),
    )
    parts = F.split("source", _line(INGREDIENT_HEADINGS), 2)
    later = F.split(F.get(parts, F.lit(1)), _line(STEP_HEADINGS), 2)
    rows = rows.withColumns({"first": F.get(later, F.lit(0)), "second": F.get(F.split(F.get(later, F.lit(1)), _line(TAIL_HEADINGS), 2), F.lit(0))})
    both = F.col("second").isNotNull() & ~F.rlike(F.get(parts, F.lit(0)), F.lit(_line(STEP_HEADINGS)))
    rows = rows.withColumns(
        {"both": both, "said": evidence(F.col("source")), "i": _evidences("ingredients"), "s": _evidences("steps"), "t": _evidences(F.array("title", "yield_text"))}
    )
    rows = rows.withColumns({"first": evidence(F.coalesce("first", F.lit(""))), "second": evidence(F.coalesce("second", F.lit("")))})

    def region(name: str, source: str, found: Column) -> Column:
        return F.struct(F.lit(name).alias("region"), F.col(source).alias("source"), found.alias("found"))

    parted = F.array(region("i", "first", F.col("i")), region("s", "second", F.col("s")))
    every = F.array(region("w", "said", F.concat("t", "i", "s")))
    regions = rows.select("id", F.explode(F.when(F.col("both"), parted).otherwise(every)).alias("r")).select("id", "r.*")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    # Dealt before they are words, by their number: the words of a document are counted in its task and not dealt out in turn.
    regions = regions.repartition(tasks_for(docs), "id")
    shared = token_overlap(regions, ["id", "region"], words(F.col("source")), words(F.array_join("found", " ")))
    share = F.when(F.col("n_source") == 0, 1.0).otherwise(F.col("both") / F.col("n_source"))
    covered = shared.groupBy("id").agg(F.min(share).alias("coverage"))

    missing = lambda c: F.exists(c, lambda x: ~F.contains(F.col("said"), x))
    address = F.rlike(F.btrim("title"), F.lit(r"(?i)^(?:https?://)?(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+/?$"))
    issues = {
        "title is an address or empty": address | (F.get("t", F.lit(0)) == ""),
        "title not in the source": ~F.contains("said", F.get("t", F.lit(0))),
        "ingredient not in the source": missing("i"),
        "step not in the source": missing("s"),
        "yield left out": F.rlike("source", F.lit(_line(YIELD_LABELS, r"\s*\S+"))) & (F.col("yield_text") == ""),
        "content left out": (F.col("coverage") < least) & (F.col("both") | F.lit(whole)),
    }
    found = F.array_compact(F.array(*[F.when(wrong, name) for name, wrong in issues.items()]))
    return rows.join(covered, "id").select("id", found.alias("issues"), "coverage")
