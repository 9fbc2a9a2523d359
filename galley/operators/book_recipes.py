"""Recipes in books: lists of ingredients as islands in the order of a book's blocks, the title before each, and the method after.

Whether a block continues a list depends on its neighbours alone, so lists are islands of a window over the blocks of a book. The
title of a list is the last title before it, not before the list before and no more than ``LOOK_BACK`` blocks back.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.sources.tables import materialise

LOOK_BACK = 40

#: Blocks that one task reads recipes from, about: each of its windows holds some of them.
TASK_BLOCKS = 250_000

# Units, words of amount, foods that stand without an amount, and how labels and notes begin.
UNITS = (
    "cup cups c. tablespoon tablespoons tbsp tbsp. teaspoon teaspoons tsp tsp. ounce ounces oz oz. pound pounds lb lbs lb. lbs. gram grams g kg "
    "kilogram kilograms ml milliliter milliliters liter liters l quart quarts qt qt. pint pints clove cloves head heads bunch bunches sprig "
    "sprigs stalk stalks slice slices piece pieces can cans stick sticks pinch pinches dash dashes large medium small whole inch -inch"
).split()
NUMBER_WORDS = "one two three four five six eight ten twelve a an half pinch dash".split()
PART_WORDS = ["juice of", "zest of"]
BARE_FOODS = [
    "kosher salt", "salt", "sea salt", "freshly ground", "ground black pepper", "black pepper", "pepper", "vegetable oil", "canola oil",
    "peanut oil", "olive oil", "neutral oil", "extra-virgin olive oil", "sugar", "water", "ice", "cooking spray", "nonstick", "flaky",
    "lemon wedges", "lime wedges", "steamed rice", "cooked rice",
]
SUBHEADS = ["for", "to finish", "to serve", "to garnish", "garnish", "topping"]
YIELDS = ["serves", "makes", "makess", "servess", "yield", "yields"]
LABELS = ["yield", "serves", "makes", "active time", "total time", "prep time", "cook time", "time"]
NO_TITLES = [
    "experiment", "sidebar", "ingredient", "ingredients", "direction", "directions", "method", "instruction", "instructions", "preparation",
    "note", "notes", "yield", "serves", "makes", "active time", "total time", "prep time", "cook time", "equipment", "contents", "index",
]
NOTES = ["note", "notes", "tip", "tips", "variation", "variations", "make ahead", "to store", "storage"]
PROSE_CLASSES = ["meth", "step", "direct", "instr", "proc", "headnote", "intro"]
METHOD_CLASSES = ["meth", "step", "direct", "instr", "proc", "number"]
TITLE_CLASSES = ["title", "rt", "rh", "recipe-name", "recipename", "head", "_hd", "hd_"]


def begins(text: Column, starts: list[str]) -> Column:
    """Whether a text begins with one of the phrases as whole words, in any case."""
    return F.rlike(F.lower(text), F.lit("^(?:" + "|".join(re.escape(s) for s in starts) + r")(?!\w)"))


def holds(classes: Column, keys: list[str]) -> Column:
    return reduce(or_, (F.lower(classes).contains(k) for k in keys))


def word(text: Column, k: int) -> Column:
    """The k-th word, from 1; empty beyond the last."""
    return F.coalesce(F.get(F.split(text, " "), k - 1), F.lit(""))


def shape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[½¼¾⅓⅔⅛⅜⅝⅞]", "0/0"), "[0-9]+", "0")


def amount_first(text: Column) -> Column:
    """Whether a line begins with an amount and then a unit, a bracket or a word in small letters."""
    plain = F.ltrim(F.regexp_replace(text, r"^\(", ""))
    numbers = ["0", "0.0", "0,0", "0-0", "0–0", "0/0", "00/0"]
    number = shape(word(plain, 1)).isin(numbers)
    whole = number & (shape(word(plain, 2)) == "0/0")
    after = F.when(whole, word(plain, 3)).otherwise(word(plain, 2))
    follows = F.rlike(after, F.lit(r"^[(a-z]")) | F.lower(F.regexp_replace(after, "[,;:]+$", "")).isin(UNITS)
    stuck = F.rlike(shape(word(plain, 1)), F.lit(r"^0(?:[.,/]0)?-?[a-z(]"))
    spelled = F.lower(word(text, 1)).isin(NUMBER_WORDS) & (word(text, 2) != "")
    part = F.lower(F.concat_ws(" ", word(text, 1), word(text, 2))).isin(PART_WORDS) & (word(text, 3) != "")
    return (number & follows) | stuck | spelled | part


def classified(blocks: DataFrame, book: str) -> DataFrame:
    """Blocks with what each can be by itself: ingredient, bare food, subhead, title, label, note, numbered step."""
    text, classes, kind = F.col("text"), F.coalesce(F.lower("classes"), F.lit("")), F.col("kind")
    size, n = F.length(text), F.size(F.split(text, " "))
    words = lambda *ends: F.rlike(classes, F.lit(r"\b(?:" + "|".join(ends) + r")\b"))
    head_class = words(r"ing-?(?:h|hb|ts|head\w*|sub\w*)")
    listed = words(r"ing(?:r\w*|-?(?:list|item|line)\w*)", "ingredient") & ~head_class
    prose = F.rlike(text, F.lit(r"[.!?][\"”’)]?\s+[A-Z]"))
    section = begins(text, SUBHEADS)
    other = begins(text, NO_TITLES) | F.rlike(F.lower(text), F.lit(r"^(?:acknowledg|copyright)\w*"))
    numbered_head = F.rlike(text, F.lit(r"^[0-9]+(?:(?:\.[0-9]+)+\s| [A-Z]{3}|°)"))
    no_title = other | numbered_head
    label = F.lower(F.rtrim(F.regexp_replace(text, ":$", ""))).isin(LABELS) | (no_title & (n <= 2))
    yields = begins(text, YIELDS) | F.rlike(F.lower(text), F.lit("^for (?:about )?[0-9]"))
    is_text = kind == "text"
    by_amount = ~holds(classes, PROSE_CLASSES) & ~prose & amount_first(text)
    short = size <= F.when(listed, 320).otherwise(180)
    ingredient = is_text & short & ~(F.coalesce("cell", F.lit(False)) & ~listed) & ~label & ((listed & ~section) | by_amount)
    bare = is_text & (size <= 90) & ~prose & ~label & (begins(text, BARE_FOODS) | listed)
    no_colon = F.regexp_replace(text, ":+$", "")
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    heads = section | head_class | ((kind == "heading") & (F.col("level") >= 3)) | (classes.contains("head") & (n <= 6)) | (upper & (n <= 5))
    subhead = (F.length(no_colon) <= 60) & ~prose & ~no_colon.endswith(".") & ~label & heads
    named = (kind == "heading") | (is_text & upper & (n <= 14)) | holds(classes, TITLE_CLASSES)
    title = ~no_title & ~yields & ~section & (size <= 110) & ~F.rlike(text, F.lit("[.:]$")) & named & (kind != "image")
    number = F.rlike(text, F.lit(r"^(?i:step ?)?[0-9]{1,2}(?: ?[.):]|\s+(?=[A-Z]))"))
    facts = {
        "ingredient": ingredient, "listed": listed, "bare": bare, "subhead": subhead & (kind != "image"), "section": section, "title": title,
        "label": label, "yields": yields, "prose": prose, "numbered": number | holds(classes, METHOD_CLASSES),
        "note": begins(text, NOTES) & (size > 12), "lettered": F.rlike(text, F.lit(r"^[a-h][.)]\s+\S")), "image": kind == "image",
    }
    # The place in the book first: a block is dealt to its book before it has its facts.
    order = Window.partitionBy("book").orderBy("place")
    rows = blocks.filter("text is not null or kind = 'image'").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select(F.col(book).alias("book"), "place", "text", "level", "kind", "classes", "cell").withColumn("at", F.row_number().over(order) - 1)
    return rows.select(
        "book", "place", "text", F.coalesce("level", F.lit(0)).alias("level"), "kind", classes.alias("classes"),
        *[F.coalesce(v, F.lit(False)).alias(k) for k, v in facts.items()], "at",
    )


def marked(rows: DataFrame) -> DataFrame:
    """Blocks with what lists are found by: the island of each that goes on, where its list would begin, the last title before that.

    The title is the last one before the bare foods and sections right before a food, with which its list begins.
    """
    order = Window.partitionBy("book").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    food = F.col("ingredient")
    near = lambda c, k: F.coalesce(F.lead(c, k).over(order), F.lit(False))
    ahead = near("ingredient", 1) | near("bare", 1) | near("ingredient", 2) | near("bare", 2)
    styled = (F.col("classes") != "") & (F.col("classes") == F.lag("classes").over(order))
    between = near("ingredient", 1) & ~F.col("prose")
    member = (F.col("kind") == "text") & (F.length("text") <= 320) & ~F.col("label") & ~F.col("title") & ~F.col("yields")
    member &= F.coalesce(F.lag("ingredient").over(order), F.lit(False)) & (styled | between)
    goes_on = food | F.col("image") | F.col("bare") | (F.col("subhead") & ahead) | member
    opens = F.col("bare") | (F.col("subhead") & F.col("section"))
    got = rows.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("titled", F.max(F.when(F.col("title"), F.col("at"))).over(order))
    got = got.withColumn("island", F.count_if(~F.col("goes_on")).over(order)).withColumn("size", F.count("*").over(Window.partitionBy("book")))
    opened = F.last(F.when(~opens, F.struct((F.col("at") + 1).alias("at"), "titled")), ignorenulls=True).over(before)
    return got.withColumn("opened", opened).drop("titled")


def lists(rows: DataFrame) -> DataFrame:
    """(book, start, end, title_at, stop) of the ingredient lists in each book; title_at is null where there is no title."""
    food = F.col("ingredient")
    inside = rows.filter("goes_on").groupBy("book", "island").agg(
        F.min(F.when(food, F.col("at"))).alias("first"),
        F.min_by("opened", F.when(food, F.col("at"))).alias("opened"),
        (F.max("at") + 1).alias("end"),
        F.count_if("ingredient").alias("strong"),
        F.max("listed").alias("any_listed"),
        F.max("size").alias("size"),
    )
    found = inside.filter((F.col("strong") >= 3) | ((F.col("strong") >= 2) & F.col("any_listed")))
    in_order = Window.partitionBy("book").orderBy("first")
    found = found.withColumn("floor", F.coalesce(F.lag("end").over(in_order), F.lit(0)))
    found = found.withColumn("start", F.greatest(F.coalesce("opened.at", F.lit(0)), "floor")).withColumn("titled", F.col("opened.titled"))
    near_title = F.col("titled") >= F.greatest("floor", F.col("start") - LOOK_BACK)
    found = found.withColumn("title_at", F.when(near_title, F.col("titled")))
    stop = F.least(F.coalesce(F.lead("start").over(in_order), F.col("size")), F.coalesce(F.lead("title_at").over(in_order), F.col("size")))
    return found.select("book", "start", "end", "title_at", stop.alias("stop"))


def parts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The blocks of each recipe, from its title to its end, with the part that they belong to."""
    marks = found.filter("title_at is not null").select("book", F.col("title_at").alias("at"), F.struct("title_at", "start", "end", "stop").alias("own"))
    # A mark comes right before the block it stands for; so blocks are dealt to their books and no further.
    so_far = Window.partitionBy("book").orderBy("at", F.col("text").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, 1 + rows.count() // TASK_BLOCKS)
    got = rows.unionByName(marks, allowMissingColumns=True).repartition(tasks, "book").withColumn("own", F.last("own", ignorenulls=True).over(so_far))
    got = got.filter(F.col("text").isNotNull() & (F.col("at") < F.col("own.stop")))
    part = (
        F.when(F.col("at") == F.col("own.title_at"), "title")
        .when(F.col("at") < F.col("own.start"), "head")
        .when(F.col("at") < F.col("own.end"), "list")
        .otherwise("method")
    )
    return got.withColumn("part", part).withColumn("recipe", F.col("own.title_at"))


def listed_foods(rows: DataFrame) -> DataFrame:
    """Blocks with ``food``, (section, text), where they are a line of a list."""
    so_far = Window.partitionBy("book", "recipe").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (F.col("part") == "list") & ~F.col("image") & ~F.col("label")
    head = F.when(inside & F.col("subhead") & ~F.col("ingredient"), F.regexp_replace("text", ":+$", ""))
    got = rows.withColumn("head", head).withColumn("under", F.last("head", ignorenulls=True).over(so_far))
    food = F.when(inside & F.col("head").isNull(), F.struct(F.col("under").alias("section"), "text"))
    return got.withColumn("food", food).drop("head", "under")


def method_steps(rows: DataFrame) -> DataFrame:
    """Blocks with ``step``, ``more``, ``note_text`` and ``early_text``: steps, their lettered lines, notes and introductions after each list.

    A method ends at a heading of a chapter or a title once it has begun, and a numbered one at the first line without a number.
    In a method without numbers every line is a step, up to the first note, which takes what follows. What is over stays over, so the
    windows of blocks before it don't see it.
    """
    recipe = Window.partitionBy("book", "recipe", "inside")
    order = recipe.orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    no = F.lit(False)
    got = rows.withColumn("inside", (F.col("part") == "method") & ~F.col("image"))
    # What a table of yield and time or a label says before the first line of the method is none of it.
    detail = F.col("label") | F.col("yields") & (F.length("text") < 80)
    valued = F.coalesce(F.lag("label").over(order), no) & (F.lower(F.regexp_replace(F.lag("text").over(order), ":$", "")).isin([*LABELS, "note", "notes"]))
    got = got.withColumn("detail", detail | valued)
    line = ~F.col("detail") & ~F.col("note") & (~F.col("subhead") | F.col("numbered"))
    got = got.withColumn("begun", F.coalesce(F.max(line).over(before), no)).withColumn("line", line | (F.col("begun") & F.col("detail") & ~F.col("note")))
    chapter = (F.col("kind") == "heading") & (F.col("level") <= 2)
    other_head = F.col("subhead") & ~F.col("numbered") & (F.col("kind") == "heading") & ~F.col("section")
    ends = F.col("begun") & ~F.col("note") & (chapter | F.col("title") | other_head)
    ends = ends | (F.col("begun") & F.col("note") & (chapter | F.col("title")))
    got = got.withColumn("over", F.max(F.coalesce(ends, no)).over(so_far))
    got = got.withColumn("counts", F.col("line") & F.col("numbered") & ~F.col("lettered") & ~F.col("over"))
    got = got.withColumn("any_number", F.max("counts").over(recipe)).withColumn("after_number", F.coalesce(F.max("counts").over(before), no))
    goes_on = F.col("lettered") & F.col("after_number")
    stray = F.col("line") & F.col("after_number") & ~F.col("numbered") & ~goes_on & ~F.col("subhead")
    got = got.withColumn("over", F.col("over") | F.max(stray).over(so_far))
    got = got.withColumn("noted", F.coalesce(F.max("note").over(before), no))
    head = F.when(F.col("subhead") & ~F.col("numbered") & ~F.col("line"), F.regexp_replace("text", ":+$", ""))
    got = got.withColumn("under", F.last(head, ignorenulls=True).over(so_far))
    early = F.col("any_number") & F.col("line") & ~F.col("counts") & ~F.col("after_number")
    to_note = F.col("note") | (F.col("line") & ~F.col("any_number") & F.col("noted"))
    step = F.col("line") & ~early & ~to_note & ~goes_on
    bare = F.trim(F.regexp_replace("text", r"^(?i:step ?)?[0-9]{1,2}(?: ?[.):] ?|\s+(?=[A-Z]))", ""))
    number = F.sum(F.when(step, 1).otherwise(0)).over(so_far)
    holds = lambda is_it, what: F.when(F.col("inside") & ~F.col("over") & is_it, what)
    return got.select(
        *rows.columns,
        holds(step, F.struct(F.col("under").alias("section"), bare.alias("text"))).alias("step"),
        holds(goes_on & F.col("line"), F.struct(number.alias("of"), "text")).alias("more"),
        holds(to_note, F.col("text")).alias("note_text"),
        holds(early, F.col("text")).alias("early_text"),
    )


def find_recipes(blocks: DataFrame, book: str = "path") -> DataFrame:
    """book, start, title, ingredients, steps, notes, introduction, reason of the ingredient lists in (book, place, kind, level, text, classes, cell).

    One row for each list; reason says why a list gives no recipe (no title, no method), and then only start stands. Ingredients and
    steps are (section, text). A step's lettered lines are joined to it. start is the number of the list's first block in the book.

    Blocks without a text are left out, pictures but for their place. A book without a list, and an empty table, give no rows. Blocks of one book
    meet in one task, and those of a null book are one book; blocks with equal places have no order among them. Other columns are ignored.
    """
    rows = materialise(marked(classified(blocks, book)).drop("place"), "book-blocks")
    found = materialise(lists(rows), "book-lists")
    # From the blocks to the recipes all windows and sums are within books, to which the blocks are dealt once.
    of = method_steps(listed_foods(parts(rows.drop("goes_on", "island", "opened", "size", "bare", "listed", "prose", "classes"), found)))
    head = (F.col("part") == "head") & (F.col("kind") == "text") & ~F.col("label") & ~F.col("yields")
    of = of.withColumn("intro", F.when(head, F.col("text")).otherwise(F.col("early_text"))).withColumn("note", F.col("note_text"))
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", c))))[c]
    read = of.groupBy("book", "recipe").agg(
        F.max("own.start").alias("start"),
        F.max(F.when(F.col("part") == "title", F.col("text"))).alias("title"),
        listed("food").alias("ingredients"),
        listed("step").alias("steps"),
        listed("more").alias("more"),
        listed("note").alias("notes"),
        F.array_join(listed("intro"), " ").alias("introduction"),
    )
    extra = lambda k: F.transform(F.filter("more", lambda m: m["of"] == k + 1), lambda m: F.concat(F.lit(" "), m["text"]))
    whole = F.transform("steps", lambda s, k: F.struct(s["section"].alias("section"), F.concat(s["text"], F.array_join(extra(k), "")).alias("text")))
    read = read.withColumn("steps", F.filter(whole, lambda s: s["text"] != ""))
    untitled = found.filter("title_at is null").select("book", "start", F.lit("no title").alias("reason"))
    reason = F.when(F.size("ingredients") == 0, "no ingredients").when(F.size("steps") == 0, "no method")
    got = read.withColumn("reason", reason).unionByName(untitled, allowMissingColumns=True)
    names = ["title", "ingredients", "steps", "notes", "introduction"]
    return got.select(F.col("book").alias(book), "start", "reason", *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in names])
