"""Recipes in plain text: title, ingredients and method read from the order of a text's lines, or a reason why not.

A text stays one row, its lines are arrays, and no line is shuffled or written. What the place of a line means depends on lines
before it, so the states of a reader that goes line by line are places in these arrays: the first heading of a kind bounds a zone,
an array is cut into pieces before each label, the line before an ingredient may be its amount. Each step reads its array once or
slices it into parts, so that a text costs what its length does. A text that gives no recipe by its headings and blocks alone is
not read further.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.bind import let

# The headings, labels and interface words that recipe pages use, in small letters.
INGREDIENT_HEADINGS = [
    "ingredient", "ingredient checklist", "ingredients", "what you’ll need", "what you need", "what you'll need", "you will need",
]
METHOD_HEADINGS = [
    "direction", "directions", "instruction", "instructions", "method", "how to make", "how to make it", "preparation",
    "preparation method", "procedure", "steps",
]
NOTE_HEADINGS = [
    "chef's note", "chef’s note", "chef's notes", "chef’s notes", "cook's note", "cook’s note", "make ahead",
    "make-ahead and storage", "note", "notes", "recipe notes", "recipe tips", "storage", "tips", "tips from our bakers", "variations",
]
EQUIPMENT_HEADINGS = ["equipment", "special equipment", "you’ll also need", "you'll also need"]
STOP_HEADINGS = [
    "categories", "comments", "explore more", "more recipes", "nutrition", "nutrition facts", "nutrition info",
    "nutrition information", "nutritional information", "ratings", "read more", "related recipes", "reviews", "tools you may need",
    "you may also like",
]
INTERFACE = [
    "add to shopping list", "deselect all", "jump to recipe", "print", "print recipe", "rate", "rate this recipe", "save",
    "save recipe", "select all", "share",
]
INTERFACE_STARTS = ["ask ai", "cook mode", "keep screen awake", "recipe video", "watch how to make"]
CREDIT_STARTS = ["fact checked by ", "published on ", "reviewed by ", "tested by ", "updated on "]
TIME_LABELS = [
    "active", "active time", "additional", "additional time", "bake", "bake time", "chill", "chill time", "chilling time",
    "cooling time", "cook", "cook time", "hands-on time", "inactive", "inactive time", "marinating time", "prep", "prep time",
    "proofing time", "ready in", "resting time", "rise time", "total", "total time",
]
YIELD_LABELS = ["makes", "serves", "serving", "servings", "yield"]
#: Labels that stand before a colon or dash, besides those in "... time".
VALUE_LABELS = [
    "yield", "serving", "servings", "serves", "makes", "author", "active", "additional", "bake", "chill", "chilling", "cool",
    "cooling", "cook", "inactive", "marinating", "prep", "proof", "proofing", "rest", "resting", "rise", "total", "ready in",
]
OTHER_LABELS = ["category", "course", "cuisine", "diet", "difficulty", "keyword", "keywords", "level", "rating"]
FRACTIONS = "¼½¾⅓⅔⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞"
BULLETS = "-*•▪◦"

#: Why a text gives no recipe, in the order in which it is asked.
REASONS = [
    "too few lines", "several lists", "no blocks", "no title", "two amounts in a row", "amount without food", "details in the method",
    "no ingredients", "no method", "some steps numbered",
]


def lines_of(texts: DataFrame, key: str) -> DataFrame:
    """(key, lines, names, blocks): the lines of each text that are not blank, white space collapsed; these as headings; its blocks.

    Blocks stand between blank lines: the first, the second and all others as one. An empty text has one empty line.
    """
    raw = texts.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("raw"))
    plain = F.replace(F.regexp_replace("raw", "\r\n?", "\n"), F.lit("\f"), F.lit("\n\n"))
    plain = F.regexp_replace(plain, "[\u00ad\u200b\ufeff]+", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?U)[\s&&[^\n ]][\s&&[^\n]]*| [\s&&[^\n]]+", " "), " \n ?|\n ", "\n")
    # a text of ASCII without other white space than single blanks in lines, as most have, is left as it is
    other = F.octet_length("raw") != F.char_length("raw")
    for space in ("\r", "\f", "\t", "\v", "  ", " \n", "\n "):
        other |= F.contains("raw", F.lit(space))
    clean = raw.select("key", F.when(other, plain).otherwise(F.col("raw")).alias("text"))
    clean = clean.withColumn("text", F.btrim("text", F.lit(" \n")))
    clean = clean.withColumn("lines", F.when(F.contains("text", F.lit("\n\n")), F.regexp_replace("text", "\n\n+", "\n")).otherwise(F.col("text")))
    marks = F.contains("lines", F.lit("#")) | F.contains("lines", F.lit(":"))
    bare = F.regexp_replace(F.regexp_replace("lines", "#(?<![^\n]#)#{0,5} *", ""), ":+(?![^\n])", "")
    name = F.lower(F.when(marks, bare).otherwise(F.col("lines")))
    return clean.select("key", F.split("lines", "\n").alias("lines"), F.split(name, "\n").alias("names"), F.split("text", "\n\n+", 3).alias("blocks"))


def heading(line: Column) -> Column:
    """A line as a heading: without marks before and colons behind, in small letters."""
    return F.lower(F.regexp_replace(F.regexp_replace(line, "^#{1,6}\\s*", ""), ":+$", ""))


def any_of(words: list[str]) -> str:
    """One of the words, the longest that fits; told by the first letter, so that most lines are tried against few."""
    first = sorted({w[0] for w in words})
    ends = {k: "|".join(re.escape(w[1:]) for w in sorted(words, key=len, reverse=True) if w[0] == k) for k in first}
    return f"(?:(?=[{''.join(first)}])(?:{'|'.join(f'{k}(?:{e})' for k, e in ends.items())}))"


def under(name: Column, headings: list[str]) -> Column:
    """Whether a heading is one of ``headings``, alone or before a colon or a bracket."""
    return F.rlike(name, F.lit(rf"^{any_of(headings)}(?:$|:| \()"))


def n_words(line: Column) -> Column:
    return F.size(F.split(F.trim(line), " "))


def first_word(line: Column) -> Column:
    return F.lower(F.substring_index(line, " ", 1))


def rest(line: Column) -> Column:
    """What follows the first word; empty if nothing does."""
    return F.when(F.instr(line, " ") > 0, F.substring(line, F.instr(line, " ") + 1, F.length(line))).otherwise("")


def unbulleted(line: Column, marks: str = BULLETS + "☐☑") -> Column:
    """A line without the bullet or tick box that it begins with."""
    box = line.contains("]") & F.substring_index(F.lower(line), "]", 1).isin("[", "[ ", "[x", "[ x") & F.lit("☐" in marks)
    after_box = F.substring(line, F.instr(line, "]") + 1, F.length(line))
    bullet = F.substring(line, 1, 1).isin(list(marks))
    return F.trim(F.when(bullet, F.substring(line, 2, F.length(line))).when(box, after_box).otherwise(line))


def amount_alone(line: Column) -> Column:
    ends = F.substring(line, -1, 1).isin(list("0123456789" + FRACTIONS))
    return ends & F.rlike(line, F.lit(rf"^(?:[0-9]+(?:\.[0-9]+|/[0-9]+| [0-9]+/[0-9]+)?|[{FRACTIONS}])$"))


def is_label(label: Column) -> Column:
    return label.isin(VALUE_LABELS) | F.rlike(label, F.lit("^[a-z][a-z -]* time$"))


def label_and_value(line: Column) -> Column:
    """(label, value) of a line with a known label before a colon or dash, or with a yield's label as its first word; else null."""
    found = []
    for mark, k in ((":", 1), ("-", 1), ("-", 2), ("-", 3)):
        before = F.substring_index(line, mark, k)
        label, value = F.trim(F.lower(before)), F.trim(F.substring(line, F.length(before) + 2, F.length(line)))
        found.append(F.when(line.contains(mark) & (value != "") & is_label(label), F.struct(label.alias("label"), value.alias("value"))))
    return F.coalesce(*found)


def yield_at_front(line: Column) -> Column:
    return F.when(first_word(line).isin(YIELD_LABELS) & (rest(line) != ""), F.struct(first_word(line).alias("label"), rest(line).alias("value")))


def byline(line: Column) -> Column:
    """Who a line that begins with "by" names, up to a date; else null."""
    name = F.trim(F.regexp_replace(rest(line), r"(?i) (?:updated|published)\b.*$", ""))
    return F.when((first_word(line) == "by") & (rest(line) != ""), name)


def numbered_step(line: Column) -> Column:
    """The number that a step begins with, with what stands around it; empty if it begins otherwise."""
    return F.regexp_extract(line, r"^(?i:step )?[0-9]{1,3}[.)] ?", 0)


def head_of(name: Column) -> Column:
    """Which heading beside those of the zones a line is: of what is no recipe (stop), of equipment or of notes; else null."""
    return F.when(under(name, STOP_HEADINGS), "stop").when(under(name, EQUIPMENT_HEADINGS), "equipment").when(under(name, NOTE_HEADINGS), "notes")


def interface(name: Column) -> Column:
    return name.isin(INTERFACE + ["level easy", "level intermediate", "level advanced"])


def noise(line: Column, name: Column) -> Column:
    """Whether a line is the page's own: interface, other headings, credits, details; or around its text its address, its number, its date."""
    page = "page [0-9]+(?: of [0-9]+)?"
    address = f"https?://[^ ]+(?: {page})?$"
    dated = r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4} .+\|."
    of_page = F.rlike(F.lower(line), F.lit(rf"^(?:{any_of(OTHER_LABELS)} ?[:-]|{address}|{page}$|[0-9]+ ?/ ?[0-9]+$|{dated})"))
    starts = F.rlike(name, F.lit(f"^{any_of(CREDIT_STARTS + INTERFACE_STARTS)}"))
    return interface(name) | under(name, STOP_HEADINGS) | starts | of_page


def row_of(line: Column, name: Column) -> Column:
    """(line, name, head, noise) of a line. Few begin as a heading or as noise does; only these are tried against each kind."""
    words = STOP_HEADINGS + EQUIPMENT_HEADINGS + NOTE_HEADINGS + CREDIT_STARTS + INTERFACE_STARTS + OTHER_LABELS + ["http", "page "]
    row = lambda head, other: F.struct(line.alias("line"), name.alias("name"), head.alias("head"), other.alias("noise"))
    begins = F.rlike(name, F.lit(rf"^(?:{any_of(words)}|[0-9]+ ?[/-])"))
    return F.when(begins, row(head_of(name), noise(line, name))).otherwise(row(F.lit(None).cast("string"), interface(name)))


def first_place(rows: Column, flag: Callable[[Column], Column]) -> Column:
    """The place, from 1, of the first row with a flag; behind the last one if none has it."""
    return let(rows, lambda r: let(F.array_position(F.transform(r, flag), True), lambda at: F.when(at > 0, at.cast("int")).otherwise(F.size(r) + 1)))


def until(rows: Column, flag: Callable[[Column], Column]) -> Column:
    """The rows before the first one with a flag."""
    return let(rows, lambda r: F.slice(r, 1, first_place(r, flag) - 1))


def pieces(rows: Column, flag: Callable[[Column], Column]) -> Column:
    """The rows cut before each one with a flag; the first piece begins with the first row, whatever its flag is."""
    starts = lambda r: F.array_compact(F.transform(r, lambda x, i: F.when((i == 0) | flag(x), i + 1)))
    cut = lambda r, at: F.transform(at, lambda p, k: F.slice(r, p, F.coalesce(F.get(at, k + 1), F.size(r) + 1) - p))
    return let(rows, lambda r: let(starts(r), lambda at: cut(r, at)))


def last_of(values: Column) -> Column:
    """The last value that is not null; null if there is none."""
    return F.try_element_at(F.array_compact(values), F.lit(-1))


def zones(texts: DataFrame) -> DataFrame:
    """(key, early, title, foods, method): rows of each zone, (line, name, head, noise), or the reason why a text has no zones."""
    kind = F.transform("names", lambda x: F.when(x.isin(INGREDIENT_HEADINGS), 1).when(x.isin(METHOD_HEADINGS), 2).otherwise(0))
    got = texts.withColumn("kinds", kind).withColumn("n", F.size("lines"))
    got = got.withColumn("list_at", F.array_position("kinds", 1).cast("int"))
    after = F.slice("kinds", F.col("list_at") + 1, F.col("n"))
    got = got.withColumn("to_method", F.when(F.col("list_at") > 0, F.array_position(after, 2).cast("int")).otherwise(0))
    headed = F.col("to_method") > 0
    count = lambda kind: F.size(F.filter("kinds", lambda x: x == kind))
    early = (
        F.when(F.col("n") < 3, "too few lines")
        .when((count(1) > 1) & (count(2) > 1), "several lists")
        .when(~headed & (F.size("blocks") < 3), "no blocks")
    )
    of_block = lambda k: F.size(F.split(F.get("blocks", F.lit(k)), "\n"))
    bounds = F.struct(
        F.when(headed, F.col("list_at") - 1).otherwise(of_block(0)).alias("title"),
        F.when(headed, F.col("to_method") - 1).otherwise(of_block(1)).alias("foods"),
        F.when(headed, 1).otherwise(0).alias("heads"),
    )
    got = got.withColumn("early", early).withColumn("bounds", F.when(F.col("early").isNull(), bounds))
    line = F.transform(F.arrays_zip("lines", "names"), lambda x: row_of(x["lines"], x["names"]))
    got = got.select("key", "early", "bounds", F.when(F.col("early").isNull(), line).alias("rows"), "n")
    foods_at = F.col("bounds.title") + F.col("bounds.heads") + 1
    method_at = foods_at + F.col("bounds.foods") + F.col("bounds.heads")
    return got.select(
        "key",
        "early",
        F.slice("rows", 1, F.col("bounds.title")).alias("title"),
        F.slice("rows", foods_at, F.col("bounds.foods")).alias("foods"),
        F.slice("rows", method_at, F.col("n")).alias("method"),
    )


def title_rows(rows: Column) -> Column:
    """What each line before the ingredients says: a title, a yield, a time and an author, each of them or null.

    A bare label takes the line after it as its value, and a value is no label in turn: in a run of lines that each could take the
    next, every second one is a value.
    """
    bare_labels = TIME_LABELS + YIELD_LABELS + ["author", "difficulty", "level"]

    def labelled(x: Column, after: Column) -> Column:
        follows = F.coalesce((n_words(after["line"]) <= 8) & ~after["noise"], F.lit(False))
        own = F.coalesce(label_and_value(x["line"]), yield_at_front(x["line"]))
        takes = lambda o: o.isNull() & x["name"].isin(bare_labels) & follows
        return let(own, lambda o: F.struct(x["line"], x["name"], o.alias("own"), takes(o).alias("takes"), after["line"].alias("after")))

    def said(x: Column) -> Column:
        line, name = x["line"], x["name"]
        value = F.coalesce(x["own"]["value"], F.when(x["takes"], x["after"]))
        label = F.coalesce(heading(x["own"]["label"]), F.when(x["takes"], name))
        return let(F.struct(label.alias("label"), value.alias("value")), lambda v: meant(line, name, v["label"], v["value"]))

    def meant(line: Column, name: Column, label: Column, value: Column) -> Column:
        capital = F.replace(F.initcap(label), F.lit("Hands-on"), F.lit("Hands-On"))
        servings = F.when(F.lower(value).contains("serving"), value).otherwise(F.concat(value, F.lit(" servings")))
        yields = (
            F.when(label == "yield", value)
            .when(label.isin("serving", "servings"), servings)
            .when(label.isin("serves", "makes"), F.concat(capital, F.lit(" "), value))
        )
        plain = label.isNull() & ~name.isin("difficulty", "level")
        author = F.when(label == "author", value).when(plain, byline(line))
        bare = F.regexp_replace(F.trim(F.regexp_replace(line, r"(?i)^title\s*:\s*", "")), r"^#{1,6}\s*", "")
        title = F.when(plain & byline(line).isNull(), let(bare, lambda b: F.when(good_title(b), b)))
        time = F.when(label.isin(TIME_LABELS), F.concat(capital, F.lit(": "), value))
        return F.struct(title.alias("title"), yields.alias("yield"), author.alias("author"), time.alias("time"))

    def good_title(bare: Column) -> Column:
        sentence = (n_words(bare) > 5) & F.rlike(bare, F.lit(r"[.!?]$"))
        link = F.rlike(bare, F.lit("(?i)^https?://"))
        named = lambda n: ~noise(bare, n) & ~n.isin("recipe", "recipe card")
        return (bare != "") & let(heading(bare), named) & ~sentence & ~link & (n_words(bare) <= 8)

    got = let(rows, lambda r: F.transform(r, lambda x, i: labelled(x, F.get(r, i + 1))))
    # a piece begins after each line that takes nothing: its second, fourth, ... rows are values
    follows = let(got, lambda r: F.transform(r, lambda x, i: F.struct(x.alias("x"), (~F.get(r, i - 1)["takes"]).alias("begins"))))
    lines = F.flatten(F.transform(pieces(follows, lambda x: x["begins"]), lambda p: F.filter(p, lambda x, i: i % 2 == 0)))
    return F.transform(lines, lambda x: said(x["x"]))


def ingredient_rows(rows: Column) -> Column:
    """Ingredients and equipment between the headings, and what is wrong; an amount on a line of its own belongs to the next ingredient."""

    def values(lines: Column) -> Column:
        wanted = lambda x: ~x["noise"] & ~x["name"].isin(INGREDIENT_HEADINGS) & ~x["head"].eqNullSafe("equipment")
        named = lambda x, v: F.when(v == x["line"], x["name"]).otherwise(heading(v))
        value = lambda x: let(unbulleted(x["line"]), lambda v: F.when((v != "") & ~named(x, v).isin(NOTE_HEADINGS), v))
        return F.array_compact(F.transform(F.filter(lines, wanted), value))

    def read(foods: Column, tools: Column) -> Column:
        before = lambda i: F.get(foods, i - 1)
        amount = lambda i: F.when(before(i)["alone"], F.concat(before(i)["value"], F.lit(" "))).otherwise("")
        food = F.transform(foods, lambda x, i: F.when(~x["alone"], F.concat(amount(i), x["value"])))
        two = F.size(F.filter(foods, lambda x, i: x["alone"] & before(i)["alone"])) > 0
        left = F.coalesce(F.try_element_at(foods, F.lit(-1))["alone"], F.lit(False))
        return F.struct(F.array_compact(food).alias("ingredients"), tools.alias("equipment"), two.alias("two"), left.alias("left"))

    def split(upto: Column, at: Column) -> Column:
        foods = F.filter(values(F.slice(upto, 1, at - 1)), lambda v: ~(v.endswith(":") & (n_words(v) <= 5)))
        foods = F.transform(foods, lambda v: F.struct(v.alias("value"), amount_alone(v).alias("alone")))
        return let(foods, lambda f: read(f, values(F.slice(upto, at, F.size(upto)))))

    tools_at = lambda x: x["head"].eqNullSafe("equipment") & ~x["noise"]
    return let(until(rows, lambda x: x["head"].eqNullSafe("stop")), lambda upto: let(first_place(upto, tools_at), lambda at: split(upto, at)))


def method_rows(rows: Column) -> Column:
    """Steps with their section, equipment and notes after the method's heading, and what is wrong."""

    def changes(x: Column) -> Column:
        return F.coalesce(x["head"].isin("equipment", "notes"), F.lit(False))

    def wanted(x: Column) -> Column:
        step_only = x["name"].startswith("step ") & F.rlike(F.lower(x["line"]), F.lit("^step [0-9]{1,3} ?:?$"))
        return ~changes(x) & ~x["noise"] & ~x["name"].isin(METHOD_HEADINGS) & ~step_only

    def details(line: Column) -> Column:
        return byline(line).isNotNull() | label_and_value(line).isNotNull()

    def step(line: Column, number: Column) -> Column:
        """A line before the first change: a section's label, or a step and whether it has a number."""
        label = F.when(line.endswith(":") & (n_words(line) <= 6), F.trim(F.regexp_replace(line, ":+$", "")))
        text = F.when(number != "", F.trim(F.substring(line, F.length(number) + 1, F.length(line)))).otherwise(unbulleted(line, BULLETS))
        return F.struct(label.alias("label"), text.alias("text"), number.endswith(" ").alias("numbered"), details(line).alias("details"))

    def is_step(x: Column) -> Column:
        return x["label"].isNull() & (x["text"] != "") & ~x["details"]

    def sections(lines: Column) -> Column:
        cut = pieces(lines, lambda x: x["label"].isNotNull())
        of = lambda p: F.transform(F.filter(p, is_step), lambda x: F.struct(F.get(p, F.lit(0))["label"].alias("section"), x["text"].alias("text")))
        return F.flatten(F.transform(cut, of))

    def noted(p: Column) -> Column:
        lines = F.transform(F.filter(p, wanted), lambda x: F.struct(unbulleted(x["line"]).alias("text"), details(x["line"]).alias("details")))
        return F.struct(F.get(p, F.lit(0))["head"].alias("mode"), lines.alias("lines"))

    def read(body: Column, later: Column) -> Column:
        texts = lambda ls: F.transform(F.filter(ls, lambda x: (x["text"] != "") & ~x["details"]), lambda x: x["text"])
        under_mode = lambda mode: F.flatten(F.transform(F.filter(later, lambda p: p["mode"] == mode), lambda p: texts(p["lines"])))
        wrong = F.exists(body, lambda x: x["details"]) | F.exists(later, lambda p: F.exists(p["lines"], lambda x: x["details"]))
        some = F.exists(body, lambda x: is_step(x) & x["numbered"]) & F.exists(body, lambda x: is_step(x) & ~x["numbered"])
        return F.struct(
            sections(body).alias("steps"),
            under_mode("equipment").alias("equipment"),
            under_mode("notes").alias("notes"),
            wrong.alias("details"),
            some.alias("some_numbered"),
        )

    def split(upto: Column, at: Column) -> Column:
        body = F.filter(F.slice(upto, 1, at - 1), wanted)
        body = F.transform(body, lambda x: let(numbered_step(x["line"]), lambda number: step(x["line"], number)))
        later = F.transform(pieces(F.slice(upto, at, F.size(upto)), changes), noted)
        return let(F.struct(body.alias("body"), later.alias("later")), lambda b: read(b["body"], b["later"]))

    upto = until(rows, lambda x: x["head"].eqNullSafe("stop"))
    return let(upto, lambda u: let(first_place(u, changes), lambda at: split(u, at)))


def parse(texts: DataFrame, key: str) -> DataFrame:
    """key, reason, title, yields, author, notes, ingredients, steps of (key, text) rows; one row per input row.

    A text with a heading for the ingredients and, after it, one for the method is read by these; another one by its blocks: title,
    ingredients, method. reason says why a text is no recipe (``REASONS``, the first that holds), and then nothing else is given.
    Steps are (section, text). Notes hold times, then equipment, then what stands under notes.

    A null text counts as empty. Repeated rows are read each on its own, null keys as well. Other columns are ignored; an empty table
    gives no rows. Nothing is cut: long lines and long lists stay whole. Rows stay in the partitions that they are in.
    """
    got = zones(lines_of(texts, key))
    got = got.select("key", "early", title_rows(F.col("title")).alias("t"), ingredient_rows(F.col("foods")).alias("f"), method_rows(F.col("method")).alias("m"))
    got = got.withColumn("title", last_of(F.col("t.title")))
    reason = F.coalesce(
        "early",
        F.when(F.col("title").isNull(), "no title"),
        F.when(F.col("f.two"), "two amounts in a row"),
        F.when(F.col("f.left"), "amount without food"),
        F.when(F.col("m.details"), "details in the method"),
        F.when(F.size("f.ingredients") == 0, "no ingredients"),
        F.when(F.size("m.steps") == 0, "no method"),
        F.when(F.col("m.some_numbered"), "some steps numbered"),
    )
    equipment = F.concat("f.equipment", "m.equipment")
    tools = F.when(F.size(equipment) > 0, F.array(F.concat(F.lit("Equipment: "), F.array_join(equipment, " ")))).otherwise(F.array())
    notes = F.concat(F.array_compact("t.time"), tools, F.transform("m.notes", lambda x: F.concat(F.lit("Note: "), x)))
    yields = let(F.array_distinct(F.array_compact("t.yield")), lambda y: F.when(F.size(y) > 0, F.array_join(y, " · ")))
    got = got.withColumn("reason", reason)
    good = lambda c: F.when(F.col("reason").isNull(), c)
    return got.select(
        F.col("key").alias(key),
        "reason",
        good(F.col("title")).alias("title"),
        good(yields).alias("yields"),
        good(last_of(F.col("t.author"))).alias("author"),
        good(notes).alias("notes"),
        good(F.col("f.ingredients")).alias("ingredients"),
        good(F.col("m.steps")).alias("steps"),
    )
