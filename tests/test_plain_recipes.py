"""The plain-text recipe reader against a reader that goes line by line."""

import random
import re

from galley.operators import plain_recipes as pr

SPACE = re.compile(r"\s+")


def head(line):
    return SPACE.sub(" ", re.sub(r"^#{1,6}\s*", "", line).rstrip(":")).lower()


def under(line, names):
    return any(head(line) == n or head(line).startswith((f"{n}:", f"{n} (")) for n in names)


def noise(line):
    words = line.split(" ")
    tail = re.sub("[0-9]+", "0", " ".join(words[1:]).lower())
    flat = re.sub("[0-9]+", "0", line.lower())
    return (
        head(line) in pr.INTERFACE
        or under(line, pr.STOP_HEADINGS)
        or head(line).startswith(tuple(pr.CREDIT_STARTS + pr.INTERFACE_STARTS))
        or head(line) in ("level easy", "level intermediate", "level advanced")
        or any(re.match(rf"{n} ?[:-]", line.lower()) for n in pr.OTHER_LABELS)
        or flat in ("0/0", "0 / 0", "0/ 0", "0 /0", "page 0", "page 0 of 0")
        or (words[0].lower().startswith(("http://", "https://")) and len(words[0]) > 8 and tail in ("", "page 0", "page 0 of 0"))
        or (re.fullmatch(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", words[0]) is not None and re.search(r".\|.", " ".join(words[1:])) is not None)
    )


def labelled(line):
    for mark in (":", "-"):
        for at in [m.start() for m in re.finditer(mark, line)][: 1 if mark == ":" else 3]:
            label, value = line[:at].strip().lower(), line[at + 1 :].strip()
            if value and (label in pr.VALUE_LABELS or re.fullmatch("[a-z][a-z -]* time", label)):
                return label, value
    return None


def author_of(line):
    words = line.split(" ")
    return re.split(r"(?i) (?:updated|published)\b", " ".join(words[1:]))[0].strip() if words[0].lower() == "by" and len(words) > 1 else None


def bare(line, marks="-*•▪◦☐☑"):
    if line[0] in marks:
        return line[1:].strip()
    return re.sub(r"^\[ ?[xX]?\]", "", line).strip() if "☐" in marks else line


def amount(line):
    return re.fullmatch(rf"\d+|\d+\.\d+|(\d+ )?\d+/\d+|[{pr.FRACTIONS}]", line) is not None


def read(text):
    """(reason, title, yields, author, notes, ingredients, steps)"""
    fail = lambda why: (why, None, None, None, None, None, None)
    text = re.sub("\r\n?", "\n", text or "").replace("\f", "\n\n").replace(" ", " ")
    text = re.sub("[­​﻿]", "", text).strip()
    blocks = [[SPACE.sub(" ", x).strip() for x in b.split("\n") if x.strip()] for b in re.split(r"\n\s*\n", text) if b.strip()]
    lines = [x for b in blocks for x in b]
    if len(lines) < 3:
        return fail("too few lines")
    lists = [k for k, x in enumerate(lines) if head(x) in pr.INGREDIENT_HEADINGS]
    methods = [k for k, x in enumerate(lines) if head(x) in pr.METHOD_HEADINGS]
    if len(lists) > 1 and len(methods) > 1:
        return fail("several lists")
    after = [k for k in methods if lists and k > lists[0]]
    if after:
        zones = lines[: lists[0]], lines[lists[0] + 1 : after[0]], lines[after[0] + 1 :]
    elif len(blocks) < 3:
        return fail("no blocks")
    else:
        zones = blocks[0], blocks[1], [x for b in blocks[2:] for x in b]

    title, yields, times, author, rest = None, [], [], None, list(zones[0])
    while rest:
        line = rest.pop(0)
        got = labelled(line)
        if not got and line.split(" ")[0].lower() in pr.YIELD_LABELS and " " in line:
            got = line.split(" ")[0].lower(), line.split(" ", 1)[1]
        if not got and head(line) in [*pr.TIME_LABELS, *pr.YIELD_LABELS, "author", "difficulty", "level"] and rest:
            if len(rest[0].split()) <= 8 and not noise(rest[0]):
                got = head(line), rest.pop(0)
        if got:
            label, value = got
            if label == "yield":
                yields.append(value)
            elif label in ("serving", "servings"):
                yields.append(value if "serving" in value.lower() else f"{value} servings")
            elif label in ("serves", "makes"):
                yields.append(f"{label.title()} {value}")
            elif label == "author":
                author = value
            elif label in pr.TIME_LABELS:
                times.append(f"{label.title()}: {value}")
        elif head(line) in ("difficulty", "level"):
            pass
        elif author_of(line) is not None:
            author = author_of(line)
        else:
            plain = re.sub(r"^#{1,6}\s*", "", re.sub(r"(?i)^title\s*:\s*", "", line).strip())
            n = len(plain.split())
            if plain and not noise(plain) and head(plain) not in ("recipe", "recipe card") and not re.match("(?i)https?://", plain):
                if n <= 8 and not (n > 5 and plain[-1] in ".!?"):
                    title = plain
    if title is None:
        return fail("no title")

    foods, tools, pending, using, why = [], [], None, False, set()
    for line in zones[1]:
        if under(line, pr.STOP_HEADINGS):
            break
        if noise(line) or head(line) in pr.INGREDIENT_HEADINGS:
            continue
        if under(line, pr.EQUIPMENT_HEADINGS):
            using = True
            continue
        value = bare(line)
        if not value or head(value) in pr.NOTE_HEADINGS:
            continue
        if using:
            tools.append(value)
        elif value.endswith(":") and len(value.split()) <= 5:
            continue
        elif amount(value):
            why |= {"two amounts in a row"} if pending else set()
            pending = value
        else:
            foods.append(f"{pending} {value}" if pending else value)
            pending = None
    why |= {"amount without food"} if pending else set()

    steps, noted, section, mode, kinds = [], [], None, None, set()
    for line in zones[2]:
        if under(line, pr.STOP_HEADINGS):
            break
        if under(line, pr.EQUIPMENT_HEADINGS) or under(line, pr.NOTE_HEADINGS):
            mode = tools if under(line, pr.EQUIPMENT_HEADINGS) else noted
        elif noise(line) or head(line) in pr.METHOD_HEADINGS or re.fullmatch(r"(?i)step \d{1,3} ?:?", line):
            continue
        elif author_of(line) is not None or labelled(line):
            why.add("details in the method")
        elif mode is not None:
            mode += [bare(line)] if bare(line) else []
        elif line.endswith(":") and len(line.split()) <= 6:
            section = line.rstrip(":").strip()
        else:
            number = re.match(r"(?i)(step )?\d{1,3}[.)] ?", line)
            value = line[number.end() :].strip() if number else bare(line, "-*•▪◦")
            if value:
                kinds.add(bool(number) and number.group().endswith(" "))
                steps.append((section, value))
    why |= ({"no ingredients"} if not foods else set()) | ({"no method"} if not steps else set())
    why |= {"some steps numbered"} if len(kinds) > 1 else set()
    if why:
        return fail(min(why, key=pr.REASONS.index))
    notes = times + ([f"Equipment: {' '.join(tools)}"] if tools else []) + [f"Note: {x}" for x in noted]
    return None, title, " · ".join(dict.fromkeys(yields)) or None, author, notes, foods, steps


def parsed(spark, texts):
    rows = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "id int, text string, line string, n int").repartition(3)
    got = {}
    for r in pr.parse(rows, "id").collect():
        steps = None if r["steps"] is None else [tuple(s) for s in r["steps"]]
        got[r["id"]] = (r["reason"], r["title"], r["yields"], r["author"], r["notes"], r["ingredients"], steps)
    return got


PIE = """Plum tart
By Ada Novak updated on May 3
Serves 6
Prep
20 min
Bake time: 40 min

Ingredients
[x] 2 cups flour
½
cup sugar
Filling:
- 1 lb plums
Equipment:
tart tin

Directions
Dough:
1. Mix the flour.
2) Roll it.
Step 3
3. Bake.
Notes
* Keeps two days.
Nutrition
200 kcal"""
LINES = [
    "Ingredients", "Ingredients:", "You will need", "Directions", "## Method", "Steps:", "Notes", "Tips (all)", "Equipment: none", "Reviews",
    "Print", "Page 2 of 3", "3 / 4", "1/2/24 Tart | Kitchen", "https://a.example/x page 1", "Level: easy", "level easy", "Yield", "Prep", "Cook time",
    "Serves 4", "Makes - 12", "Servings: 2 servings", "servings: 3", "hands-on time - 5 min", "Soaking time: 1 h", "Author: Bo", "by Bo Ek published",
    "By", "Plum tart", "# Plum tart", "Title: Tart of the long summer days", "Recipe", "It is a tart for many people who come.", "1", "2.5", "1 1/2", "¾",
    "- 1 cup milk", "[ ] 2 eggs", "•", "Crust:", "salt", "1. Mix.", "2) Bake 10 min", "3.Stir", "Step 4. Serve", "step 5:", "Rest", "* Fold", "For the top of it:",
    "difficulty", "by", "Cook Mode", "tested by me", "Total", "10 min", "a b c d e f g h i", "Storage: cool", "2023-24-1", "",  "", "", "  ",
]


def test_a_whole_recipe(spark):
    got = parsed(spark, [PIE])[0]
    assert got == (
        None,
        "Plum tart",
        "Serves 6",
        "Ada Novak",
        ["Prep: 20 min", "Bake Time: 40 min", "Equipment: tart tin", "Note: Keeps two days."],
        ["2 cups flour", "½ cup sugar", "1 lb plums"],
        [("Dough", "Mix the flour."), ("Dough", "Roll it."), ("Dough", "Bake.")],
    )
    assert got == read(PIE)


def test_against_a_reader_line_by_line(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\n ", PIE, PIE, PIE.replace("\n", "\r\n"), "a\fb\fc", "x y\n\n1 egg​\n\n Mix.", PIE + "\n4. " + "long " * 50_000]
    for _ in range(2500):
        part = lambda n: rng.choices(LINES, k=rng.randint(1, n))
        shape = rng.randrange(4)
        if shape == 0:
            lines = part(12)
        elif shape == 1:
            lines = [*part(4), "", *part(4), "", *part(4)]
        else:
            lines = ["Tart", *part(3), "Ingredients", "1 egg", *part(2 + shape), "Method", *rng.choice([[], ["1. Mix."], ["Mix."]]), *part(1 + shape)]
        texts.append("\n".join(lines))
    got = parsed(spark, texts)
    assert len(got) == len(texts)
    wrong = [(texts[k], got[k], read(texts[k])) for k in range(len(texts)) if got[k] != read(texts[k])]
    assert not wrong, wrong[:2]
    reasons = {read(t)[0] for t in texts}
    assert reasons == {None, *pr.REASONS}


def test_no_rows(spark):
    assert pr.parse(spark.createDataFrame([], "id long, text string"), "id").count() == 0


def test_lines_stay_in_the_row_of_their_text(spark):
    rows = spark.createDataFrame([(k, PIE) for k in range(40)], "id int, text string").repartition(3).cache()
    got = pr.parse(rows, "id")
    plan = got._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "Exchange" not in plan and "Window" not in plan and "Generate" not in plan
    assert got.filter("title = 'Plum tart'").count() == 40


def test_texts_of_many_lines(spark):
    """Each line begins a piece, or has an amount or a value before it: what a line costs doesn't grow with the lines before."""
    n = 2_500
    title = ["Prep", "10 min"] * n
    foods = ["1/2", "cup of milk"] * n
    steps = ["Dough:", "1. Mix."] * n
    notes = ["Notes", "Keep it.", "Equipment", "- pan"] * n
    texts = ["\n".join(["Tart", *title, "Ingredients", *foods, "Method", *steps, *notes])]
    texts += ["\n".join(["Tart", "Ingredients:", "1 egg", "## Method:", *["Fold\tit  over:"] * n, "Bake."]), "a\n\n1 egg\n\n" + "\n\n".join(["Mix."] * n)]
    got = parsed(spark, texts)
    assert [got[k] == read(x) for k, x in enumerate(texts)] == [True] * 3
    assert [len(got[k][6]) for k in range(3)] == [n, 1, n]
