"""Recipes in books against a reader that walks through the blocks."""

import random
import re

from galley.operators import book_recipes as br

FIELDS = ["kind", "level", "text", "classes", "cell"]


def facts(spark, books):
    """What each block is by itself, as the operator classes it, in the order of the book."""
    rows = [(b, k, *x) for b, blocks in enumerate(books) for k, x in enumerate(blocks)]
    frame = spark.createDataFrame(rows, "path int, place int, kind string, level int, text string, classes string, cell boolean").repartition(3)
    got = {}
    for r in br.classified(frame, "path").collect():
        got.setdefault(r["book"], []).append(r)
    return frame, {b: sorted(x, key=lambda r: r["at"]) for b, x in got.items()}


def walked(blocks):
    """(start, title, foods, steps, reason) of each list, block by block."""
    runs, i, n = [], 0, len(blocks)
    at = lambda k: blocks[k] if k < n else None
    food = lambda b: b is not None and b["ingredient"]
    while i < n:
        if not food(blocks[i]):
            i += 1
            continue
        start, end, strong = i, i, 0
        while start > 0 and (blocks[start - 1]["bare"] or (blocks[start - 1]["subhead"] and blocks[start - 1]["section"])):
            start -= 1
        while end < n:
            b, prev, near = blocks[end], blocks[end - 1], [at(end + 1), at(end + 2)]
            plain = b["kind"] == "text" and len(b["text"]) <= 320 and not (b["label"] or b["title"] or b["yields"])
            member = plain and food(prev) and ((b["classes"] and b["classes"] == prev["classes"]) or (food(near[0]) and not b["prose"]))
            if food(b):
                strong += 1
            elif not (b["image"] or b["bare"] or (b["subhead"] and any(x and (x["ingredient"] or x["bare"]) for x in near)) or member):
                break
            end += 1
        if strong >= 3 or (strong >= 2 and any(b["listed"] for b in blocks[i:end])):
            runs.append((start, end))
        i = end
    floor, spans = 0, []
    for start, end in runs:
        start = max(start, floor)
        titles = [k for k in range(max(floor, start - br.LOOK_BACK), start) if blocks[k]["title"]]
        spans.append((start, end, titles[-1] if titles else None))
        floor = end
    out = []
    for k, (start, end, title) in enumerate(spans):
        after = spans[k + 1] if k + 1 < len(spans) else (n, None, None)
        stop = min(after[0], n if after[2] is None else after[2])
        if title is None:
            out.append((start, None, None, None, "no title"))
            continue
        section, foods = None, []
        for b in blocks[start:end]:
            if b["image"] or b["label"]:
                continue
            if b["subhead"] and not b["ingredient"]:
                section = re.sub(":+$", "", b["text"])
            else:
                foods.append((section, b["text"]))
        steps = plain_method([b for b in blocks[end:stop] if not b["image"]])
        out.append((start, blocks[title]["text"], foods, steps, None) if foods and steps else (start, None, None, None, "no method" if foods else "no ingredients"))
    return out


def plain_method(blocks):
    """Steps of a method without yields, labels and notes around it."""
    section, numbered, pending, steps = None, False, [], []
    for b in blocks:
        begun = bool(pending or steps)
        if begun and ((b["kind"] == "heading" and b["level"] <= 2) or b["title"]):
            break
        if b["lettered"] and steps:
            steps[-1] = (steps[-1][0], f"{steps[-1][1]} {b['text']}")
        elif b["subhead"] and not b["numbered"]:
            if begun and b["kind"] == "heading" and not b["section"]:
                break
            section = re.sub(":+$", "", b["text"])
        elif numbered and not b["numbered"]:
            break
        elif b["numbered"] and not b["lettered"]:
            numbered, pending = True, []
            steps.append((section, re.sub(r"^(?i:step ?)?[0-9]{1,2}(?: ?[.):] ?|\s+(?=[A-Z]))", "", b["text"]).strip()))
        else:
            pending.append((section, b["text"]))
    return [s for s in steps or pending if s[1]]


POOL = [
    ("heading", 2, "Plum Tart", "", False), ("heading", 1, "Chapter Two", "", False), ("heading", 4, "For the dough", "", False), ("heading", 3, "Filling", "", False),
    ("text", 0, "SIMPLE SAUCE", "", False), ("text", 0, "A tart for summer. It keeps.", "intro", False), ("text", 0, "2 cups flour", "", False),
    ("text", 0, "1 1/2 teaspoons salt", "ingr", False), ("text", 0, "½ cup milk", "", False), ("text", 0, "(2 ounces) butter", "", False), ("text", 0, "a handful of nuts", "", False),
    ("text", 0, "Kosher salt", "", False), ("text", 0, "Large pinch of flakes", "ingr", False), ("text", 0, "juice of 1 lemon", "", False), ("text", 0, "200g sugar", "", False),
    ("text", 0, "To serve:", "", False), ("text", 0, "1 cup | 240 ml", "", True), ("image", 0, None, "", False), ("text", 0, "1. Mix it. Bake it.", "", False),
    ("text", 0, "Step 2: Stir.", "", False), ("text", 0, "3 Cook the tart", "", False), ("text", 0, "Bake until brown.", "", False), ("text", 0, "Let rest.", "step", False),
    ("text", 0, "a. Dried plums", "", False), ("text", 0, "4.3 Crispy things", "", False), ("text", 0, "12 Angry cooks", "", False), ("text", 0, "Fresh herbs", "", False),
]


def test_against_a_walk(spark):
    rng = random.Random(4)
    foods, steps = POOL[6:15], POOL[18:22]
    books = [[]]
    for _ in range(400):
        blocks = []
        for _ in range(rng.randint(1, 4)):
            blocks += rng.choices(POOL, k=rng.randint(0, 3)) + [rng.choice(POOL[:5])] * rng.randint(0, 1) + rng.choices(POOL, k=rng.randint(0, 2))
            blocks += rng.choices(foods, k=rng.randint(1, 5)) + rng.choices(POOL, k=rng.randint(0, 2)) + rng.choices(steps, k=rng.randint(0, 4))
        books.append(blocks)
    books.append([POOL[0], *[POOL[21]] * 45, *foods[:3], POOL[18]])  # a title too far back
    frame, classed = facts(spark, books)
    got = {}
    for r in br.find_recipes(frame).collect():
        pairs = lambda c: None if r[c] is None else [tuple(x) for x in r[c]]  # noqa: B023, E731
        got.setdefault(r["path"], []).append((r["start"], r["title"], pairs("ingredients"), pairs("steps"), r["reason"]))
    wrong = [(b, [x["text"] for x in rows], sorted(got.get(b, []), key=str), sorted(walked(rows), key=str)) for b, rows in classed.items() if sorted(got.get(b, []), key=str) != sorted(walked(rows), key=str)]
    assert not wrong, (len(wrong), wrong[0])
    assert {r for b in got.values() for *_, r in b} >= {None, "no title", "no method"}


def test_classes_of_lines(spark):
    _, got = facts(spark, [POOL])
    food = [r["text"] for r in got[0] if r["ingredient"]]
    assert food == [x[2] for x in POOL[6:11]] + ["Large pinch of flakes", "juice of 1 lemon", "200g sugar"]
    assert [r["text"] for r in got[0] if r["title"]] == ["Plum Tart", "Chapter Two", "Filling", "SIMPLE SAUCE"]
    assert [r["text"] for r in got[0] if r["bare"]] == ["1 1/2 teaspoons salt", "Kosher salt", "Large pinch of flakes"]


def test_notes_yields_and_introductions(spark):
    lines = [("heading", 2, "Plum Tart"), ("text", 0, "Serves 4"), ("text", 0, "My aunt's."), ("text", 0, "2 cups flour"), ("text", 0, "1 egg, beaten"), ("text", 0, "3 plums")]
    lines += [("text", 0, "Yield"), ("text", 0, "One tart"), ("text", 0, "Read it first."), ("text", 0, "1. Mix."), ("text", 0, "a. Slowly"), ("text", 0, "2. Bake."), ("text", 0, "Note: It keeps."), ("text", 0, "An essay.")]
    frame, _ = facts(spark, [[(*x, "", False) for x in lines]])
    r = br.find_recipes(frame).first()
    assert (r["title"], r["introduction"], r["notes"], [s["text"] for s in r["steps"]]) == ("Plum Tart", "My aunt's. Read it first.", ["Note: It keeps."], ["Mix. a. Slowly", "Bake."])


def test_books_that_were_read(spark):
    """The rows of the book reader are what the finder takes."""
    from galley.sources import archives

    columns = archives.read_books(spark.createDataFrame([], "path string, content binary"))
    assert set(FIELDS) <= set(columns.columns) and br.find_recipes(columns).count() == 0


def test_blocks_are_dealt_to_their_books_once(spark):
    """From the written blocks to the recipes there is one shuffle of blocks, by book, and none by recipe."""
    books = [[("heading", 2, "Stew", "", False)] + [("text", 0, f"{k} cups beans", "", False) for k in range(2, 6)] + [("text", 0, "1. Stir well", "", False)]]
    frame, _ = facts(spark, books)
    found = br.find_recipes(frame, "path")
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert len(re.findall(r"Exchange hashpartitioning\(", plan)) == 1
    assert [(r["title"], len(r["ingredients"]), len(r["steps"])) for r in found.collect()] == [("Stew", 4, 1)]
