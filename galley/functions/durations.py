"""Durations in text, in minutes or seconds, as Column expressions.

Texts are cut into numbers and words; a running sum holds a number until a word says what it counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.amounts import lookup, spelled, worth
from galley.functions.bind import let

# Minutes in the parts of an ISO 8601 duration, by letter and in order, and in the words for them.
YEAR = 525_600
DATE_MINUTES = {"Y": 525_600.0, "M": 43_200.0, "W": 10_080.0, "D": 1_440.0}
TIME_MINUTES = {"H": 60.0, "M": 1.0, "S": 1 / 60}
WORD_MINUTES = {
    **dict.fromkeys("d day days".split(), 1440.0),
    **dict.fromkeys("h hr hrs hour hours".split(), 60.0),
    **dict.fromkeys("m min mins minute minutes".split(), 1.0),
}
SPAN_SECONDS = {
    **dict.fromkeys("hr hrs hour hours".split(), 3600.0),
    **dict.fromkeys("min mins minute minutes".split(), 60.0),
    **dict.fromkeys("sec secs second seconds".split(), 1.0),
}
NUMBER_WORDS = {w: n for n, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}


def _minutes(total: Column) -> Column:
    return let(total, lambda t: F.when((t > 0) & (t < YEAR), F.bround(t).cast("int")))


def _iso_part(part: Column, table: dict[str, float]) -> Column:
    """struct<ok, minutes, n> of number-letter pairs whose letters come in the order of the table."""
    pairs = r"(\d+(?:[.,]\d+)?)([A-Z])"
    numbers, names = F.regexp_extract_all(part, F.lit(pairs), 1), F.regexp_extract_all(part, F.lit(pairs), 2)
    order = F.transform(names, lambda x: F.instr(F.lit("".join(table)), x))
    whole = F.array_join(F.zip_with(numbers, names, lambda n, x: F.concat(n, x)), "") == part
    rising = (F.array_sort(F.array_distinct(order)) == order) & ~F.array_contains(order, 0)
    each = F.zip_with(numbers, names, lambda n, x: F.replace(n, F.lit(","), F.lit(".")).try_cast("double") * lookup(table, x))
    return F.struct((whole & rising).alias("ok"), F.aggregate(each, F.lit(0.0), lambda a, x: a + x).alias("minutes"), F.size(numbers).alias("n"))


def duration_minutes(text: Column) -> Column:
    """Minutes of an ISO 8601 duration or of amounts in text; null for none, zero, or a year and more."""
    packed = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    body = F.regexp_replace(packed, "^-?P", "")
    time_part = F.when(F.contains(body, F.lit("T")), F.substring_index(body, "T", -1)).otherwise("")

    def iso(date: Column, time: Column) -> Column:
        ok = F.rlike(packed, F.lit("^-?P")) & date["ok"] & time["ok"] & (date["n"] + time["n"] > 0)
        return F.when(ok, date["minutes"] + time["minutes"])

    of_iso = let(_iso_part(F.substring_index(body, "T", 1), DATE_MINUTES), lambda d: let(_iso_part(time_part, TIME_MINUTES), lambda t: iso(d, t)))
    said = r"(\d+(?:[.,]\d+)?)\s*([a-z]+)\b"
    low = F.lower(text)
    numbers, words = F.regexp_extract_all(low, F.lit(said), 1), F.regexp_extract_all(low, F.lit(said), 2)
    each = F.zip_with(numbers, words, lambda n, w: F.replace(n, F.lit(","), F.lit(".")).try_cast("double") * lookup(WORD_MINUTES, w))
    spoken = F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    return let(of_iso, lambda x: F.when(x.isNotNull(), _minutes(x)).otherwise(_minutes(spoken)))


def strict_minutes(text: Column) -> Column:
    """Minutes of a text that is a duration as a whole; a bare number is minutes, and prose gives null."""
    low = F.regexp_replace(F.lower(F.rtrim(F.btrim(text), F.lit(". "))), r"\s+total time$", "")
    cut = F.regexp_extract_all(spelled(low), F.lit(r"\d*\s*\+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?|[a-z]+|\S"), 0)
    kind = (
        lambda p: F.when(F.rlike(p, F.lit(r"\d")), F.when(F.contains(p, F.lit("/")), "f").otherwise("n"))
        .when(lookup(WORD_MINUTES, p).isNotNull(), "u")
        .when(p.isin(",", "and", "&", "."), "s")
        .otherwise("w")
    )
    number = lambda p: worth(F.regexp_replace(p, r"\s+", ""))
    held = lambda total, rest: F.struct(total.alias("sum"), rest.alias("held"))

    def step(a: Column, p: Column) -> Column:
        unit = lookup(WORD_MINUTES, p)
        counted = F.when(unit.isNotNull(), held(a["sum"] + a["held"] * unit, F.lit(0.0))).otherwise(a)
        return F.when(F.rlike(p, F.lit(r"\d")), held(a["sum"], a["held"] + number(p))).otherwise(counted)

    def whole(parts: Column) -> Column:
        total = F.bround(F.aggregate(parts, held(F.lit(0.0), F.lit(0.0)), step)["sum"]).cast("int")
        fits = F.rlike(F.array_join(F.transform(parts, kind), ""), F.lit("^((nf|n|f)us*)+$"))
        return let(total, lambda t: F.when(fits & (t > 0), t))

    bare = F.when(F.rlike(low, F.lit(r"^\d+$")), low.try_cast("int"))
    return F.coalesce(bare, let(cut, whole))


def duration_spans(text: Column) -> Column:
    """array<struct<start, end, text, seconds>>: each amount of time in prose, in code points; a range counts as its upper end.

    Numbers may be digits, fractions or words up to twelve.
    """
    one = rf"(?:\d+\s+\d+/\d+|\d+/\d+|(?:\d+\s*)?[½¼¾⅓⅔⅛⅜⅝⅞]|\d+(?:\.\d+)?|\b(?:{'|'.join(NUMBER_WORDS)})\b)"
    pattern = rf"(?i)({one}(?:\s*(?:-|–|to)\s*{one})?\s*(?:{'|'.join(sorted(SPAN_SECONDS, key=lambda w: (-len(w), w)))})\b)"
    cut = F.split(F.regexp_replace(text, pattern, "\u0001$1\u0001"), "\u0001", -1)
    placed = F.aggregate(
        cut,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), p.alias("text")))).alias("out")
        ),
        lambda a: F.filter(a["out"], lambda p, k: k % 2 == 1),
    )

    def seconds(said: Column) -> Column:
        low = F.lower(said)
        unit = lookup(SPAN_SECONDS, F.regexp_extract(low, "([a-z]+)$", 1))
        amount = F.trim(F.regexp_replace(low, "[a-z]+$", ""))
        last = F.trim(F.element_at(F.split(F.regexp_replace(amount, r"\s*\bto\b\s*", "-"), "[-–]"), -1))
        digits = F.aggregate(F.transform(F.split(spelled(last), r"\s+"), worth), F.lit(0.0), lambda a, x: a + x)
        return F.bround(F.coalesce(lookup({k: float(v) for k, v in NUMBER_WORDS.items()}, last), digits) * unit).cast("int")

    found = F.transform(
        placed,
        lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end"), p["text"].alias("text"), seconds(p["text"]).alias("seconds")),
    )
    return F.filter(found, lambda p: p["seconds"] > 0)


def span_seconds(text: Column) -> Column:
    """array<int>: seconds of each amount of time in prose, in order; a range counts as its upper end."""
    return F.transform(duration_spans(text), lambda p: p["seconds"])


def clock(seconds: Column) -> Column:
    """h:mm:ss from an hour on, else m:ss."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(seconds >= 3600, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def hours_and_minutes(minutes: Column) -> Column:
    """2 hr 5 min, 45 min; null for none."""
    h, m = F.floor(minutes / 60), minutes % 60
    parts = F.concat_ws(" ", F.when(h > 0, F.format_string("%d hr", h)), F.when(m > 0, F.format_string("%d min", m)))
    return F.when(minutes > 0, parts)


def note_times(notes: Column, labels: dict[str, str]) -> Column:
    """map<kind, minutes>: of "Label: duration" lines the first of each kind that is a duration. labels: label to kind."""
    parsed = F.transform(
        notes,
        lambda n: F.struct(
            lookup(labels, F.lower(F.trim(F.substring_index(n, ":", 1)))).alias("kind"),
            F.when(F.contains(n, F.lit(":")), strict_minutes(F.substr(n, F.instr(n, F.lit(":")) + 1))).alias("minutes"),
        ),
    )
    good = F.filter(parsed, lambda p: p["kind"].isNotNull() & p["minutes"].isNotNull())
    first = lambda g: F.filter(g, lambda p, k: F.array_position(F.transform(g, lambda q: q["kind"]), p["kind"]) == k + 1)
    return F.map_from_entries(let(good, first))


def iso_time(text: Column) -> Column:
    """A timestamp text, with or without a zone (then UTC), as ISO 8601 in UTC to the second; null for what is none."""
    zoned = F.when(F.rlike(text, F.lit(r"(?i)(z|[+-]\d\d:?\d\d)$")), text).otherwise(F.concat(text, F.lit("Z")))
    at = F.to_utc_timestamp(F.try_to_timestamp(zoned), F.current_timezone())
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
