"""Quantities, units and food names in text, as Column expressions.

A line is cut into words, and each word has a kind of one letter: ``n`` a number, ``f`` a fraction, ``m`` a number with a vulgar
fraction behind it, ``r`` a range in one word, ``d`` a dash or "to", ``w`` anything else. The kinds of a line's words are its
shape, and a small grammar over shapes says how many words its amount takes. All tables are small maps of fixed values.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.bind import let

# Millilitres and grams of a unit, the singular of counted ones, and vulgar fractions.
VOLUME_ML = {
    **dict.fromkeys(("tsp", "teaspoon", "teaspoons"), 4.929),
    **dict.fromkeys(("tbsp", "tbs", "tablespoon", "tablespoons"), 14.787),
    "fl oz": 29.574,
    **dict.fromkeys(("c", "cup", "cups"), 236.59),
    **dict.fromkeys(("pint", "pints"), 473.18),
    **dict.fromkeys(("quart", "quarts"), 946.35),
    "gallon": 3785.4,
    **dict.fromkeys(("ml", "milliliter", "milliliters"), 1.0),
    **dict.fromkeys(("l", "liter", "liters"), 1000.0),
}
MASS_G = {
    **dict.fromkeys(("g", "gram", "grams"), 1.0),
    "kg": 1000.0,
    **dict.fromkeys(("oz", "ounce", "ounces"), 28.35),
    **dict.fromkeys(("lb", "lbs", "pound", "pounds"), 453.59),
}
COUNTED = {
    **{w + "s": w for w in "clove can stick sprig slice piece package jar head stalk sheet".split()},
    **{w: w for w in "clove can stick bunch sprig slice piece package jar head stalk pinch dash handful sheet loaf bottle".split()},
    "bunches": "bunch",
}
VULGAR = {
    "½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8",
    "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6",
}
GLYPHS = {v: k for k, v in VULGAR.items()}
#: Units a shopping list is shown in: family, whether metric, least amount in base units, base units in one, one, several.
SHOWN = (
    ("volume", True, 1000.0, 1000.0, "l", "l"),
    ("volume", True, 0.0, 1.0, "ml", "ml"),
    ("volume", False, 236.59 / 4 * 0.99, 236.59, "cup", "cups"),
    ("volume", False, 14.787 * 0.99, 14.787, "tbsp", "tbsp"),
    ("volume", False, 0.0, 4.929, "tsp", "tsp"),
    ("mass", True, 1000.0, 1000.0, "kg", "kg"),
    ("mass", True, 0.0, 1.0, "g", "g"),
    ("mass", False, 453.59 * 0.99, 453.59, "lb", "lb"),
    ("mass", False, 0.0, 28.35, "oz", "oz"),
)
METRIC = ("ml", "l", "milliliter", "milliliters", "liter", "liters", "g", "gram", "grams", "kg", "kilogram", "kilograms", "°c")
US = ("cup", "cups", "tablespoon", "tablespoons", "tbsp", "teaspoon", "teaspoons", "tsp", "ounce", "ounces", "oz", "pound", "pounds", "lb", "lbs", "°f")

_ONE = r"\d+(?:\.\d+)?|(?:\d+)?\+\d+/\d+|\d+/\d+"


def lookup(table: dict, key: Column) -> Column:
    """The value of a small fixed table, null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), key)


def spelled(text: Column) -> Column:
    """``text`` with each vulgar fraction written out behind a plus: 1½ is 1+1/2."""
    return reduce(lambda t, g: F.replace(t, F.lit(g), F.lit("+" + VULGAR[g])), VULGAR, text)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def kind(word: Column) -> Column:
    """The letter of a spelled word."""
    is_ = lambda pattern: F.rlike(word, F.lit(f"^(?:{pattern})$"))
    return (
        F.when(is_(r"\d+(?:\.\d+)?"), "n")
        .when(is_(r"\+?\d+/\d+"), "f")
        .when(is_(r"\d+\+\d+/\d+"), "m")
        .when(is_(rf"(?:{_ONE})[-–—](?:{_ONE})"), "r")
        .when(word.isin("-", "–", "—", "to"), "d")
        .otherwise("w")
    )


def worth(word: Column) -> Column:
    """The number that a spelled word of kind n, f or m stands for; null for a division by zero."""
    side = lambda p, k: F.get(F.split(p, "/"), F.lit(k)).try_cast("double")
    each = F.transform(
        F.filter(F.split(word, r"\+"), lambda p: p != ""),
        lambda p: F.when(F.contains(p, F.lit("/")), F.try_divide(side(p, 0), side(p, 1))).otherwise(p.try_cast("double")),
    )
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def amount_of(text: Column) -> Column:
    """struct<low, high, used, words>: the amount a line begins with, how many of its words it takes, and its words.

    high is null without a range; low is null without an amount. A number that letters touch (500g) is taken off them.
    """
    line = F.regexp_replace(text, r"^(\s*[\d./½¼¾⅓⅔⅛⅜⅝⅞⅕⅖⅗⅘⅙⅚]+)(?=[A-Za-z])", "$1 ")
    grammar = F.lit("^(?:n?r|(?:nf|[nfm])(?:d(?:nf|[nfm]))?)")

    def read(words: Column, plain: Column, shape: Column, whole: Column) -> Column:
        first = F.length(F.regexp_extract(shape, "^(nf|[nfm])", 0))
        total = lambda start, n: F.aggregate(F.transform(F.slice(plain, start, n), worth), F.lit(0.0), lambda a, x: a + x)
        ends = F.split(F.get(plain, F.length(whole) - 1), "[-–—]")
        inside, across = F.endswith(whole, F.lit("r")), F.contains(whole, F.lit("d"))
        low = F.when(inside, total(F.lit(1), F.length(whole) - 1) + worth(F.get(ends, F.lit(0)))).when(whole != "", total(F.lit(1), first))
        high = F.when(inside, worth(F.get(ends, F.lit(1)))).when(across, total(first + 2, F.length(whole) - first - 1))
        return F.struct(low.alias("low"), high.alias("high"), F.length(whole).alias("used"), words.alias("words"))

    def shaped(words: Column, plain: Column) -> Column:
        return let(
            F.array_join(F.transform(plain, kind), ""),
            lambda shape: let(F.regexp_substr(shape, grammar), lambda whole: read(words, plain, shape, F.coalesce(whole, F.lit("")))),
        )

    return let(line, lambda x: let(words_of(x), lambda words: let(words_of(spelled(x)), lambda plain: shaped(words, plain))))


def _plain(text: Column) -> tuple[Column, Column]:
    """Whether a text is digits or a fraction of digits, as most amounts are, and its value, for which no grammar is needed."""
    side = lambda k: F.split_part(F.trim(text), F.lit("/"), F.lit(k)).try_cast("double")
    form = F.coalesce(F.rlike(F.trim(text), F.lit(r"^[0-9]+(?:\.[0-9]+|/[0-9]+)?$")), F.lit(False))
    return form, F.when(F.contains(text, F.lit("/")), F.try_divide(side(1), side(2))).otherwise(side(1))


def _read(text: Column) -> Column:
    return let(amount_of(F.trim(text)), lambda got: F.when((got["used"] == F.size(got["words"])) & got["high"].isNull(), got["low"]))


def number(text: Column) -> Column:
    """A number written as digits, a fraction, a mixed number or with a vulgar fraction; null for anything else."""
    plain, value = _plain(text)
    return F.when(plain, value).otherwise(_read(text))


def unit_at(words: Column, at: Column, bare: bool = False) -> Column:
    """struct<unit, used>: the measured or counted unit at a place and its number of words; null and 0 if none is there.

    Unless ``bare``, a word must follow: in "2 cups" the cups are what is counted.
    """
    clean = lambda k: F.lower(F.replace(F.coalesce(F.get(words, at + k), F.lit("")), F.lit("."), F.lit("")))

    def found(one: Column, two: Column) -> Column:
        pair = (one == "fl") & (two == "oz")
        long = F.when(pair, 2).otherwise(1)
        measured = lookup(VOLUME_ML, one).isNotNull() | lookup(MASS_G, one).isNotNull()
        unit = F.when(pair | (one == "floz"), F.lit("fl oz")).when(measured, one).otherwise(lookup(COUNTED, one))
        ends = F.lit(True) if bare else F.size(words) > at + long
        return let(F.when(ends, unit), lambda u: F.struct(u.alias("unit"), F.when(u.isNotNull(), long).otherwise(0).alias("used")))

    return let(clean(0), lambda one: let(clean(1), lambda two: found(one, two)))


def behind(words: Column, used: Column) -> Column:
    return F.array_join(F.slice(words, used + 1, F.greatest(F.size(words) - used, F.lit(0))), " ")


def parse_amount(text: Column) -> Column:
    """struct<quantity, unit, rest> of a line. A range counts as its upper end; a word that is no unit stays in the rest."""

    def parts(got: Column, unit: Column) -> Column:
        return F.struct(
            F.coalesce(got["high"], got["low"]).alias("quantity"),
            F.when(got["used"] > 0, unit["unit"]).alias("unit"),
            F.when(got["used"] == 0, text).otherwise(behind(got["words"], got["used"] + unit["used"])).alias("rest"),
        )

    return let(amount_of(text), lambda got: let(unit_at(got["words"], got["used"]), lambda unit: parts(got, unit)))


def mean_amount(text: Column) -> Column:
    """struct<quantity, word>: the amount a line begins with, the mean of a rising range, and the word behind it."""

    def parts(got: Column) -> Column:
        mean = F.when(got["high"] > got["low"], (got["low"] + got["high"]) / 2).otherwise(got["low"])
        word = F.regexp_extract(F.coalesce(F.get(got["words"], got["used"]), F.lit("")), "^[A-Za-z.]+", 0)
        return F.struct(mean.alias("quantity"), F.when(got["used"] > 0, word).alias("word"))

    return let(amount_of(text), parts)


def split_line(text: Column) -> Column:
    """struct<low, high, unit, rest> of a line, as a client shows it: both ends of a range, and a unit even at the end."""

    def parts(got: Column, unit: Column) -> Column:
        measured = F.when(lookup(VOLUME_ML, unit["unit"]).isNotNull() | lookup(MASS_G, unit["unit"]).isNotNull(), unit["unit"])
        used = got["used"] + F.when(measured.isNotNull(), unit["used"]).otherwise(0)
        whole = F.struct(got["low"].alias("low"), got["high"].alias("high"), measured.alias("unit"), behind(got["words"], used).alias("rest"))
        return F.when(got["used"] > 0, whole)

    return let(amount_of(text), lambda got: let(unit_at(got["words"], got["used"], bare=True), lambda unit: parts(got, unit)))


def family(unit: Column) -> Column:
    """struct<family, per>: volume or mass and the base units in one; otherwise a family of its own for each counted unit."""
    ml, grams = lookup(VOLUME_ML, unit), lookup(MASS_G, unit)
    return F.struct(
        F.when(ml.isNotNull(), "volume")
        .when(grams.isNotNull(), "mass")
        .otherwise(F.concat(F.lit("count:"), F.coalesce(unit, F.lit(""))))
        .alias("family"),
        F.coalesce(ml, grams, F.lit(1.0)).alias("per"),
    )


def unit_system(unit: Column) -> Column:
    """us, metric or neutral."""
    plain = F.lower(F.rtrim(F.trim(unit), F.lit(".")))
    return F.when(plain.isin(*US), "us").when(plain.isin(*METRIC), "metric").otherwise("neutral")


def nearest(value: Column, denominators: list[int]) -> Column:
    """struct<error, d, n>: the fraction n / d nearest to a value; of equally near ones the one with the least d."""
    each = F.transform(
        F.array(*map(F.lit, denominators)),
        lambda d: F.struct(
            F.round(F.abs(value - F.round(value * d) / d), 9).alias("error"), d.alias("d"), F.round(value * d).cast("long").alias("n")
        ),
    )
    return F.array_min(each)


def nearest_of_many(value: Column, denominators: list[int]) -> Column:
    """The same as ``nearest`` for a long list, which is tried for many values at once; null for null. Not for use inside ``let``."""
    d = np.array(denominators, dtype="float64")

    def half_up(x: np.ndarray) -> np.ndarray:
        whole = np.trunc(x)
        return whole + np.sign(x) * (np.abs(x - whole) >= 0.5)

    @F.pandas_udf("error double, d int, n long")
    def of(values: pd.Series) -> pd.DataFrame:
        v = values.to_numpy(dtype="float64", na_value=np.nan)[:, None]
        n = half_up(v * d)
        error = half_up(np.abs(v - n / d) * 1e9) / 1e9
        best = (np.arange(len(v)), np.lexsort((np.broadcast_to(d, error.shape), error))[:, 0])
        known = ~np.isnan(v[:, 0])
        shown = pd.DataFrame({"error": error[best], "d": d[best[1]], "n": n[best]}).astype({"d": "int32"})
        with np.errstate(invalid="raise"):
            shown["n"] = np.where(known, shown["n"], 0).astype("int64")
        return shown

    return F.when(value.isNotNull() & ~F.isnan(value), of(value))


def nearest_to(text: Column, factor: Column | float, denominators: list[int]) -> Column:
    """``nearest`` of an amount times a factor; null for what is no number."""
    plain, value = _plain(text)
    other = let(_read(text) * factor, lambda v: F.when(v.isNotNull(), nearest(v, denominators)))
    return F.when(plain, nearest_of_many(value * factor, denominators)).otherwise(other)


def shown_fraction(n: Column, d: Column, gap: str = "") -> Column:
    """A fraction in lowest terms as text: 7/4 is 1¾; one without a glyph is written out, behind ``gap``."""

    def shown(whole: Column, rest: Column) -> Column:
        written = F.concat_ws("/", rest.cast("string"), d.cast("string"))
        part = F.coalesce(lookup(GLYPHS, written), F.concat(F.when(whole > 0, F.lit(gap)).otherwise(F.lit("")), written))
        return F.when(rest == 0, whole.cast("string")).when(whole == 0, part).otherwise(F.concat(whole.cast("string"), part))

    return let(F.floor(n / d).cast("long"), lambda whole: let((n % d).cast("long"), lambda rest: shown(whole, rest)))


def decimals(value: Column, places: int = 2) -> Column:
    """A number with at most so many decimals, without zeros behind the last that counts."""
    return F.regexp_replace(F.format_string(f"%.{places}f", value.cast("double")), r"\.?0+$", "")


def nice(value: Column) -> Column:
    """A number with a vulgar fraction of halves, thirds, quarters or eighths if one is near, else with two decimals."""
    tried = F.transform(F.array(*map(F.lit, (2, 3, 4, 8))), lambda d: F.struct(d.alias("d"), F.bround(value * d).cast("long").alias("n")))
    best = F.get(F.filter(tried, lambda x: F.abs(value * x["d"] - x["n"]) < 0.02), F.lit(0))
    return let(best, lambda x: F.when(value.isNotNull(), F.coalesce(shown_fraction(x["n"], x["d"]), decimals(value))))


def client_fraction(value: Column) -> Column:
    """A number as a client shows it: whole from ten on, else the nearest of halves to eighths within 0.04, else two decimals."""

    def shown(v: Column, best: Column) -> Column:
        return (
            F.when(v < 0, decimals(v, 6))
            .when((v == F.floor(v)) | (v >= 10), F.round(v).cast("long").cast("string"))
            .when(best["error"] > 0.04, decimals(v))
            .otherwise(shown_fraction(best["n"], best["d"], " "))
        )

    return let(value, lambda v: let(nearest(v, [1, 2, 3, 4, 8]), lambda best: shown(v, best)))


def exact(text: Column) -> Column:
    """struct<n, d>: an amount as a fraction with the least denominator up to 10,000; null for what is no number."""
    best = nearest_to(text, 1.0, [*range(1, 129), 1000, 10000])
    return let(best, lambda x: F.when(x.isNotNull(), F.struct(x["n"].alias("n"), x["d"].cast("long").alias("d"))))


def scaled(text: Column, factor: Column | float) -> Column:
    """An amount times a factor, as text, to the nearest fraction with a denominator up to 32; no number stays as it is."""
    best = nearest_to(text, factor, list(range(1, 33)))
    return F.coalesce(let(best, lambda x: shown_fraction(x["n"], x["d"])), text)


def scaled_line(text: Column, factor: Column | float) -> Column:
    """A line with both ends of the amount it begins with times a factor; a line without one stays as it is."""
    by = F.lit(factor) if isinstance(factor, (int, float)) else factor

    def line(got: Column) -> Column:
        upper = F.when(got["high"].isNotNull(), F.concat(F.lit("-"), client_fraction(got["high"] * by))).otherwise("")
        whole = F.concat_ws(" ", F.concat(client_fraction(got["low"] * by), upper), F.nullif(behind(got["words"], got["used"]), F.lit("")))
        return F.when((got["used"] == 0) | (by == 1), text).otherwise(whole)

    return let(amount_of(text), line)


def display(family_name: Column, base: Column, hint: Column) -> Column:
    """struct<amount, unit> for a shopping list: metric if the first line was metric, else the largest fitting unit."""
    metric = F.coalesce(F.lower(hint).isin(*METRIC), F.lit(False))
    fields = "family metric least per one many".split()
    table = F.array(*[F.struct(*[F.lit(x).alias(f) for f, x in zip(fields, row, strict=True)]) for row in SHOWN])
    row = F.get(F.filter(table, lambda r: (r["family"] == family_name) & (r["metric"] == metric) & (base >= r["least"])), F.lit(0))
    name = F.nullif(F.regexp_extract(family_name, "^count:(.*)$", 1), F.lit(""))
    plural = F.concat(name, F.when(F.rlike(name, F.lit("(ch|sh)$")), "es").otherwise("s"))
    counted = F.when((base > 1) & ~F.endswith(name, F.lit("s")), plural).otherwise(name)

    def shown(r: Column) -> Column:
        unit = F.when(r.isNull(), counted).otherwise(F.when(base <= r["per"], r["one"]).otherwise(r["many"]))
        amount = F.when(r["per"] == 1, F.bround(base).cast("long").cast("string")).otherwise(
            let(base / F.coalesce(r["per"], F.lit(1.0)), nice)
        )
        return F.struct(amount.alias("amount"), unit.alias("unit"))

    return let(row, shown)


def converted(text: Column, to: str) -> Column:
    """A line with its amount in the other system: grams, millilitres and their thousands, or ounces, pounds, spoons and cups."""
    step = lambda x, s: F.greatest(F.lit(float(s)), F.round(x / s) * s)
    quarter = lambda x, k=4: client_fraction(F.round(x * k) / k)

    def metric(base: Column, fine: float, unit: str) -> Column:
        small = F.when(base < fine, F.round(base * 2) / 2).otherwise(step(base, 5))
        return F.when(base >= 1000, F.concat(decimals(F.round(base / 100) / 10), F.lit({"g": " kg", "ml": " l"}[unit]))).otherwise(
            F.concat(decimals(small), F.lit(f" {unit}"))
        )

    def us(base: Column, mass: Column) -> Column:
        ounces, spoons = base / MASS_G["oz"], base / VOLUME_ML["tsp"]
        cups = spoons / 48
        of_mass = F.when(ounces >= 16, F.concat(quarter(ounces / 16), F.lit(" lb"))).otherwise(F.concat(quarter(ounces), F.lit(" oz")))
        of_volume = (
            F.when(spoons < 3, F.concat(quarter(spoons), F.lit(" tsp")))
            .when(spoons < 12, F.concat(quarter(spoons / 3, 2), F.lit(" tbsp")))
            .otherwise(F.concat(quarter(cups), F.when(cups > 1.1, " cups").otherwise(" cup")))
        )
        return F.when(mass, of_mass).otherwise(of_volume)

    def show(value: Column, kinds: Column) -> Column:
        mass = kinds["family"] == "mass"
        metrics = lambda base: F.when(mass, metric(base, 10, "g")).otherwise(metric(base, 15, "ml"))
        return let(value * kinds["per"], lambda base: metrics(base) if to == "metric" else us(base, mass))

    def whole(got: Column, kinds: Column) -> Column:
        amount = let(
            show(got["low"], kinds),
            lambda low: F.when(got["high"].isNull(), low).otherwise(F.concat(F.substring_index(low, " ", 1), F.lit("–"), show(got["high"], kinds))),
        )
        other = unit_system(got["unit"]) == ("us" if to == "metric" else "metric")
        return F.when(other & got["unit"].isNotNull(), F.concat_ws(" ", amount, F.nullif(got["rest"], F.lit("")))).otherwise(text)

    return let(split_line(text), lambda got: let(family(got["unit"]), lambda kinds: whole(got, kinds)))


def temperatures(text: Column, to: str) -> Column:
    """A text with its temperatures (350°F, 180 degrees C) in the other scale, to the nearest five degrees."""
    cut = F.regexp_replace(text, r"(?i)(\d{2,3})\s*(?:°|degrees)\s*(fahrenheit|celsius|f|c)\b", "\u0001$1 $2\u0001")
    wanted = "f" if to == "metric" else "c"
    mark = F.regexp_replace(text, r"(?i)(\d{2,3}\s*(?:°|degrees)\s*(?:fahrenheit|celsius|f|c)\b)", "\u0001$1\u0001")
    said = F.split(mark, "\u0001", -1)

    def turned(part: Column, place: Column) -> Column:
        degrees, scale = F.substring_index(part, " ", 1).try_cast("double"), F.lower(F.left(F.substring_index(part, " ", -1), F.lit(1)))
        value = (degrees - 32) * 5 / 9 if to == "metric" else degrees * 9 / 5 + 32
        new = F.concat((F.round(value / 5) * 5).cast("int").cast("string"), F.lit("°C" if to == "metric" else "°F"))
        return F.when(place % 2 == 0, part).when(scale == wanted, new).otherwise(F.get(said, place))

    return F.array_join(F.transform(F.split(cut, "\u0001", -1), turned), "")


# Words before a food's name, and where its name ends.
SIZES = "heaping scant large small medium whole about approx".split()
MEASURES = (
    "c cup cups tablespoon tablespoons tbsp tbsps teaspoon teaspoons tsp tsps ounce ounces oz pound pounds lb lbs gram grams g kg ml "
    "liter liters l clove cloves can cans pinch pinches dash dashes stick sticks bunch bunches sprig sprigs slice slices piece pieces "
    "package packages pkg pkgs jar jars bottle bottles head heads stalk stalks quart quarts pint pints"
).split()
MANNERS = "finely roughly coarsely thinly freshly lightly very well packed loosely firmly".split()
PREPARATIONS = (
    "chopped diced minced sliced grated shredded crumbled cubed peeled trimmed melted softened beaten toasted cooked drained rinsed "
    "halved quartered"
).split()
ENDS = (",", ";", " for ", " to taste", " plus ", " or ")


def without_leading(words: Column, of: list[str]) -> Column:
    """``words`` from the first one on that is not in a set; a full stop behind a word does not count."""
    first = F.array_position(F.transform(words, lambda w: F.rtrim(w, F.lit(".")).isin(*of)), F.lit(False))
    none = F.array().cast("array<string>")
    return let(first, lambda k: F.when(k == 0, none).otherwise(F.slice(words, F.greatest(k, F.lit(1)).cast("int"), F.size(words))))


def food_key(text: Column) -> Column:
    """A short lower-case food name of an ingredient line: amount, unit, preparation and remarks are taken off."""
    line = F.lower(F.regexp_replace(text, r"\([^)]*\)", ""))
    line = F.ltrim(line, F.lit(" \t0123456789/.,-" + "".join(VULGAR)))
    first = lambda w: F.rtrim(F.get(w, F.lit(0)), F.lit("."))
    less = lambda w, when: F.when(when & (F.size(w) > 1), F.slice(w, 2, F.size(w))).otherwise(w)

    def named(rest: Column) -> Column:
        return reduce(lambda n, end: F.substring_index(n, end, 1), ENDS, F.array_join(rest, " "))

    def bare(words: Column, without: Column) -> Column:
        taken = F.slice(words, 1, F.size(words) - F.size(without))
        prepared = F.size(F.array_intersect(taken, F.array(*map(F.lit, PREPARATIONS)))) > 0
        return F.btrim(F.array_join(F.when(prepared, without).otherwise(words), " "), F.lit(" .-*"))

    stripped = let(words_of(line), lambda w: without_leading(w, SIZES))
    stripped = let(stripped, lambda w: less(w, first(w).isin(*MEASURES)))
    stripped = let(stripped, lambda w: less(w, first(w) == "of"))
    return let(
        let(stripped, lambda w: words_of(named(w))),
        lambda words: let(without_leading(words, MANNERS + PREPARATIONS), lambda without: bare(words, without)),
    )
