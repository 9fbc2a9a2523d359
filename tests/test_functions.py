"""Golden cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from galley.functions import amounts, durations, text, urls

D = lambda f: lambda c: f(c.cast("double"))
CASES = [
    (amounts.parse_amount, "2 3/4 tbsp honey, warm", (2.75, "tbsp", "honey, warm")),
    (amounts.parse_amount, "4 – 6 sprigs thyme", (6.0, "sprig", "thyme")),
    (amounts.parse_amount, "2⅓ fl oz rose water", (7 / 3, "fl oz", "rose water")),
    (amounts.parse_amount, "pepper", (None, None, "pepper")),
    (amounts.parse_amount, "2 ripe plums", (2.0, None, "ripe plums")),
    (amounts.parse_amount, "3/0 y", (None, None, "y")),
    (amounts.parse_amount, "250g oats", (250.0, "g", "oats")),
    (amounts.parse_amount, "1 1/4-1½ lb cod", (1.5, "lb", "cod")),
    (amounts.parse_amount, "", (None, None, "")),
    (amounts.mean_amount, "4-6 pears", (5.0, "pears")),
    (amounts.split_line, "3 to 4 cups", (3.0, 4.0, "cups", "")),
    (amounts.number, "5 1/8", 5.125),
    (amounts.number, "5 or so", None),
    (amounts.exact, "0.125", (1, 8)),
    (lambda c: amounts.scaled(c, 1.5), "1 1/3", "2"),
    (lambda c: amounts.scaled(c, 2.0), "some", "some"),
    (lambda c: amounts.scaled_line(c, 0.5), "3-5 limes", "1½-2½ limes"),
    (lambda c: amounts.converted(c, "metric"), "2 lb mussels", "905 g mussels"),
    (lambda c: amounts.converted(c, "us"), "120 ml cider", "½ cup cider"),
    (lambda c: amounts.converted(c, "us"), "1 cup cider", "1 cup cider"),
    (lambda c: amounts.temperatures(c, "us"), "at 200 °C, later 425 degrees F", "at 390°F, later 425 degrees F"),
    (amounts.unit_system, "Cups", "us"),
    (amounts.food_key, "3 tbsp olive oil, plus more", "olive oil"),
    (amounts.food_key, "2 cloves garlic", "garlic"),
    (amounts.food_key, "6 oz thinly sliced leek", "leek"),
    (amounts.food_key, "well water", "well water"),
    (D(amounts.nice), "2.6667", "2⅔"),
    (D(amounts.nice), "0.875", "⅞"),
    (D(amounts.nice), "0.1", "0.1"),
    (D(amounts.client_fraction), "3.51", "3½"),
    (D(amounts.client_fraction), "11.2", "11"),
    (lambda c: amounts.display(F.lit("mass"), c.cast("double"), F.lit("oz")), "56.7", ("2", "oz")),
    (lambda c: amounts.display(F.lit("volume"), c.cast("double"), F.lit("l")), "1500", ("1½", "l")),
    (lambda c: amounts.display(F.lit("count:sprig"), c.cast("double"), F.lit("sprig")), "3", ("3", "sprigs")),
    (durations.duration_minutes, "PT2H30M", 150),
    (durations.duration_minutes, "P1DT6H", 1800),
    (durations.duration_minutes, "PT6H1D", 1440),
    (durations.duration_minutes, "2,5 hrs", 150),
    (durations.duration_minutes, "P0D", None),
    (durations.duration_minutes, "a while", None),
    (durations.strict_minutes, "3 hrs, 10 min", 190),
    (durations.strict_minutes, "¼ hour", 15),
    (durations.strict_minutes, "2 days and 3 hours", 3060),
    (durations.strict_minutes, "35", 35),
    (durations.strict_minutes, "stir 5 minutes", None),
    (durations.span_seconds, "Rest 45 secs; bake three hours or 20 to 25 min.", [45, 10800, 1500]),
    (lambda c: durations.duration_spans(c)[0]["start"], "Chill ½ hour", 6),
    (lambda c: durations.clock(c.cast("int")), "7384", "2:03:04"),
    (lambda c: durations.hours_and_minutes(c.cast("int")), "95", "1 hr 35 min"),
    (lambda c: durations.note_times(F.split(c, ";"), {"prep": "prep", "bake": "cook"}), "Prep: 10 min;Prep: 2 hr;Bake: hot", {"prep": 10}),
    (durations.iso_time, "2023-05-06T07:08:09-01:00", "2023-05-06T08:08:09+00:00"),
    (urls.match_url, "http://www.Kitchen-Notes.example/soup/?utm_medium=a&trk=b#top", "https://kitchen-notes.example/soup"),
    (urls.match_url, "https://soup.example/p?page=3&gclid=1&mc_eid=2", "https://soup.example/p?page=3"),
    (urls.match_url, "https://soup.example/p?z=1&y=2", "https://soup.example/p?y=2&z=1"),
    (urls.match_url, "https://soup.example:443/p//q/", "https://soup.example/p/q"),
    (urls.match_url, "mailto:x", None),
    (urls.match_url, None, None),
    (urls.import_url, "soup.example/stew/", "https://soup.example/stew"),
    (urls.import_url, "https://soup.example:8443/x", "https://soup.example:8443/x"),
    (urls.import_url, "ftp://soup.example/c", None),
    (urls.site, "https://www.Soup.example/a", "soup.example"),
    (text.slug, "Pâté  Niçois!", "pate-nicois"),
    (text.folded, "L’Été—ok", "l'ete-ok"),
    (text.evidence, "Ｆull-Width, ½ cup", "full width 1 2 cup"),
    (text.decoded, "Salt &amp;amp; <b>pepper</b>", "Salt & pepper"),
    (text.decoded, "Salt &amp;&amp; oil &notit; &#33;&amp", "Salt && oil &notit; !&amp"),
    (lambda c: text.named_id("6ba7b810-9dad-11d1-80b4-00c04fd430c8", c), "python.org", "886313e1-3b8a-5372-9b90-0c9aee199e5d"),
    (text.singular, "berries", "berry"),
    (text.singular, "glass", "glass"),
    (text.singular, "radishes", "radish"),
    (text.title_key, "The Café Soup (vegan) & Bread Recipe", "cafe soup bread"),
    (lambda c: text.ingredient_name(c, amounts.MEASURES, amounts.PREPARATIONS), "2 cups chopped Onions, fine", "onion"),
    (text.alias_keys, "Fresh Basil-Leaves", ("fresh basil leaf", "basil fresh leaf", "basil leaf")),
    (text.numbers, "Six eggs, 1½ cups and 350 more", ["1", "1/2", "350", "6"]),
    (lambda c: text.trivial_edit(c, F.lit("add ½ cup")), "Add 1/2  cup.", True),
    (lambda c: F.size(text.packed_sentences(c)), "Stir well now. " * 100 + "End.", 3),
    (text.title_case, "SOUP OF THE DAY", "Soup of the Day"),
    (text.title_case, "Soup of the day", "Soup of the day"),
    (lambda c: text.overlap(text.tokens(c), F.array(F.lit("b"), F.lit("z"))), "a b b c", 1 / 3),
    (lambda c: text.not_the_host(c, F.lit("soup.example")), "www.Soup.example", None),
    (text.letters_only, "Piñata Pie 3", "pi ata pie"),
    (lambda c: text.ratio(c, F.lit("tide")), "diet", 0.5),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_golden(case, spark):
    f, value, want = CASES[case]
    got = spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]
    assert (tuple(got) if isinstance(want, tuple) else got) == (pytest.approx(want) if isinstance(want, float) else want)


def test_nearest_of_many_is_nearest(spark):
    """The same fraction as the expression gives, also below zero, on ties and for null."""
    values = [0.0, 0.125, 1 / 3, -1 / 3, 2.5, -2.5, 7.0078125, 0.99999, 123456.789, 1e-7, 0.5 / 129, None, *[k / 97 for k in range(60)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for among in ([*range(1, 129), 1000, 10000], list(range(1, 33))):
        got = rows.select("v", amounts.nearest(F.col("v"), among).alias("one"), amounts.nearest_of_many(F.col("v"), among).alias("many")).collect()
        assert all(r["many"] is None if r["v"] is None else tuple(r["one"]) == tuple(r["many"]) for r in got)


def test_plain_numbers_need_no_grammar(spark):
    said = {"7/4": 1.75, " 3 ": 3.0, "2.50": 2.5, "1/0": None, "1 1/2": 1.5, "½": 0.5, "1-2": None, "x": None, "": None, "3/": None}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", amounts.number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == said


def test_long_work_is_dealt_out(spark, sf):
    """The one file of parts is read by one task; what titles take is done by many."""
    from galley.plans import kitchen_queries

    assert kitchen_queries.title_clean_up(spark, sf).rdd.getNumPartitions() > 1


def test_extractions_are_dealt_out(spark, sf):
    """One task would read all parts and hold all of their words."""
    from galley.plans import kitchen_queries

    assert "REPARTITION_BY_NUM" in kitchen_queries.checked_extractions(spark, sf)._jdf.queryExecution().toString()


def test_more_rows_are_dealt_to_more_tasks(spark, sf):
    """What one task holds stays as it is when a table grows."""
    from galley.plans import catalog_queries
    from galley.sources.tables import table, tasks_for

    parts = table(spark, sf, "part")
    assert tasks_for(parts, 10) == 1 + parts.count() // 10
    plan = catalog_queries.coverage_rank(spark, sf)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_words_of_an_extraction_are_counted_where_it_is(spark, sf):
    """Regions are dealt by number; words are not dealt out after that, by bytes, once and again."""
    from galley.plans import kitchen_queries

    plan = kitchen_queries.checked_extractions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan


def test_folding_needs_no_package_on_workers(spark):
    """A session without the package on its workers' path folds as well; what is sent to them holds no name of it."""
    from pyspark.cloudpickle import dumps

    from galley.functions import text

    sent = []
    held = text._each
    text._each = lambda f: sent.append(dumps(f)) or held(f)
    try:
        rows = spark.createDataFrame([("Crème ’A",), ("PLAIN",), (None,)], "t string").select(text.folded(F.col("t")).alias("t")).collect()
    finally:
        text._each = held
    assert [r["t"] for r in rows] == ["creme 'a", "plain", None]
    assert sent and b"_without_marks" not in sent[0]
