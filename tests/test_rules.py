import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from feira.operators import rules
from feira.plans import cleaning
from feira.schema import CATEGORY_TRANSLATION
from oracles.cities import UPDATES
from oracles.tables import city_steps
from oracles.text import quoted
from tests.golden import CATEGORIES, CITIES, ONE_EACH


def test_every_category_gets_its_class(spark):
    given_names = [(pt, en) for pt, en, _ in CATEGORIES[:-3]]
    dictionary = spark.createDataFrame(given_names, CATEGORY_TRANSLATION)
    got = {tuple(r) for r in cleaning.extended_categories(dictionary).collect()}
    assert got == set(CATEGORIES)


def test_category_edge_cases(spark):
    cases = {
        None: rules.OTHER_CATEGORY,
        "FASHION_X": "Fashion & Accessories",
        "books_technical": "Sports, Toys & Leisure",
        "home_appliances": "Electronics & Technology",
        "Toys ": "Sports, Toys & Leisure",
        "nothing known": rules.OTHER_CATEGORY,
    }
    df = spark.createDataFrame([(k,) for k in cases], "category_en string")
    got = {r[0]: r[1] for r in df.select("category_en", rules.main_category("category_en")).collect()}
    assert got == cases


def corrected(spark, pairs):
    df = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(pairs)], "n int, seller_city string, seller_state string")
    found = {r["n"]: (r["seller_city"], r["seller_state"]) for r in rules.clean_cities(df).collect()}
    return [found[i] for i in range(len(pairs))]


def test_cities_worked_out_by_hand(spark):
    assert corrected(spark, [before for before, _ in CITIES]) == [after for _, after in CITIES]


def test_one_pair_for_each_correction(spark):
    assert corrected(spark, [before for before, _ in ONE_EACH]) == [after for _, after in ONE_EACH]


def test_no_correction_can_be_left_out_or_changed_unnoticed(spark):
    """Without a correction, or with another result, its own pair comes out wrong."""
    assert len(ONE_EACH) == len(rules.CITY_RULES)
    pairs = [(i, *before) for i, (before, _) in enumerate(ONE_EACH)]
    df = spark.createDataFrame(pairs, "n int, city string, state string")
    changed = []
    for i, rule in enumerate(rules.CITY_RULES):
        other = rule._replace(city=rule.city and rule.city + "x", state=rule.state and rule.state + "x")
        for swapped in ([], [other]):
            listed = [*rules.CITY_RULES[:i], *swapped, *rules.CITY_RULES[i + 1 :]]
            changed.append(rules.fold_city_rules("city", "state", listed).alias(f"r{i}_{len(swapped)}"))
    rows = {r["n"]: r for r in df.select("n", *changed).collect()}
    for i, (_, after) in enumerate(ONE_EACH):
        for n in (0, 1):
            assert tuple(rows[i][f"r{i}_{n}"]) != after, (i, n)


def updated(pairs):
    """The literal updates of the SQL oracle, in another engine."""
    listed = ", ".join(f"({i}, {quoted(c)}, {quoted(s)})" for i, (c, s) in enumerate(pairs))
    steps = ", ".join(city_steps()).replace("seller_id", "n").split(", c_sellers AS")[0]
    sql = f"WITH raw_sellers AS (SELECT * FROM (VALUES {listed}) AS v(n, seller_city, seller_state)), {steps}"
    found = duckdb.sql(f"{sql} SELECT n, seller_city, seller_state FROM city_{len(UPDATES) - 1} ORDER BY n").fetchall()
    return [tuple(r[1:]) for r in found]


# Words to build cities from, as in the pairs above.
words = sorted({city for (city, _), _ in CITIES + ONE_EACH if city} | {city for _, (city, _) in CITIES + ONE_EACH if city})
cities = st.one_of(st.none(), st.builds(lambda a, w, b, up: (a + w + b).upper() if up else a + w + b,
                                       st.sampled_from(["", "x ", "s"]), st.sampled_from(words),
                                       st.sampled_from(["", " - sp", " "]), st.booleans()))
states = st.sampled_from(sorted({s for pair in CITIES + ONE_EACH for _, s in pair}) + ["sp", "AM", "rj "])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(cities, states), min_size=30, max_size=60))
def test_fold_equals_the_updates_one_by_one(spark, pairs):
    assert corrected(spark, pairs) == updated(pairs)
