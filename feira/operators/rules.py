"""Category classes and city corrections: the fixed values, and the expressions that apply them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: main categories, first match wins ------------------------------------------
# (label, exact English names, text contained in the name)
CATEGORY_CLASSES = [
    (
        "Electronics & Technology",
        [
            "computers_accessories", "telephony", "consoles_games", "audio", "tablets_printing_image",
            "fixed_telephony", "electronics", "home_appliances", "small_appliances", "musical_instruments",
            "music", "cds_dvds_musicals", "dvds_blu_ray", "cine_photo", "air_conditioning", "computers",
            "home_appliances_2", "security_and_services", "signaling_and_security",
        ],
        None,
    ),
    (
        "Fashion & Accessories",
        [
            "fashion_bags_accessories", "fashion_shoes", "fashion_male_clothing", "fashion_underwear_beach",
            "fashion_sport", "fashio_female_clothing", "fashion_childrens_clothes", "luggage_accessories",
        ],
        "fashion",
    ),
    (
        "Home & Furniture",
        [
            "bed_bath_table", "furniture_decor", "housewares", "kitchen_dining_laundry_garden_furniture",
            "furniture_living_room", "furniture_bedroom", "home_confort", "home_comfort_2", "home_construction",
            "la_cuisine", "furniture_mattress_and_upholstery", "office_furniture", "pet_shop",
            "small_appliances_home_oven_and_coffee",
        ],
        None,
    ),
    ("Beauty & Personal Care", ["perfumery", "diapers_and_hygiene"], None),
    (
        "Sports, Toys & Leisure",
        [
            "sports_leisure", "toys", "baby", "cool_stuff", "party_supplies", "christmas_supplies", "flowers",
            "food", "drinks", "food_drink", "watches_gifts",
        ],
        "book",
    ),
]
OTHER_CATEGORY = "Construction tools ,arts & Others"

# Categories that products use but the dictionary lacks.
EXTRA_CATEGORIES = [
    ("beleza_saude", "health & beauty", "Beauty & Personal Care"),
    ("portateis_cozinha_e_preparadores_de_alimentos", "portable_kitchen_and_food_preparators", "Electronics & Technology"),
    ("pc_gamer", "pc_gamer", "Electronics & Technology"),
]

EXTRA_SELLER = ("Ipirá", "BA")
# --- End of fixed values ------------------------------------------------------------------------


class Match(NamedTuple):
    """One alternative of a city rule: how the city must look, and the state it needs, if any."""

    how: str  # "is", "has" or "ends"
    text: str
    state: str | None = None


class CityRule(NamedTuple):
    any_of: list[Match]
    city: str | None = None
    state: str | None = None


def _has(text, state=None):
    return [Match("has", text, state)]


def _is(*texts, state=None):
    return [Match("is", t, state) for t in texts]


# --- Fixed values: city corrections, applied in this order; later rules see earlier results ----
CITY_RULES = [
    CityRule([Match("ends", "ao paulo", "SP")], city="sao paulo"),
    CityRule(_has("angra dos reis", "RJ"), city="angra dos reis"),
    CityRule(_has("porto seguro", "BA"), city="porto seguro"),
    CityRule(_has("minas gerais", "MG"), city="minas gerais"),
    CityRule(_has("auriflama", "SP"), city="auriflama"),
    CityRule(_has("aguas claras"), city="aguas claras", state="DF"),
    CityRule(_has("andradas"), state="MG"),
    CityRule(_has("ao bernardo do campo"), city="São Bernardo do Campo", state="SP"),
    CityRule(_has("camboriu", "SC"), city="Balneário Camboriú"),
    CityRule(_has("belo horizont"), city="Belo Horizonte", state="MG"),
    CityRule(_has("rasilia", "DF"), city="Brasilia"),
    CityRule(_has("cariacica", "ES"), city="cariacica"),
    CityRule(_has("caxias do sul"), city="caxias do sul", state="RS"),
    CityRule(_has("chapeco"), city="chapeco", state="SC"),
    CityRule(_has("curitiba"), city="curitiba", state="PR"),
    CityRule(_has("ferraz de  vasconcelos", "SP"), city="ferraz de  vasconcelos"),
    CityRule(_has("ipira"), state="SC"),
    CityRule(_has("itajai"), state="SC"),
    CityRule(_has("jaguariuna"), state="SP"),
    CityRule(_has("jacutinga"), state="MG"),
    CityRule(_has("juiz de fora"), state="MG"),
    CityRule(_has("lages", "SC"), city="lages"),
    CityRule(_has("londrina"), state="PR"),
    CityRule(_has("marechal candido rondon"), state="PR"),
    CityRule(_has("mogi das cruses", "SP") + _has("mogi das cruzes"), city="mogi das cruzes"),
    CityRule(_has("novo hamburgo", "RS"), city="novo hamburgo"),
    CityRule(_has("palhoca"), state="SC"),
    CityRule(_has("pinhalzinho"), state="SC"),
    CityRule(_has("porto alegre"), state="RS"),
    CityRule(_is("ribeirao pretp", state="SP"), city="ribeirao preto"),
    CityRule(_has("rio bonito"), state="RJ"),
    CityRule(_has("rio de janeiro"), state="RJ"),
    CityRule(_has("rio de janeiro"), city="rio de janeiro"),
    CityRule(_is("s jose do rio preto"), city="São José do Rio Preto"),
    CityRule(
        _is("santa barbara d oeste", "santa barbara d'oeste", "Santa Bárbara d'Oeste", state="SP"),
        city="Santa Bárbara d'Oeste",
    ),
    CityRule(
        _is("sao jose do rio pret") + _is("São José do Rio Preto", state="SP"), city="sao jose do rio preto"
    ),
    CityRule(_is("sao jose dos pinhais", "sao jose dos pinhas"), city="São José dos Pinhais", state="PR"),
    CityRule(_is("sao miguel d'oeste", state="SC"), city="sao miguel do oeste"),
    CityRule(
        _is("sao paluo", "sao paulo", "sao paulo - sp", "sao paulo sp", "sao paulop") + _is("sao pauo", state="SP"),
        city="são paulo",
    ),
    # A second alternative, a city that equals two different texts at once, can never hold.
    CityRule(_is("sbc"), city="São Bernardo do Campo"),
    CityRule(_is("sp") + _is("sp / sp", state="SP"), city="são paulo"),
    CityRule(_is("volta redonda"), state="RJ"),
]
# --- End of fixed values ------------------------------------------------------------------------


def main_category(category_en: Column | str) -> Column:
    """The class of an English category name, ignoring case; NULL is classed as other."""
    name = F.lower(F.col(category_en) if isinstance(category_en, str) else category_en)
    trimmed = F.rtrim(name)
    result = None
    for label, names, part in CATEGORY_CLASSES:
        hit = trimmed.isin(names)
        if part:
            hit = hit | name.contains(part)
        result = F.when(hit, label) if result is None else result.when(hit, label)
    return result.otherwise(OTHER_CATEGORY)


def _literal(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("'", "\\'") + "'"


def _rule_list(rules: list[CityRule]) -> Column:
    """The rules as one constant array, parsed from text in a single call."""

    def lower(value):
        return _literal(value and value.lower())

    def arm(m: Match) -> str:
        return f"named_struct('how', '{m.how}', 'text', {lower(m.text)}, 'state', {lower(m.state)})"

    def struct(r: CityRule) -> str:
        arms = ", ".join(arm(m) for m in r.any_of)
        return f"named_struct('arms', array({arms}), 'city', {_literal(r.city)}, 'state', {_literal(r.state)})"

    return F.expr(f"array({', '.join(struct(r) for r in rules)})")


def _arm_holds(place: Column, arm: Column) -> Column:
    city = F.lower(place["city"])
    looks = (
        F.when(arm["how"] == "has", city.contains(arm["text"]))
        .when(arm["how"] == "ends", city.endswith(arm["text"]))
        .otherwise(F.rtrim(city) == arm["text"])
    )
    return looks & (arm["state"].isNull() | (F.lower(F.rtrim(place["state"])) == arm["state"]))


def _apply_rule(place: Column, rule: Column) -> Column:
    holds = F.exists(rule["arms"], lambda arm: _arm_holds(place, arm))
    return F.when(
        holds,
        F.struct(
            F.coalesce(rule["city"], place["city"]).alias("city"),
            F.coalesce(rule["state"], place["state"]).alias("state"),
        ),
    ).otherwise(place)


def fold_city_rules(city: str, state: str, rules: list[CityRule] = CITY_RULES) -> Column:
    """(city, state) after all rules in order, as one expression: a fold over the rule list.

    Works row by row, so it needs no shuffle, and a city with very many sellers is no hot key.
    """
    start = F.struct(F.col(city).alias("city"), F.col(state).alias("state"))
    return F.aggregate(_rule_list(rules), start, _apply_rule)


def clean_cities(sellers: DataFrame) -> DataFrame:
    place = fold_city_rules("seller_city", "seller_state")
    others = [c for c in sellers.columns if c not in ("seller_city", "seller_state")]
    return sellers.select(*others, place.alias("place")).select(
        *others, F.col("place.city").alias("seller_city"), F.col("place.state").alias("seller_state")
    )
