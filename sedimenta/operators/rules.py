"""Ordered first-match classifiers from rule tables; the order of the arms is the meaning.

A rule is (label, any of these terms[, all of these as well]); terms are substrings of the lower-cased text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions.text import extract as text_field
from sedimenta.functions.text import FACILITIES, NAMED_PLACES, REGIONS, every, found_terms, keyword_any, release_id, reporting_period

# Labels and terms of the classifiers.
RULES: dict[str, tuple[list[tuple], str | None]] = {
    "ura_policy_type": ([("gls_programme", ["gls", "government land sales", "land sales programme"]), ("site_tender", ["tender launch", "tender award", "site tender"]), ("market_statistics", ["quarterly statistics", "price index", "market data"]), ("flash_estimates", ["flash estimates", "price update"]), ("urban_planning", ["master plan", "urban planning"])], "general_announcement"),
    "ura_category": ([("land_supply", ["land sales", "gls", "tender"]), ("market_data", ["statistics", "price index", "market data"]), ("urban_planning", ["planning", "master plan"])], "policy_announcement"),
    "ura_data_subtype": ([("quarterly_statistics", ["quarterly"]), ("flash_estimates", ["flash"]), ("private_residential_data", ["private residential"]), ("commercial_data", ["commercial"])], "general_data"),
    "ura_land_subtype": ([("current_sites", ["current", "gls sites"]), ("sites_for_tender", ["tender"]), ("past_sites", ["past"])], "general_land_sales"),
    "ura_sentiment": ([("market_wide", ["gls programme", "land sales programme"]), ("market_wide", ["quarterly statistics", "price index"]), ("location_specific", ["tender launch", "tender award"]), ("policy_driven", ["cooling measures", "policy change"])], "moderate"),
    "hdb_policy_type": ([("bto_launch", ["bto", "build to order", "ballot", "launch"]), ("housing_grant", ["grant", "subsidy", "fresh start", "enhanced"]), ("resale_policy", ["resale", "selling", "transaction"]), ("rental_policy", ["rental", "rent", "lease"]), ("ec_development", ["ec", "executive condominium", "tender"]), ("community_development", ["community", "neighborhood", "resident"]), ("commercial_development", ["commercial", "business", "shop"])], "general_housing"),
    "hdb_grant_type": ([("fresh_start", ["fresh start"]), ("enhanced_grant", ["enhanced"], ["grant"]), ("proximity_grant", ["proximity"])], None),
    "mnd_policy_type": ([("cooling_measures", ["stamp duty", "ssd", "absd", "cooling"]), ("bto_policy", ["bto", "ballot", "launch"]), ("housing_grants", ["grant", "subsidy", "assistance"]), ("land_supply", ["gls", "land sales", "supply"]), ("estate_upgrading", ["upgrading", "hip", "ease", "improvement"])], "general_housing"),
    "sla_category": ([("land_acquisition", ["land acquisition", "compulsory acquisition"]), ("state_property_development", ["tender"], ["state property"]), ("regulatory_update", ["land betterment charge", "lbc"]), ("market_data", ["statistics", "data"])], "general_announcement"),
    "sla_development": ([("BTO", ["bto"]), ("private_housing", ["private"], ["housing"]), ("commercial", ["commercial"]), ("industrial", ["industrial"])], None),
    "bca_outlook": ([("inflationary_pressure", ["increase", "rising"]), ("deflationary_pressure", ["decrease", "falling"])], "stable"),
    "bca_trend": ([("improving", ["improving", "increase"]), ("declining", ["declining", "decrease"])], "stable"),
    "bca_compliance": ([("mandatory", ["mandatory", "requirement", "standard", "regulation"])], "voluntary"),
    "sfa_category": ([("food_infrastructure", ["hawker centre", "food court"]), ("agricultural_land", ["agricultural land", "farming"]), ("wholesale_infrastructure", ["wholesale centre", "fishery port"]), ("lease_extension", ["lease extension"])], "general_announcement"),
    "sfa_policy_type": ([("lease_extension", ["lease extension"]), ("land_allocation", ["land allocation", "tender"]), ("licensing", ["licensing"])], "announcement"),
    "sfa_policy_subtype": ([("wholesale_facilities", ["wholesale"]), ("farming_development", ["farming"]), ("hawker_development", ["hawker"])], "general"),
    "mas_subtype": ([("absd_adjustment", ["absd"]), ("tdsr_framework", ["tdsr"]), ("cooling_measures", ["cooling"]), ("lending_measures", ["lending"])], None),
}
#: Second-level arms by the first classifier's label.
SUBTYPES = {
    "gls_programme": ([("confirmed_list", ["confirmed list"]), ("reserve_list", ["reserve list"])], "programme_announcement"),
    "site_tender": ([("tender_launch", ["tender launch"]), ("tender_award", ["tender award"])], "tender_update"),
    "market_statistics": ([("quarterly_release", ["quarterly"]), ("flash_estimate", ["flash"])], "market_update"),
}
#: Flags: any of the terms.
FLAGS = {"bto_related": ["bto", "build to order", "ballot", "application", "launch", "exercise"], "risk_management": ["prudent", "risk", "stability", "sustainable"], "green_building": ["green mark"], "zero_energy": ["zero energy"]}
#: Conditions of three groups of fields, tested independently.
FIELD_GROUPS = {"infrastructure": ["lease extension", "wholesale centre", "fishery port"], "land": ["agricultural land", "farming", "land parcel"], "amenity": ["hawker centre", "food court", "hdb"]}


def first_match(text: Column, rules: list[tuple], default: str | None) -> Column:
    out = F.lit(default).cast("string")
    for label, any_of, *all_of in reversed(rules):
        test = keyword_any(text, any_of)
        for t in all_of[0] if all_of else []:
            test = test & keyword_any(text, [t])
        out = F.when(test, label).otherwise(out)
    return out


def classify(text: Column, name: str) -> Column:
    return first_match(text, *RULES[name])


def subtype(text: Column, kind: Column) -> Column:
    out = F.lit("general")
    for label, arms in SUBTYPES.items():
        out = F.when(kind == label, first_match(text, *arms)).otherwise(out)
    return out


def _part(text: Column, *parts: str) -> Column:
    """True if any part is in the text as it stands; null: false."""
    return reduce(lambda a, b: a | b, (F.contains(F.coalesce(text, F.lit("")), F.lit(p)) for p in parts))


def mas_policy(url: Column, text: Column) -> Column:
    """Type by address, then subtype by text: "type/subtype", null if the address tells nothing."""
    news, rule, macro, said = _part(url, "media-release", "news"), _part(url, "regulation", "notice"), _part(url, "macroprudential"), _part(url, "parliamentary", "speech")
    notice = first_match(text, [("tdsr_computation", ["tdsr"]), ("property_lending", ["property loan"]), ("housing_lending", ["housing loan"])], None)
    with_type = lambda kind, sub: F.concat_ws("/", F.lit(kind), sub)
    return (
        F.when(news, with_type("policy_announcement", classify(text, "mas_subtype"))).when(rule, with_type("regulatory_requirement", notice)).when(macro, F.lit("macroprudential_policy/policy_framework"))
        .when(said, with_type("policy_explanation", F.when(_part(url, "parliamentary"), "parliamentary_reply").otherwise("speech")))
    )


def route(category: Column, key: Column) -> Column:
    """The output bucket of a record, by category and id."""
    c, k = F.coalesce(category, F.lit("")), F.coalesce(key, F.lit(""))
    both = lambda t: F.contains(c, F.lit(t)) | F.contains(k, F.lit(t))
    return (
        F.when(F.contains(c, F.lit("food_infrastructure")) | F.contains(k, F.lit("newsroom")), "newsroom").when(F.contains(k, F.lit("food_retail")), "food_retail")
        .when(both("wholesale"), "wholesale_markets").when(both("agricultural"), "agricultural_land").otherwise("newsroom")
    )


# The policy type that goes with a category, types by kind of page, and labels with their terms.
SLA_POLICY = {"land_acquisition": "public_development", "state_property_development": "adaptive_reuse", "regulatory_update": "fee_revision", "market_data": "statistical_release", "general_announcement": "information_update"}
MEASURES = {"ABSD": ["absd"], "TDSR": ["tdsr"], "LTV": ["ltv"], "MSR": ["msr"]}
BORROWERS = {"private_property": ["private property"], "hdb_upgraders": ["hdb"], "first_time_buyers": ["first-time"], "investors": ["investor"]}
MATERIALS = ["steel", "concrete", "cement", "sand", "timber", "labor", "labour"]
COST_DRIVERS = ["supply chain", "material shortage", "labor costs", "inflation", "demand"]
IMPACTS = ["developers", "contractors", "buyers", "construction industry"]
EFFICIENCY = ["automation", "prefabrication", "digitalization", "planning", "technology"]


def sla_policy(text: Column) -> Column:
    """The policy type of the text's category."""
    kind = classify(text, "sla_category")
    return F.coalesce(*[F.when(kind == k, v) for k, v in SLA_POLICY.items()])


def institutions(text: Column) -> Column:
    """Banks, then finance companies, which count only where banks are named; null if none."""
    both = F.when(keyword_any(text, ["finance companies"]), F.array(F.lit("banks"), F.lit("finance_companies"))).otherwise(F.array(F.lit("banks")))
    return F.when(keyword_any(text, ["bank"]), both)


def field_groups(text: Column) -> Column:
    """Which of three groups of fields apply, each tested by itself, as a struct of flags."""
    return F.struct(*[keyword_any(text, terms).alias(name) for name, terms in FIELD_GROUPS.items()])


def bca_fields(text: Column, category: Column) -> Column:
    """The fields that a record's category calls for, as a struct with all of them; those of other categories, and those not found, are null."""
    is_ = lambda *kinds: category.isin(*kinds)
    release, data, output, rule = "media_releases", "construction_data", "productivity_reports", "regulatory_updates"
    types = {release: ("industry_announcement", "media_release"), data: ("market_data", "price_index"), output: ("industry_metrics", "productivity_index"), rule: ("regulatory_update", "building_standards")}
    fields = {
        "policy_type": F.coalesce(*[F.when(category == k, v[0]) for k, v in types.items()]), "policy_subtype": F.coalesce(*[F.when(category == k, v[1]) for k, v in types.items()]),
        "press_release_id": F.when(is_(release), release_id(text, "BCA")), "price_change_percent": F.when(is_(release), text_field(text, "price_change_any")), "key_materials": F.when(is_(release), found_terms(text, MATERIALS)),
        "cost_drivers": F.when(is_(release), found_terms(text, COST_DRIVERS)), "industry_impact": F.when(is_(release), found_terms(text, IMPACTS)),
        "reporting_period": F.when(is_(data), reporting_period(text)), "index_value": F.when(is_(data), text_field(text, "index_value")), "market_outlook": F.when(is_(data), classify(text, "bca_outlook")),
        "overall_productivity": F.when(is_(output), text_field(text, "overall_productivity")), "hdb_productivity": F.when(is_(output), text_field(text, "hdb_productivity")), "private_residential_productivity": F.when(is_(output), text_field(text, "private_productivity")),
        "productivity_trend": F.when(is_(output), classify(text, "bca_trend")), "efficiency_factors": F.when(is_(output), found_terms(text, EFFICIENCY)),
        "green_building_program": F.when(is_(rule) & keyword_any(text, ["green mark"]), "green_mark"), "sustainability_program": F.when(is_(rule) & keyword_any(text, ["zero energy"]), "zero_energy_building"), "compliance_type": F.when(is_(rule), classify(text, "bca_compliance")),
    }
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def by_category(text: Column, category: Column) -> Column:
    """The fields of bca_fields as JSON without those that are null; null for any other category."""
    own = bca_fields(text, category)
    return F.when(own["policy_type"].isNotNull(), F.to_json(own))


def sfa_fields(text: Column, newsroom: Column) -> Column:
    """Category, the fields of newsroom records, and those of each group whose condition holds; lists are sorted sets.

    A group's fields are null where it doesn't apply; the group's own flag tells that from a field that was not found.
    """
    g = field_groups(text)
    on = lambda group, value: F.when(g[group], value)
    fields = {
        "category": classify(text, "sfa_category"), "press_release_id": F.when(newsroom, release_id(text, "SFA", r"[_\s]", 3, any_case=False)), "policy_type": F.when(newsroom, classify(text, "sfa_policy_type")), "policy_subtype": F.when(newsroom, classify(text, "sfa_policy_subtype")),
        "infrastructure": g["infrastructure"], "facilities": on("infrastructure", every(text, FACILITIES)), "lease_duration": on("infrastructure", text_field(text, "lease_until")), "infrastructure_type": on("infrastructure", F.lit("food_distribution")),
        "regional_impact": on("infrastructure", every(text, REGIONS)), "supply_chain_security": on("infrastructure", F.lit(True)), "long_term_commitment": on("infrastructure", F.lit(True)),
        "land": g["land"], "locations": on("land", every(text, NAMED_PLACES)), "land_use": on("land", F.lit("agricultural")), "food_security": on("land", F.lit(True)), "rural_development": on("land", F.lit(True)), "regional_planning": on("land", F.lit(True)),
        "amenity": g["amenity"], "amenity_type": on("amenity", F.lit("food_facility")), "residential_impact": on("amenity", F.lit(True)), "community_facilities": on("amenity", F.lit(True)), "quality_of_life": on("amenity", F.lit(True)),
    }
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def any_sql(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{t}')" for t in terms) + ")"


def case_sql(column: str, rules: list[tuple], default: str | None) -> str:
    """The same rules as a SQL CASE."""
    arms = " ".join(f"WHEN {' AND '.join([any_sql(column, r[1]), *(any_sql(column, [t]) for t in (r[2] if len(r) > 2 else []))])} THEN '{r[0]}'" for r in rules)
    return f"CASE {arms} ELSE {'NULL' if default is None else repr(default)} END"
