"""Addresses, phones, industries and listing fields, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street words written in short.
STREET_ABBREVIATIONS = {
    "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "rd": "road", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "cir": "circle", "pkwy": "parkway", "pky": "parkway", "hwy": "highway", "sq": "square", "ter": "terrace", "trl": "trail", "pl": "place", "expy": "expressway", "ste": "suite", "apt": "apartment", "bldg": "building", "fl": "floor",
    "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
}
# USPS codes of the states, the District of Columbia and Puerto Rico.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO",
    "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "puerto rico": "PR", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
# Listing type to industry.
INDUSTRIES = {
    "plumber": "plumbing", "electrician": "electrical", "roofing_contractor": "roofing", "general_contractor": "general_contracting", "hvac_contractor": "hvac", "painter": "painting", "locksmith": "locksmith", "moving_company": "moving", "storage": "storage", "landscaper": "landscaping", "pest_control_service": "pest_control", "house_cleaning_service": "cleaning", "laundry": "laundry",
    "car_repair": "auto_repair", "car_dealer": "auto_sales", "car_wash": "car_wash", "dentist": "dental", "dental_clinic": "dental", "doctor": "medical", "physiotherapist": "physiotherapy", "chiropractor": "chiropractic", "veterinary_care": "veterinary", "pharmacy": "pharmacy", "lawyer": "legal", "accounting": "accounting", "insurance_agency": "insurance", "real_estate_agency": "real_estate", "bank": "banking",
    "restaurant": "restaurant", "cafe": "cafe", "coffee_shop": "cafe", "bakery": "bakery", "bar": "bar", "hair_care": "hair_salon", "hair_salon": "hair_salon", "beauty_salon": "beauty", "nail_salon": "beauty", "spa": "spa", "gym": "fitness", "fitness_center": "fitness", "school": "education", "child_care_agency": "childcare", "lodging": "lodging", "hotel": "lodging", "florist": "florist",
    "pet_store": "pet_retail", "furniture_store": "furniture_retail", "hardware_store": "hardware_retail", "clothing_store": "clothing_retail", "grocery_store": "grocery", "supermarket": "grocery",
}
# Free text to industry.
TEXT_INDUSTRIES = {
    "plumber": "plumbing", "plumbing": "plumbing", "electrician": "electrical", "electrical": "electrical", "roofer": "roofing", "roofing": "roofing", "hvac": "hvac", "contractor": "general_contracting", "dentist": "dental", "dental": "dental", "lawyer": "legal", "attorney": "legal", "legal": "legal", "restaurant": "restaurant", "landscaping": "landscaping", "cleaning": "cleaning",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def state_code(raw: Column) -> Column:
    """Two-letter code of a state's code or name; null for anything else."""
    value = F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))
    return F.when(F.upper(value).isin(*STATES.values()), F.upper(value)).otherwise(_map(STATES)[F.replace(F.lower(value), F.lit("."), F.lit(""))])


def postal_code(raw: Column, country: Column | None = None) -> Column:
    """Five digits of a US code, or null if it isn't one; other countries' codes as given."""
    value = F.nullif(F.trim(raw), F.lit(""))
    us = F.nullif(F.regexp_extract(value, r"^(\d{5})(?:-\d{4})?$", 1), F.lit(""))
    return us if country is None else F.when(F.upper(F.coalesce(F.nullif(country, F.lit("")), F.lit("US"))) == "US", us).otherwise(value)


def street_key(*parts: Column) -> Column:
    """Lower-case words without punctuation, abbreviations written out; null if there are none."""
    text = F.lower(F.concat_ws(" ", *parts))
    words = F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")), " "), lambda w: w != "")
    known = _map(STREET_ABBREVIATIONS)
    return F.nullif(F.array_join(F.transform(words, lambda w: F.coalesce(known[w], w)), " "), F.lit(""))


def unit_line(unit: Column) -> Column:
    """``Suite`` before a bare unit; a unit that names its kind stays."""
    value = F.nullif(F.trim(unit), F.lit(""))
    return F.when(value.rlike(r"(?i)^(?:suite|ste|unit|apt|apartment|room|rm|bldg|building|floor|fl)\b|^#"), value).otherwise(F.concat(F.lit("Suite "), value))


def from_formatted(formatted: Column) -> Column:
    """{city, state, postal_code, country} from the tail of a formatted address; all null if it has none."""
    text = F.trim(formatted)
    cut = F.regexp_replace(text, r"(?i),\s*(?:USA|United States)\.?\s*$", "")
    tail = r"([^,]+),\s*([A-Za-z .]+?)\s+(\d{5}(?:-\d{4})?)\s*$"
    part = lambda i: F.regexp_extract(cut, tail, i)
    state = state_code(part(2))
    whole = state.isNotNull()
    return F.struct(
        F.when(whole, F.nullif(F.trim(F.regexp_replace(part(1), r"(?U)\s+", " ")), F.lit(""))).alias("city"), state.alias("state"), F.when(whole, postal_code(part(3))).alias("postal_code"), F.when(whole & (cut != text), "US").alias("country")
    )


def from_components(components: Column, formatted: Column) -> Column:
    """An address from listing components (longText, shortText, types), gaps filled from the formatted one."""
    of = lambda kind: F.get(F.filter(components, lambda c: F.array_contains(c["types"], kind)), F.lit(0))
    long = lambda kind: F.nullif(of(kind)["longText"], F.lit(""))
    short = lambda kind: F.coalesce(F.nullif(of(kind)["shortText"], F.lit("")), long(kind))
    tail = from_formatted(formatted)
    country = short("country")
    return F.struct(
        F.nullif(F.concat_ws(" ", long("street_number"), long("route")), F.lit("")).alias("line1"), unit_line(long("subpremise")).alias("line2"), street_key(long("street_number"), long("route")).alias("street_key"), F.coalesce(long("locality"), long("postal_town"), tail["city"]).alias("city"),
        F.coalesce(state_code(short("administrative_area_level_1")), tail["state"]).alias("state"), F.coalesce(postal_code(long("postal_code"), country), tail["postal_code"]).alias("postal_code"), F.coalesce(country, tail["country"]).alias("country"),
    )


def to_industry(primary: Column, types: Column) -> Column:
    """Industry of the first known type, the primary one first; ``other`` if none is known."""
    known = _map(INDUSTRIES)
    mapped = F.transform(F.concat(F.array(primary), F.coalesce(types, F.array().cast("array<string>"))), lambda t: known[F.lower(F.trim(t))])
    return F.coalesce(F.get(F.filter(mapped, lambda m: m.isNotNull()), F.lit(0)), F.lit("other"))


def industry_from_text(text: Column) -> Column:
    """Industry of the first known word; ``other`` if none is known."""
    known = _map(TEXT_INDUSTRIES)
    mapped = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: known[w])
    return F.coalesce(F.get(F.filter(mapped, lambda m: m.isNotNull()), F.lit(0)), F.lit("other"))


def business_status(raw: Column) -> Column:
    value = F.upper(F.trim(raw))
    return F.when(value.isin("OPERATIONAL", "CLOSED_TEMPORARILY", "CLOSED_PERMANENTLY"), F.lower(value)).otherwise(F.lit("unknown"))


def to_e164(raw: Column) -> Column:
    """+1 and ten digits of a valid North American number; null for anything else."""
    number = F.regexp_extract(F.regexp_replace(raw, r"[^\d]", ""), r"^1?([2-9]\d{2}[2-9]\d{6})$", 1)
    well = (number != "") & ~number.rlike(r"^.11|^...11.....$|^.{3}.11") & ~F.trim(raw).rlike(r"^\+(?!\s*1)")
    return F.when(well, F.concat(F.lit("+1"), number))


def national(e164: Column) -> Column:
    """``(AAA) BBB-CCCC``; other shapes stay."""
    return F.regexp_replace(e164, r"^\+1(\d{3})(\d{3})(\d{4})$", r"($1) $2-$3")


def effective_limit(requested: Column, cap: Column, most: int = 60) -> Column:
    return F.greatest(F.least(requested, F.least(cap, F.lit(most))), F.lit(0))


def run_call_ceiling(limit: Column, multiplier: int = 2, page: int = 20) -> Column:
    """Most calls that a run for so many results may make."""
    return F.lit(multiplier) * F.ceil(limit / page)


def build_query(industry: Column, city: Column, state: Column) -> Column:
    return F.when(city.isNotNull() & state.isNotNull(), F.concat(industry, F.lit(" in "), city, F.lit(", "), state)).otherwise(industry)
