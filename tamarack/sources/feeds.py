"""Listing feeds, page folders and search results as DataFrames with declared schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions import places, records

PLACE = (
    "id string, displayName struct<text: string, languageCode: string>, formattedAddress string, addressComponents array<struct<longText: string, shortText: string, types: array<string>, languageCode: string>>, location struct<latitude: double, longitude: double>, nationalPhoneNumber string, internationalPhoneNumber string, "
    "websiteUri string, businessStatus string, types array<string>, primaryType string, rating double, userRatingCount int, attributions array<struct<provider: string, providerUri: string>>"
)
PAGE = f"places array<struct<{PLACE.replace(' string', ': string').replace(' double', ': double').replace(' int,', ': int,')}>>, nextPageToken string"

_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """Name a source: a function of (spark, path, ...) that returns rows of (position, raw place)."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _SOURCES:
            raise ValueError(f"source {name} is registered")
        _SOURCES[name] = f
        return f

    return add


def unregister(name: str) -> None:
    _SOURCES.pop(name, None)


def get(name: str) -> Callable[..., DataFrame]:
    return _SOURCES[name]


def names() -> list[str]:
    return sorted(_SOURCES)


@register("google_places")
def places_pages(spark: SparkSession, path: str, limit: int = 60) -> DataFrame:
    """Result pages ``{places, nextPageToken}``, one JSON document a line and file, in file order.

    Each id once, at its first position; reading stops after a page without a token, and after one that
    brings no id that is new. ``limit`` belongs to the search, not to skew: a search returns 60 at most.
    """
    pages = spark.read.schema("value string").text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    parsed = pages.select("file", F.from_json("value", "places array<string>, nextPageToken string").alias("p"))
    rows = parsed.select("file", "p.nextPageToken", F.posexplode_outer("p.places").alias("at", "raw"))
    rows = rows.withColumn("place_id", F.get_json_object("raw", "$.id"))
    first = rows.groupBy("place_id").agg(F.min(F.struct("file", "at")).alias("first"))
    fresh = rows.join(first, "place_id", "left").groupBy("file").agg(F.count_if((F.col("first.file") == F.col("file")) & F.col("place_id").isNotNull()).alias("fresh"), F.max("nextPageToken").alias("token"))
    # a row for each result page of one search: three at most
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    read = fresh.withColumn("open", F.coalesce(F.min((F.col("token").isNotNull() & (F.col("fresh") > 0)).cast("int")).over(before), F.lit(1))).where("open = 1").select("file")
    kept = rows.where("raw is not null").join(F.broadcast(read), "file").join(first.select("place_id", "first"), "place_id", "left").where(F.col("place_id").isNull() | (F.struct("file", "at") == F.col("first")))
    order = Window.orderBy("file", "at")
    return kept.orderBy("file", "at").limit(limit).select((F.row_number().over(order) - 1).alias("position"), "raw")


@register("demo_fixture")
def fixture_feed(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One JSON document ``{places: [...]}``."""
    rows = spark.read.schema("value string").text(path, wholetext=True).select(F.posexplode(F.from_json("value", "places array<string>")["places"]).alias("position", "raw"))
    return rows if limit is None else rows.where(F.col("position") < limit)


def validated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid rows: a place needs an id; known fields must have their types; others are ignored."""
    parsed = rows.withColumn("place", F.from_json("raw", PLACE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("place").isNotNull() & F.col("place._bad").isNull() & (F.coalesce(F.col("place.id"), F.lit("")) != "")
    return parsed.where(ok), parsed.where(~ok).drop("place")


def candidates(valid: DataFrame, source: str) -> DataFrame:
    """Flat candidates of valid places; what is absent stays null."""
    p = lambda name: F.col(f"place.{name}")
    return valid.select(
        "position", F.lit(source).alias("source"), p("id").alias("source_record_id"), p("displayName.text").alias("name"), p("formattedAddress").alias("formatted_address"), p("addressComponents").alias("components"), F.coalesce(p("nationalPhoneNumber"), p("internationalPhoneNumber")).alias("phone"),
        p("websiteUri").alias("website"), p("location.latitude").alias("lat"), p("location.longitude").alias("lng"), p("businessStatus").alias("status"), p("primaryType").alias("primary_type"), p("types").alias("types"), p("rating").alias("rating"), p("userRatingCount").alias("user_rating_count"), "raw", F.sha2("raw", 256).alias("payload_hash"),
    )


def normalized(found: DataFrame) -> DataFrame:
    """Candidates in normal form: names, address parts, phone, website, industry, cell."""
    from tamarack.functions import geo, text, web

    site, home = web.parse_website(F.col("website")), places.from_components(F.col("components"), F.col("formatted_address"))
    point = geo.valid_point(F.col("lat"), F.col("lng"))
    out = found.select(
        "position", "source", "source_record_id", text.display_name(F.col("name")).alias("display_name"), text.normalize_name(F.col("name")).alias("normalized_name"), places.to_industry(F.col("primary_type"), F.col("types")).alias("industry"), home.alias("address"), places.to_e164(F.col("phone")).alias("phone_e164"), site["website"].alias("website"),
        site["domain"].alias("domain"), site["kind"].alias("website_kind"), places.business_status(F.col("status")).alias("business_status"), F.when(point, F.col("lat")).alias("lat"), F.when(point, F.col("lng")).alias("lng"), geo.geohash(F.col("lat"), F.col("lng")).alias("geohash7"),
        F.when(F.col("rating").between(1, 5), F.round("rating", 1)).alias("rating"), F.when(F.col("user_rating_count") >= 0, F.col("user_rating_count")).alias("user_rating_count"), "payload_hash",
    )
    return out.withColumn("name_key", text.name_key("normalized_name"))


def synced(stored: DataFrame, known: DataFrame) -> DataFrame:
    """Registry against the stored sources (name, kind, config, enabled): kind and config follow the registry, enabled stays."""
    joined = known.alias("k").join(stored.alias("s"), "name", "full_outer")
    return joined.select("name", F.coalesce("k.kind", "s.kind").alias("kind"), F.coalesce("k.config", "s.config").alias("config"), F.coalesce("s.enabled", F.lit(True)).alias("enabled"))


def page_folder(spark: SparkSession, path: str) -> DataFrame:
    """(host, file, html) of recorded pages below ``path``/<host>/."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(path)
    return read.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("host"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.decode("content", "UTF-8").alias("html"))


def recorded_sites(spark: SparkSession, path: str) -> DataFrame:
    """(host, robots, meta, status) of recorded sites below ``path``/<host>/: robots.txt, meta.json and the status it gives (200 without).

    Spark does not list files whose name begins with an underscore, hence the name.
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,json,html}").option("recursiveFileLookup", "true").load(path)
    rows = read.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("host"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.decode("content", "UTF-8").alias("body"))
    one = lambda name: F.max(F.when(F.col("file") == name, F.col("body")))
    sites = rows.groupBy("host").agg(one("robots.txt").alias("robots"), one("meta.json").alias("meta"))
    return sites.withColumn("status", F.coalesce(F.get_json_object("meta", "$.status").cast("int"), F.lit(200)))


def page_speed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("psi", records.page_speed(F.col("raw")))
