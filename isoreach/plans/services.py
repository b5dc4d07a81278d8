"""Service points of Great Britain from national lists: practices, pharmacies, hospitals,
supermarkets, schools, urban centres and jobs.

Every list ends with the zone code its rows belong to; ``weights`` turns them into zone weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.functions import geodesy, naming, nulls, text
from isoreach.operators import geometry as g
from isoreach.operators import spatial as sp
from isoreach.operators.joins import lookup_join
from isoreach.operators.lookup import fill_from_lookup, override_missing
from isoreach.operators.reshape import stack
from isoreach.session import materialise

# Name patterns and type lists the selections are defined by.
BRANDS = ("Lidl", "ALDI", "Co-op", "Sainsbury", "Tesco", "Asda", "Morrisons")
SPECIALIST = (
    "birth", "maternity", " eye", "rheumatic", "throat", " nose ", " ear ", "neurology", "neurosurgery",
    "specialist emergency care", "orthopaedic", "heart hospital", "Children", "Dental",
)
PSYCHIATRIC = ("Mental", "Psychiatr(y|ic)", "Elder(|ly)", "learning disabili(ty|ties)", "Psychogeriatric")
DAY_CARE = ("Day (hospital|care)",)
SCHOOL_TYPES = (
    "Community school", "Voluntary aided school", "Voluntary controlled school", "Foundation school",
    "Academy sponsor led", "Academy converter", "Free schools", "University technical college", "Studio schools",
)
PRIMARY_PHASES = ("Primary", "Middle deemed primary", "All-through")
SECONDARY_PHASES = ("Secondary", "Middle deemed secondary", "All-through")
LARGE_SHOP_SQM = 280
BRITAIN = "^(E|S|W)"
MENTAL_HEALTH = "Mental Health Hospital"
OVERSEAS = "Jersey General Hospital"
COMMITTEE = "CHC Local Committee"
CURRENT_ZONES = ("lsoa11", "dz11")


# --- codes ---


def is_live(directory: DataFrame) -> Column:
    """Code in use and in Great Britain; a directory without county codes is judged by its zone codes."""
    place = "oscty" if "oscty" in directory.columns else "lsoa11"
    return F.col("doterm").isNull() & nulls.matches(place, BRITAIN)


def live_codes(directory: DataFrame) -> DataFrame:
    kept = [c for c in ("pcds", "oa11", "lsoa11", "lat", "long") if c in directory.columns]
    return directory.filter(is_live(directory)).select(*kept)


def locate(services: DataFrame, directory: DataFrame, key: str = "postcode") -> DataFrame:
    """Zone and coordinates by code: live codes first, retired ones for the rest."""
    columns = [c for c in ("oa11", "lsoa11", "lat", "long") if c in directory.columns]
    return fill_from_lookup(
        services, directory, key, "pcds", columns, preferred=is_live(directory), detect="lat", order="lsoa11"
    )


# --- general practices ---


def practices(england_wales: DataFrame, scotland: DataFrame, directory: DataFrame) -> DataFrame:
    """Active practices. The first list has no header: columns are ``X1`` to ``Xn``."""
    active = england_wales.filter((F.col("X13") == "A") & (F.col("X26") == "4"))
    active = active.select(*naming.by_position(active, [1, 2, 10])).toDF("practice_code", "practice_name", "postcode")
    north = naming.lower_names(scotland).select(
        F.col("practicecode").cast("string").alias("practice_code"), F.col("gppracticename").alias("practice_name"), "postcode"
    )
    return locate(stack(active, north), directory)


# --- pharmacies ---


def pharmacies(england: DataFrame, wales: DataFrame, scotland: DataFrame, live: DataFrame) -> DataFrame:
    """Scotland's list brings its own zones; the others get theirs from live codes only."""
    e = naming.clean_names(england).select(
        F.col("pharmacy_ods_code_f_code").cast("string").alias("source_id"), F.col("pharmacy_trading_name").alias("name"), "post_code"
    )
    w = naming.clean_names(wales).select(F.col("account").cast("string").alias("source_id"), F.col("trading_name").alias("name"), "post_code")
    s = naming.clean_names(scotland).select(
        F.col("disp_code").cast("string").alias("source_id"),
        F.col("disp_location_name").alias("name"),
        F.col("disp_location_postcode").alias("post_code"),
        F.col("datazone2011").alias("lsoa11"),
    )
    return stack(fill_from_lookup(stack(e, w), live, "post_code", "pcds", ["lsoa11"]), s)


# --- hospitals ---


def is_general_hospital(name: str) -> Column:
    """Neither psychiatric, specialist, committee nor day care. A missing name passes."""
    return nulls.lacks(name, nulls.any_of((*PSYCHIATRIC, *SPECIALIST, "Committee", *DAY_CARE)))


def zone_by_point(df: DataFrame, zones: DataFrame | sp.PolygonLayer, zone: str, x: str, y: str, key: str) -> DataFrame:
    """Fills a blank or missing ``zone`` from the polygon the point lies in; other rows stay as they are.

    Rows are told apart by ``key`` and place together, so a key may be missing or stand for several places.
    """
    place = F.to_json(F.struct(F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y")), {"ignoreNullFields": "false"})
    lost = df.filter(nulls.is_blank(zone)).select(place.alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).dropDuplicates(["id"])
    pairs = materialise(sp.points_in_polygons(lost, zones), "zone-pairs")
    pairs = pairs.select(F.col("id").alias("_key"), F.col("poly_id").cast("string").alias("_found"))
    # Rows that have a zone are not joined: a point on a border must not multiply them.
    asked = F.when(nulls.is_blank(zone), place)
    joined = lookup_join(df.withColumn("_key", asked), pairs, "_key", "left")
    filled = F.when(nulls.is_blank(zone), F.col("_found")).otherwise(F.col(zone))
    return joined.withColumn(zone, filled).select(*df.columns)


def hospitals(
    england: DataFrame, scotland: DataFrame, wales: DataFrame, live: DataFrame, zones: DataFrame | sp.PolygonLayer
) -> DataFrame:
    """``source_id, name, lsoa`` of general hospitals."""
    e = naming.clean_names(england)
    e = e.filter(
        (F.col("sub_type") != MENTAL_HEALTH)
        & is_general_hospital("organisation_name")
        & (F.col("organisation_name") != OVERSEAS)
    )
    e = fill_from_lookup(e, live, "postcode", "pcds", ["lsoa11"])
    e = geodesy.wgs84_to_grid(e, "latitude", "longitude", "x", "y")
    e = zone_by_point(e, zones, "lsoa11", "x", "y", "organisation_id")
    e = e.select(F.col("organisation_id").cast("string").alias("source_id"), F.col("organisation_name").alias("name"), F.col("lsoa11").alias("lsoa"))

    s = naming.clean_names(scotland).filter(is_general_hospital("location_name"))
    s = s.select(
        F.col("location_name").alias("name"), F.col("data_zone").alias("lsoa"), "x_coordinate", "y_coordinate",
        F.concat_ws("|", "x_coordinate", "y_coordinate").alias("_place"),
    )
    s = zone_by_point(s, zones, "lsoa", "x_coordinate", "y_coordinate", "_place").select("name", "lsoa")
    w = wales.filter(F.col("type") != COMMITTEE).select("name", F.col("lsoa11").alias("lsoa"))
    return stack(e, s, w)


# --- supermarkets ---


def supermarket_points(shops: DataFrame, shop_edges: DataFrame) -> DataFrame:
    """Named points, and centres of large enough polygons, without smaller services inside them.

    ``shops`` has ``id, name, brand, amenity`` and ``x, y`` where the shop is a point; a shop that
    is a polygon has NULL coordinates and edges under its id.
    """
    points = shops.filter(F.col("name").isNotNull() & F.col("x").isNotNull()).withColumn("area_sqm", nulls.typed_null("double"))
    shapes = g.areas(shop_edges).filter(F.col("area") > LARGE_SHOP_SQM)
    centres = g.centroids(shop_edges).join(shapes, "poly_id").select(
        F.col("poly_id").alias("id"), "x", "y", F.col("area").alias("area_sqm")
    )
    polygons = shops.filter(F.col("x").isNull()).drop("x", "y").join(centres, "id")
    both = stack(points, polygons).filter(F.col("amenity").isNull())
    return both.select("id", "name", "brand", "area_sqm", "x", "y")


def is_large_brand() -> Column:
    pattern = nulls.any_of(BRANDS)
    return nulls.matches("name", pattern) | nulls.matches("brand", pattern)


def supermarkets(points: DataFrame, mask: DataFrame, areas: DataFrame | sp.PolygonLayer, area_lookup: DataFrame) -> DataFrame:
    """Shops of the large brands within the mask, with output area and zone in Great Britain."""
    branded = materialise(points.filter(is_large_brand()), "shops")
    inside = materialise(sp.keep_inside(branded, mask), "shops")
    placed = sp.join_zone(inside, sp.points_in_polygons(inside, areas), "oa11cd")
    zones = naming.clean_names(area_lookup).select("oa11cd", "lsoa11cd")
    return lookup_join(placed, zones, "oa11cd", "left").filter(F.col("lsoa11cd").rlike(BRITAIN))


# --- schools ---


def england_flags(phase: str, low: str, high: str) -> tuple[Column, Column]:
    """(primary, secondary). A missing phase is no phase; a missing age leaves the secondary flag open."""
    primary = nulls.is_in(phase, PRIMARY_PHASES)
    secondary = nulls.is_in(phase, SECONDARY_PHASES) & (F.col(low) < 16) & (F.col(high) >= 16)
    return primary, secondary


def schools_england(raw: DataFrame, zones: DataFrame | sp.PolygonLayer) -> DataFrame:
    s = naming.clean_names(raw).filter(
        (F.col("establishment_status_name") == "Open")
        & (F.col("admissions_policy_name") != "Selective")
        & F.col("type_of_establishment_name").isin(*SCHOOL_TYPES)
    )
    primary, secondary = england_flags("phase_of_education_name", "statutory_low_age", "statutory_high_age")
    s = s.withColumns({"type_primary": primary, "type_secondary": secondary}).filter(F.col("type_primary") | F.col("type_secondary"))
    s = s.withColumn("lsoa_code", F.when(nulls.has_letter("lsoa_code"), F.col("lsoa_code")))
    s = zone_by_point(s, zones, "lsoa_code", "easting", "northing", "urn")
    s = geodesy.grid_to_wgs84(s, "easting", "northing")
    return s.select(
        F.col("urn").cast("string").alias("source_id"),
        F.col("establishment_name").alias("name"),
        nulls.paste(" | ", "street", "locality", "address3", "postcode", "town").alias("address"),
        "type_primary", "type_secondary",
        F.col("lsoa_code").alias("lsoa11"), "postcode", "long", "lat",
    )


def without_sentinel(df: DataFrame, sentinel: str = "---") -> DataFrame:
    """All text columns with the sentinel as NULL."""
    return df.select([nulls.blank_to_null(f.name, sentinel).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema.fields])


def schools_wales(raw: DataFrame, directory: DataFrame) -> DataFrame:
    s = without_sentinel(naming.clean_names(raw))
    middle = F.col("sector") == "Middle"
    s = s.withColumns({"type_primary": (F.col("sector") == "Primary") | middle, "type_secondary": (F.col("sector") == "Secondary") | middle})
    s = s.filter(F.col("type_primary") | F.col("type_secondary")).select(
        F.col("school_number").cast("string").alias("source_id"),
        F.col("school_name").alias("name"),
        nulls.paste(" | ", "address_1", "address_2", "address_3", "address_4", "postcode").alias("address"),
        "type_primary", "type_secondary",
        text.squish("postcode").alias("postcode"),
    )
    return locate(s, directory).drop("oa11")


def schools_scotland(raw: DataFrame, directory: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides`` holds ``source_id, lsoa11, lat, long`` for schools whose code is in no directory."""
    s = naming.clean_names(raw)
    s = s.withColumns({"type_primary": F.col("primary_department") == "Yes", "type_secondary": F.col("secondary_department") == "Yes"})
    s = s.filter(F.col("type_primary") | F.col("type_secondary")).select(
        F.col("seed_code").cast("string").alias("source_id"),
        F.col("school_name").alias("name"),
        nulls.paste(" | ", "address_line1", "address_line2", "address_line3").alias("address"),
        text.squish("post_code").alias("postcode"),
        "type_primary", "type_secondary",
    )
    return override_missing(locate(s, directory).drop("oa11"), overrides, "source_id", "lat")


def schools(england: DataFrame, wales: DataFrame, scotland: DataFrame) -> DataFrame:
    return stack(england, wales, scotland)


# --- urban centres ---


def urban_centres(centres: DataFrame, zone_centres: DataFrame, zones: DataFrame | sp.PolygonLayer) -> tuple[DataFrame, DataFrame]:
    """(main, secondary) centres with their zone. They are recognised by name, so one name may be both."""
    placed = materialise(sp.zone_or_nearest(centres, zones, "geo_code"), "centres")
    current = zone_centres.filter(F.col("zone_type").isin(*CURRENT_ZONES))

    def named(column: str) -> DataFrame:
        names = current.select(F.col(column).alias("name")).distinct()
        return lookup_join(placed, names, "name", "left_semi").select("name", "pop11", "geo_code")

    return named("main_bua"), named("nearest_bua")


# --- jobs ---


def employment(all_jobs: DataFrame, by_sector: DataFrame) -> DataFrame:
    """One row per zone: all jobs and jobs by sector, the spine of the weights.

    ``all_jobs`` has ``mnemonic, total``; ``by_sector`` has ``mnemonic`` and one column per sector
    under its long header.
    """
    total = naming.rename_where(all_jobs, lambda c: True, str.lower)
    spine = total.filter(F.col("total").isNotNull()).select(F.col("mnemonic").alias("lsoa11cd"), F.col("total").alias("employment_all"))
    sectors = by_sector.select(*[F.col(f"`{c}`") for c in by_sector.columns if not c.startswith("..")])
    sectors = naming.clean_names(sectors).drop("area")
    headers = [c for c in sectors.columns if c != "mnemonic"]
    sectors = sectors.select(F.col("mnemonic").alias("lsoa11cd"), *[F.col(o).alias(n) for o, n in zip(headers, naming.sector_names(headers))])
    return lookup_join(spine, sectors, "lsoa11cd", "left")
