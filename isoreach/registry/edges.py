"""Readers and writers: each query stores rows of the given tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoreach import fixtures as fx
from isoreach.functions import naming, text
from isoreach.operators import reshape
from isoreach.plans import metrics
from isoreach.registry import REGISTRY
from isoreach.registry.core import CUMULATIVE, CUTS, SERVICE_ROWS, duck, general_names, stored_access, wide_access
from isoreach.schemas import schema
from isoreach.session import materialise, scratch_path
from isoreach.sources import readers, sinks, versions

sql = fx.duck_sql
NAMED = schema("id long, name string, brand string, sub_type string")


def stored_csv(df, spark, label, header=True):
    path = scratch_path(spark, label)
    df.write.option("header", header).option("nullValue", "NA").option("emptyValue", "").csv(path)
    return path


@REGISTRY.add("S01_csv_header", sql("SELECT id, NULLIF(name, '') AS name, brand, sub_type FROM f_named"))
def s01(spark, sf_dir):
    """Padded, blank and NA cells of a delimited file with its columns in another order and some more."""
    padded = fx.view(spark, sf_dir, "f_named").withColumn("brand", F.concat(F.lit("  "), "brand", F.lit(" ")))
    padded = padded.select("sub_type", F.lit(7).alias("extra"), "brand", "id", F.col("name").alias("old name"), "name")
    return readers.read_csv(spark, stored_csv(padded, spark, "s01"), NAMED)


@REGISTRY.add("S02_csv_headerless", sql("SELECT CAST(id AS VARCHAR) AS X1, NULLIF(name, '') AS X2, brand AS X3, sub_type AS X4 FROM f_named"))
def s02(spark, sf_dir):
    path = stored_csv(fx.view(spark, sf_dir, "f_named"), spark, "s02", header=False)
    return readers.read_headerless(spark, path, 4)


@REGISTRY.add("S03_skip_preamble", sql("SELECT p_name AS area, p_partkey AS mnemonic, CAST(p_size AS DOUBLE) AS total FROM part"))
def s03(spark, sf_dir):
    """Files of at most 5,000 rows, each with eight lines before the header and notes at the end."""
    part = fx.table(spark, sf_dir, "part").withColumn("file", F.floor(F.col("p_partkey") / 5000))
    line = F.concat_ws(",", F.concat(F.lit('"'), "p_name", F.lit('"')), "p_partkey", "p_size")
    rows = part.select("file", (F.col("p_partkey") + 100).alias("line"), line.alias("value"))
    files = part.select("file").distinct()
    before = files.select("file", F.posexplode(F.array(*[F.lit(f"note {i}, 7, 7") for i in range(8)], F.lit('"area","mnemonic","total"'))).alias("line", "value"))
    after = files.select("file", F.lit(1 << 60).alias("line"), F.explode(F.array(F.lit(""), F.lit("Footnotes follow"), F.lit('"These figures are rounded",,'))).alias("value"))
    path = scratch_path(spark, "s03")
    lines = before.unionByName(rows).unionByName(after)
    lines.repartition("file").sortWithinPartitions("file", "line").select("file", "value").write.partitionBy("file").text(path)
    return readers.read_after_preamble(spark, path, 8, schema("area string, mnemonic long, total double"), "total")


@REGISTRY.add("S04_keep_blanks", sql("SELECT id, COALESCE(name, '') AS name, COALESCE(brand, '') AS brand, sub_type FROM f_named"))
def s04(spark, sf_dir):
    return readers.read_keeping_blanks(spark, stored_csv(fx.view(spark, sf_dir, "f_named"), spark, "s04"), NAMED)


def _tree(spark, sf_dir):
    root = scratch_path(spark, "tree")
    poi = fx.view(spark, sf_dir, "f_poi")
    orders = {"hospitals": ["zone_id", "source_id", "service"], "pharmacies": ["service", "source_id", "zone_id"]}
    for service in ("hospitals", "pharmacies", "gp_practices", "primary_schools"):
        own = poi.filter(F.col("service") == service).withColumn(f"{service}_note", F.lit("x"))
        own = own.select(*orders.get(service, own.columns))
        sinks.write_csv(own, f"{root}/{service}/access_{service}.csv")
    sinks.write_csv(poi.filter(F.col("service") == "supermarkets"), f"{root}/supermarkets/notes.csv")
    return readers.read_tree(spark, root, "*.csv", schema("source_id long, service string, zone_id long"))


@REGISTRY.add("S05_tree_read", sql("SELECT source_id, service, zone_id FROM f_poi"))
def s05(spark, sf_dir):
    return _tree(spark, sf_dir).drop("file_path")


@REGISTRY.add(
    "F13_files_by_name",
    sql("SELECT service, COUNT(*) AS n, TRUE AS measures FROM f_poi WHERE service <> 'supermarkets' GROUP BY 1 UNION ALL SELECT service, COUNT(*), FALSE FROM f_poi WHERE service = 'supermarkets' GROUP BY 1"),
)
def f13(spark, sf_dir):
    """Files chosen by a pattern of their path, and by its opposite."""
    tree = _tree(spark, sf_dir)
    parts = [
        readers.files_matching(tree, "/access_", invert).groupBy("service").agg(F.count(F.lit(1)).alias("n")).withColumn("measures", F.lit(not invert))
        for invert in (False, True)
    ]
    return parts[0].unionByName(parts[1])


@REGISTRY.add("S06_matrix_directory", sql("SELECT * FROM f_ttm"))
def s06(spark, sf_dir):
    """The travel matrix in its stored layout, read as one dataset."""
    path = scratch_path(spark, "ttm")
    sinks.write_matrix(fx.view(spark, sf_dir, "f_ttm"), path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    layout = schema("from_id long, to_id long, travel_time int, mode string, time_of_day string")
    return readers.read_directory(spark, path, layout)


@REGISTRY.add("S07_snapshot", sql("SELECT * FROM f_landuse"))
def s07(spark, sf_dir):
    path = scratch_path(spark, "s07")
    sinks.write_snapshot(fx.view(spark, sf_dir, "f_landuse"), path)
    return readers.read_directory(spark, path)


@REGISTRY.add("S07_slice_repair", sql("SELECT *, CASE mode WHEN 'pt' THEN 'public' ELSE 'own' END AS slice FROM f_ttm"))
def s07_repair(spark, sf_dir):
    """A matrix of two slices; one held wrong times and is replaced, the other stays as it was written."""
    matrix, path = fx.view(spark, sf_dir, "f_ttm"), scratch_path(spark, "s07-versions")
    public, own = matrix.filter("mode = 'pt'"), matrix.filter("mode <> 'pt'")
    wrong = public.withColumn("travel_time", F.col("travel_time") * 60).filter("from_id > 3")
    versions.write({"public": wrong, "own": own}, path)
    versions.write({"public": public}, path)
    return versions.read(spark, path)


@REGISTRY.add("S08_csv_write", sql("SELECT pcds, lsoa11, doterm, lat, long FROM f_postcode"))
def s08(spark, sf_dir):
    path = scratch_path(spark, "s08")
    sinks.write_csv(fx.view(spark, sf_dir, "f_postcode"), path)
    return readers.read_csv(spark, path, schema("pcds string, lsoa11 string, doterm string, lat double, long double"))


@REGISTRY.add("S09_fanout", duck("SELECT from_id AS geo_code, service, mode, time_of_day, time_cut, accessibility FROM q_relative_long"))
def s09(spark, sf_dir):
    """Long measures in one folder per service and mode."""
    access, land_use = wide_access(spark, sf_dir, nearest={})
    long = metrics.relative_long(materialise(access, "access"), land_use, CUMULATIVE).withColumnRenamed("from_id", "geo_code")
    path = scratch_path(spark, "s09")
    sinks.write_long_measures(long, path)
    return spark.read.schema(schema("geo_code long, time_of_day string, time_cut int, accessibility double, service string, mode string")).parquet(path)


@REGISTRY.add("S09_public_tables", duck(f"SELECT * FROM ({SERVICE_ROWS}) s"))
def s09_public(spark, sf_dir):
    """The public table of every service and mode, written, read back by name and stacked."""
    path = scratch_path(spark, "public")
    sinks.write_service_tables(stored_access(spark, sf_dir), list(CUMULATIVE), CUTS, path)
    found = []
    for service in CUMULATIVE:
        names = [naming.access_name(service, c) for c in CUTS] + [naming.pct_name(service, c) for c in CUTS]
        columns = ", ".join(["geo_code long, mode string, time_of_day string", *[f"{n} double" for n in names], f"{naming.nearest_name(service)} int"])
        read = readers.read_tree(spark, f"{path}/{service}", "*.csv", schema(columns), absent=True)
        found.append(general_names(read, service).withColumn("service", F.lit(service)))
    return reshape.stack(*found)


@REGISTRY.add(
    "S10_plain_numbers",
    sql("SELECT p_partkey, RTRIM(RTRIM(CAST(CAST(p_retailprice / 1000000 AS DECIMAL(38,12)) AS VARCHAR), '0'), '.') AS shown FROM part"),
)
def s10(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", text.fixed_point(F.col("p_retailprice") / 1_000_000, 12).alias("shown"))


@REGISTRY.add(
    "S11_inventory",
    sql("SELECT CONCAT('./kind=', p_type) AS folder, CAST(SUM(strlen(p_name) + 1) AS BIGINT) AS size FROM part GROUP BY 1"),
)
def s11(spark, sf_dir):
    """Sizes of files that hold the names of all parts, one folder for each type; their contents are not read."""
    path = scratch_path(spark, "s11-files")
    fx.table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), "p_name").write.partitionBy("kind").text(path)
    files = sinks.inventory(spark, path).filter(F.col("type") == "file")
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    return files.groupBy(folder).agg(F.sum("size").alias("size"))


@REGISTRY.add(
    "S11_directories",
    sql("SELECT DISTINCT CONCAT('./service=', service) AS path, 'directory' AS type FROM f_poi UNION ALL SELECT DISTINCT CONCAT('./service=', service, '/mode=', o_orderstatus), 'directory' FROM f_poi JOIN orders ON o_orderkey = source_id"),
)
def s11_directories(spark, sf_dir):
    """Folders of a result tree written by service and mode."""
    status = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("mode"))
    rows = fx.view(spark, sf_dir, "f_poi").join(status, "source_id").withColumnRenamed("zone_id", "geo_code")
    path = scratch_path(spark, "s11")
    sinks.write_long_measures(rows, path)
    return sinks.inventory(spark, path).filter((F.col("type") == "directory")).select("path", "type")
