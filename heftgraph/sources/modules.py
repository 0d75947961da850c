"""Package listings: JSON objects one after another, as the Go toolchain lists packages."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ImportPath string, Name string, Dir string, Standard boolean, Imports array<string>, Module struct<Path: string, Version: string, Main: boolean, Indirect: boolean, GoVersion: string>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row of SCHEMA, in order, for every object of the listings at path, however they are spaced; a listing is one row of a task."""

    def run(batches):
        decoder = json.JSONDecoder()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, found = 0, []
                while True:
                    while at < len(text) and text[at].isspace():
                        at += 1
                    if at == len(text):
                        break
                    end = decoder.raw_decode(text, at)[1]
                    found.append(text[at:end])
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    return parsed(spark.read.text(path, wholetext=True).select("value").mapInArrow(run, "value string"))


def parsed(records: DataFrame) -> DataFrame:
    """SCHEMA of records(value), one object each; the closing brace may be missing, blank records are left out, broken ones raise."""
    text = F.trim(F.col("value"), F.lit(" \t\r\n"))
    whole = F.when(F.col("value").rlike(r"(^|\n)\}\s*$") | text.rlike(r"^\{.*\}$"), text).otherwise(F.concat(text, F.lit("}")))
    return records.filter(F.length(text) > 0).select(F.from_json(whole, SCHEMA, {"mode": "FAILFAST"}).alias("p")).select("p.*")


def packages(listing: DataFrame) -> DataFrame:
    """pkg, name, dir, module ('' for the standard library), version, is_main, direct, go_version, at (place in the listing)."""
    mod = F.col("Module")
    main = F.coalesce(mod["Main"], F.lit(False))
    return listing.select(F.col("ImportPath").alias("pkg"), F.col("Name").alias("name"), F.col("Dir").alias("dir"), F.coalesce(mod["Path"], F.lit("")).alias("module"), F.coalesce(mod["Version"], F.lit("")).alias("version"), main.alias("is_main"), (mod.isNotNull() & ~main & ~F.coalesce(mod["Indirect"], F.lit(False))).alias("direct"), F.coalesce(mod["GoVersion"], F.lit("")).alias("go_version"), F.monotonically_increasing_id().alias("at"))


def imports(listing: DataFrame) -> DataFrame:
    """src, dst of imports between listed packages."""
    edges = listing.select(F.col("ImportPath").alias("src"), F.explode("Imports").alias("dst")).distinct()
    return edges.join(listing.select(F.col("ImportPath").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def roots(pkgs: DataFrame) -> DataFrame:
    """Packages of the main module, only commands if there are any; an error if there are none."""
    own = pkgs.filter("is_main")
    seen = own.agg(F.count("*").alias("n"), F.count_if(F.col("name") == "main").alias("commands")).first()
    if not seen["n"]:
        raise ValueError("no package of a main module is listed")
    return (own.filter("name = 'main'") if seen["commands"] else own).select("pkg")


def target(pkgs: DataFrame) -> str:
    """The one command of the main module."""
    found = [r["pkg"] for r in pkgs.filter("is_main and name = 'main'").select("pkg").limit(2).collect()]
    if len(found) != 1:
        raise ValueError("several commands are listed: name one" if found else "no command is listed")
    return found[0]


def listed(pkgs: DataFrame) -> DataFrame:
    """module, version, direct of every module but the main one, as first listed."""
    mods = pkgs.filter("module <> '' and not is_main")
    first = mods.groupBy("module").agg(F.min_by(F.struct("version", "direct"), "at").alias("x"))
    return first.select("module", "x.version", "x.direct")
