"""File sources and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a scan of a folder looks at and what it passes over.
INCLUDE = [".md", ".txt", ".json", ".cursorrules"]
EXCLUDED = ["node_modules", ".git", "dist", "coverage"]


def wanted(path: Column, include: list[str] | None = None) -> Column:
    """True for paths with one of the suffixes or names, in any case, and outside excluded folders."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    test = F.lit(False)
    for suffix in include or INCLUDE:
        test = test | name.endswith(suffix.lower()) | (name == suffix.lower())
    for folder in EXCLUDED:
        test = test & ~path.contains(f"/{folder}/")
    return test


def _named(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are files, as Spark names them; only their status is asked for."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    out = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        for status in p.getFileSystem(conf).globStatus(p) or []:
            if status.isFile():
                out.append(status.getPath().toString())
    return out


def _found(spark: SparkSession, paths: list[str], include: list[str] | None) -> DataFrame:
    """Wanted files below folders, and every file named itself, whatever its suffix."""
    found, named = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths), _named(spark, paths)
    return found.where(wanted(F.col("path"), include) | F.col("path").isin(named) if named else wanted(F.col("path"), include))


def discover(spark: SparkSession, paths: list[str], include: list[str] | None = None) -> DataFrame:
    """path and length of wanted files below folders and of files named; nothing is read but their names."""
    return _found(spark, paths, include).select("path", "length")


def read_texts(spark: SparkSession, paths: list[str], include: list[str] | None = None) -> DataFrame:
    """file and text of the same files: UTF-8, with U+FFFD in place of bytes that are not."""
    return _found(spark, paths, include).select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def verified(spark: SparkSession, path: str, digest: str) -> bool:
    row = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).first()
    return digest.startswith("PLACEHOLDER") or (row is not None and row.d == digest)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def report_lines(scanned: DataFrame, fail_on: str = "high") -> DataFrame:
    """One line per file: [ok] or [BLOCKED], its risk level and number of threats."""
    from ..functions.risk import fails

    mark = F.when(fails(F.col("risk_level"), fail_on), "[BLOCKED]").otherwise("[ok]")
    return scanned.select("file", F.concat_ws(" ", mark, F.col("file"), F.concat(F.lit("risk="), "risk_level"), F.concat(F.lit("threats="), F.col("threats_found").cast("string"))).alias("line"))


def report_totals(scanned: DataFrame, fail_on: str = "high") -> DataFrame:
    from ..functions.risk import fails

    bad = fails(F.col("risk_level"), fail_on)
    return scanned.agg(F.count(F.lit(1)).alias("files"), F.count_if(bad).alias("blocked"), F.count_if("clean").alias("clean"), F.coalesce(F.bool_or(bad), F.lit(False)).cast("int").alias("exit_code"))


def report_json(scanned: DataFrame) -> DataFrame:
    """One JSON object per file: file and result."""
    return scanned.select(F.to_json(F.struct("file", F.struct(*[c for c in scanned.columns if c not in ("file", "text")]).alias("result"))).alias("value"))


def sarif(scanned: DataFrame, tool: str = "textward", version: str = "0.1.0") -> DataFrame:
    """A SARIF 2.1.0 log in one row (a report of one run, meant for a build's files): rules are the sorted detectors,
    a result has a character region only if its threat has a place."""
    level = lambda s: F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").otherwise("note")
    each = scanned.select("file", F.posexplode("threats").alias("k", "t"))
    region = F.when(F.col("t.location").isNotNull(), F.struct(F.col("t.location.offset").alias("charOffset"), F.col("t.location.length").alias("charLength")))
    where = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("t.detector_id").alias("ruleId"), level(F.col("t.severity")).alias("level"), F.struct(F.col("t.description").alias("text")).alias("message"), F.array(where).alias("locations"))
    run = each.agg(F.array_sort(F.collect_set("t.detector_id")).alias("ids"), F.array_sort(F.collect_list(F.struct("file", "k", result.alias("r")))).alias("rows"))
    title = lambda d: F.initcap(F.translate(d, "-_", "  "))
    rules = F.transform("ids", lambda d: F.struct(d.alias("id"), title(d).alias("name")))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), rules.alias("rules")).alias("driver"))
    log = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), F.transform("rows", lambda r: r["r"]).alias("results"))).alias("runs"))
    return run.select(F.to_json(log).alias("value"))
