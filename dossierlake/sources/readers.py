"""Reading trees of JSON records. Bad files are set aside, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import text as T

# fixed values: file name endings
RESULT_SUFFIX = r"_(win|lose|contracted)\.json$"


def scan_records(
    spark: SparkSession, root: str, pattern: str = "*.json", recursive: bool = True
) -> DataFrame:
    """One row per file: path, name, facility and competition from the path, the record as
    VARIANT (NULL when the text is no JSON) and the raw text of unreadable files."""
    if pattern.startswith("_"):
        raw = _read_underscored(_walk(spark, root, pattern))
    else:
        raw = (
            spark.read.option("wholetext", "true")
            .option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", str(recursive).lower())
            .text(root)
            .select(
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_size").alias("file_size"),
                "value",
            )
        )
    record = F.try_parse_json("value")
    return raw.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "file_size",
        *path_keys("path"), record.alias("record"),
        F.when(record.isNull(), F.col("value")).alias("corrupt"),
    )


def _walk(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files of a facility/competition tree by name, found by tasks.

    Spark's file sources skip names that start with an underscore, so these are listed
    through Arrow file systems: the facility folders (a fixed, small number) by the driver,
    the competition folders and their files by tasks.
    """
    from pyarrow import fs

    uri = root if "://" in root else "file://" + root
    system, base = fs.FileSystem.from_uri(uri)
    prefix = uri[: len(uri) - len(base)] if uri.endswith(base) else ""
    facilities = [
        (prefix + f.path,) for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory
    ]
    folders = spark.createDataFrame(facilities, "path string").repartition(max(1, len(facilities)))
    competitions = folders.mapInPandas(_list_folder(None), "path string, length bigint")
    spread = competitions.select("path").repartition("path")
    return spread.mapInPandas(_list_folder(pattern), "path string, length bigint")


def _list_folder(pattern: str | None):
    """Sub-folders (no pattern) or matching files of every folder in a batch."""

    def run(batches):
        from fnmatch import fnmatch

        import pandas as pd
        from pyarrow import fs

        for frame in batches:
            for uri in frame["path"]:
                system, base = fs.FileSystem.from_uri(uri)
                prefix = uri[: len(uri) - len(base)]
                wanted = fs.FileType.File if pattern else fs.FileType.Directory
                found = [
                    (prefix + f.path, f.size or 0)
                    for f in system.get_file_info(fs.FileSelector(base))
                    if f.type == wanted and (pattern is None or fnmatch(f.base_name, pattern))
                ]
                yield pd.DataFrame(found, columns=["path", "length"]).astype({"path": "object", "length": "int64"})

    return run


def _read_underscored(files: DataFrame) -> DataFrame:
    """Whole text of every listed file, one at a time."""

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        for frame in batches:
            for uri, size in zip(frame["path"], frame["length"]):
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as f:
                    text = f.read().decode("utf-8", errors="replace")
                yield pd.DataFrame({"path": [uri], "file_size": [size], "value": [text]})

    return files.mapInPandas(run, "path string, file_size bigint, value string")


def path_keys(path: str) -> list[Column]:
    """facility_type and competition_id of .../{facility}/{competition}[/submissions]/{file}."""
    stem = F.regexp_replace(F.col(path), r"/submissions/[^/]+$|/[^/]+$", "")
    parts = F.split(stem, "/")
    return [
        F.get(F.reverse(parts), F.lit(1)).alias("facility_type"),
        F.get(F.reverse(parts), F.lit(0)).alias("competition_id"),
    ]


def readable(records: DataFrame) -> DataFrame:
    return records.filter(F.col("record").isNotNull())


def quarantine(records: DataFrame) -> DataFrame:
    """Files that could not be read, with their text."""
    return records.filter(F.col("record").isNull()).select("path", "corrupt")


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths only; file contents are not read."""
    if pattern.startswith("_"):
        return _walk(spark, root, pattern)
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(root).select("path", "length")
    )


def scan_projects(spark: SparkSession, root: str, facility_type: str | None = None) -> DataFrame:
    """Project records, with whether a report lies beside them."""
    projects = readable(scan_records(spark, root, "_meta.json"))
    if facility_type:
        projects = projects.filter(F.col("facility_type") == facility_type)
    reports = listing(spark, root, "_report.html").select(
        F.regexp_replace("path", r"/[^/]+$", "").alias("_dir"), F.lit(True).alias("_has")
    ).distinct()
    fields = {
        "competition_name": "string", "project_number": "string", "client": "string",
        "location": "string", "created_at": "string", "procurement_type": "string",
        "project_phase": "string", "role": "string", "partners": "string", "memo": "string",
        "tags": "array<string>",
    }
    base = projects.select(
        "path", "facility_type",
        F.coalesce(F.try_variant_get("record", "$.competition_id", "string"), F.col("competition_id")).alias("competition_id"),
        *[F.try_variant_get("record", f"$.{n}", t).alias(n) for n, t in fields.items()],
    )
    return (
        base.withColumn("_dir", F.regexp_replace("path", r"/[^/]+$", ""))
        .join(reports, "_dir", "left")
        .withColumn("report_available", F.coalesce("_has", F.lit(False)))
        .drop("_dir", "_has")
    )


def scan_submissions(spark: SparkSession, root: str) -> DataFrame:
    """Submission records; deep-analysis files of the same folder are left out."""
    files = scan_records(spark, root, "*.json").filter(
        F.col("path").contains("/submissions/") & ~F.col("file_name").endswith("_deep.json")
    )
    return readable(files).select(
        "facility_type", "competition_id",
        F.try_variant_get("record", "$.company", "string").alias("company"),
        F.coalesce(
            F.try_variant_get("record", "$.result", "string"),
            F.nullif(F.regexp_extract("file_name", RESULT_SUFFIX, 1), F.lit("")),
        ).alias("result"),
        F.try_variant_get("record", "$.total_pages", "int").alias("total_pages"),
        F.try_variant_get("record", "$.page_distribution", "map<string,int>").alias("page_distribution"),
        F.try_variant_get("record", "$.extracted_data", "variant").alias("extracted_data"),
        "path",
    )


def scan_deep(spark: SparkSession, root: str) -> DataFrame:
    return readable(scan_records(spark, root, "*_deep.json"))


def winners(submissions: DataFrame) -> DataFrame:
    return submissions.filter(F.col("result").isin("win", "contracted"))


def losers(submissions: DataFrame) -> DataFrame:
    return submissions.filter(F.col("result") == "lose")


def scan_comparisons(spark: SparkSession, root: str, projects: DataFrame) -> DataFrame:
    """Every project with its comparison record, NULL when there is none."""
    found = readable(scan_records(spark, root, "_comparison.json")).select(
        "facility_type", "competition_id", F.col("record").alias("comparison")
    )
    return projects.join(found, ["facility_type", "competition_id"], "left")


def list_briefs(spark: SparkSession, root: str) -> DataFrame:
    """Brief records newest first, with what has been derived from each."""
    briefs = readable(scan_records(spark, root, "*.json", recursive=False))
    names = listing(spark, root, "*").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("_file"))

    def beside(suffix: str, name: str) -> DataFrame:
        return names.filter(F.col("_file").endswith(suffix)).select(
            F.expr(f"substring(_file, 1, length(_file) - {len(suffix)})").alias("brief_id"),
            F.lit(True).alias(name),
        ).distinct()

    def value(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("record", path, kind)

    def present(path: str) -> Column:
        kind = F.schema_of_variant(value(path, "variant"))
        text = F.to_json(value(path, "variant"))
        return F.coalesce(
            value(path, "variant").isNotNull() & (kind != "VOID") & ~text.isin("{}", "[]", '""', "0", "false"),
            F.lit(False),
        )

    out = briefs.select(
        F.regexp_replace("file_name", r"\.json$", "").alias("brief_id"),
        F.coalesce(value("$._brief_meta.facility_type"), F.lit("")).alias("facility_type"),
        F.coalesce(value("$._brief_meta.brief_name"), F.lit("")).alias("brief_name"),
        F.coalesce(
            F.nullif(value("$._site_context.matched_address"), F.lit("")),
            value("$.feasibility_export.sites[0].address"), F.lit(""),
        ).alias("site_address"),
        F.coalesce(value("$._brief_meta.analyzed_at"), F.lit("")).alias("analyzed_at"),
        F.coalesce(value("$._brief_meta.source_format"), F.lit("pdf")).alias("source_format"),
        F.coalesce(value("$.total_pages", "int"), F.lit(0)).alias("total_pages"),
        present("$._insight").alias("has_insight"),
        present("$._site_context").alias("has_site_context"),
        F.coalesce(value("$._brief_genre.genre"), F.lit("unknown")).alias("brief_genre"),
        value("$.validation.summary", "map<string,int>").alias("validation_summary"),
    )
    for suffix, name in (
        (".md", "has_md"), (".xlsx", "has_xlsx"), (".html", "has_html"),
        ("_proposal.html", "has_proposal"), ("_playbook.html", "has_playbook"),
    ):
        out = out.join(beside(suffix, name), "brief_id", "left").withColumn(
            name, F.coalesce(name, F.lit(False))
        )
    return out.orderBy(F.desc("brief_id"))


def brief_summary(briefs: DataFrame, record: str = "record") -> DataFrame:
    """Fixed projection of a brief: ids, genre, measures, sites, severities, what exists."""

    def value(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(record, path, kind)

    def stated(path: str) -> Column:
        v = value(path, "variant")
        return F.when(~F.to_json(v).isin("[]", "{}", "null"), v)

    return briefs.select(
        F.regexp_replace("file_name", r"\.json$", "").alias("brief_id"),
        value("$._brief_meta.brief_name").alias("brief_name"),
        value("$._brief_meta.facility_type").alias("facility_type"),
        value("$._brief_meta.source_format").alias("source_format"),
        value("$._brief_genre.genre").alias("genre"),
        value("$._insight.scoring_focus", "variant").alias("scoring_focus"),
        value("$._quantitative", "variant").alias("quantitative"),
        value("$.feasibility_export", "variant").alias("feasibility_export"),
        value("$.validation.summary", "map<string,int>").alias("validation_summary"),
        F.struct(
            *[stated(f"$.{k}").isNotNull().alias(n) for k, n in (
                ("_insight", "insight"), ("_proposal", "proposal"),
                ("_playbook", "playbook"), ("_site_context", "site_context"),
            )]
        ).alias("has"),
        stated("$._contradictions").alias("contradictions"),
        stated("$._merge_conflicts").alias("merge_conflicts"),
    )


def prune_fields(records: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Keep only the named top-level keys of a VARIANT column, as columns of their own."""
    rest = [c for c in records.columns if c != column]
    return records.select(*rest, *[F.try_variant_get(column, f"$.{k}", "variant").alias(k) for k in keep])


def measured_digest(records: DataFrame, keys: list[str], column: str = "brief") -> DataFrame:
    """Drivers, evidence and key facts of a measured site context."""
    driver = "array<struct<rank:int,name:string,response:string,strength:string,evidence:array<struct<key:string,detail:string,proximity:string>>>>"
    fact = "array<struct<item:string,value:string,unit:string,national_avg:string,index:string,index_band:string,proximity:string,source:string,year:string>>"
    text = F.to_json(column)
    return records.select(
        *keys,
        F.try_variant_get(column, "$.region", "string").alias("region"),
        F.try_variant_get(column, "$.use_type", "string").alias("use_type"),
        F.try_variant_get(column, "$.radius", "double").alias("radius_m"),
        F.from_json(F.get_json_object(text, "$.design_drivers"), driver).alias("design_drivers"),
        F.from_json(F.get_json_object(text, "$.cross_implications"), "array<struct<name:string,text:string,domains:array<string>>>").alias("cross_implications"),
        F.from_json(F.get_json_object(text, "$.key_facts"), fact).alias("key_facts"),
        F.try_variant_get(column, "$.base_date", "string").alias("base_date"),
    )


def insight_digest(records: DataFrame, keys: list[str], column: str = "insight") -> DataFrame:
    """Summary, emphases and must-not-miss items of an earlier insight."""
    text = F.to_json(column)
    return records.select(
        *keys,
        F.coalesce(F.try_variant_get(column, "$.synthesis_summary", "string"), F.lit("")).alias("synthesis_summary"),
        F.from_json(F.get_json_object(text, "$.key_emphases"), "array<struct<topic:string,signal_strength:string>>").alias("key_emphases"),
        F.transform(
            F.from_json(F.get_json_object(text, "$.must_not_miss"), "array<struct<item:string>>"), lambda m: m["item"]
        ).alias("must_not_miss"),
    )


def report_names(files: DataFrame, path: str = "path") -> DataFrame:
    """Saved reports by name '{YYYYMMDD}_{HHMMSS}_{a}_vs_{b}', newest first.

    A name of another shape has no time and is its own label; ``has_data`` tells whether a
    JSON file of the same name exists.
    """
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    named = files.withColumn("filename", name).withColumn("_stem", stem)
    shaped = F.col("_stem").rlike(r"(?s)^[^_]{8}_[^_]{6}_")
    data = named.filter(F.col("filename").endswith(".json")).select("_stem", F.lit(True).alias("_d")).distinct()
    reports = named.filter(F.col("filename").endswith(".html")).join(data, "_stem", "left")
    return reports.select(
        "filename",
        F.when(shaped, T.stamp(F.substring("_stem", 1, 15))).otherwise(F.lit("")).alias("created_at"),
        F.when(shaped, F.split(F.regexp_replace("_stem", r"^[^_]{8}_[^_]{6}_", ""), "_vs_")).otherwise(F.array("_stem")).alias("labels"),
        F.coalesce("_d", F.lit(False)).alias("has_data"),
    ).orderBy(F.desc("filename"))


def salvage_json(raw: DataFrame, text: str = "text") -> DataFrame:
    """VARIANT from model text: fence stripped, direct parse, outermost {...} or [...], then
    the same without trailing commas. Rows that stay NULL belong to quarantine."""
    t = F.trim(text)
    fenced = F.when(
        t.contains("```json"), F.trim(F.regexp_extract(t, r"(?s)```json(.*?)(?:```|$)", 1))
    ).when(t.contains("```"), F.trim(F.regexp_extract(t, r"(?s)```(.*?)(?:```|$)", 1))).otherwise(t)
    body = raw.withColumn("_b", fenced)

    def attempts(opening: str, closing: str) -> list[Column]:
        block = F.nullif(F.regexp_extract("_b", rf"(?s)(\{opening}.*\{closing})", 1), F.lit(""))
        return [F.try_parse_json(block), F.try_parse_json(F.regexp_replace(block, r",(\s*[}\]])", "$1"))]

    tries = [F.try_parse_json("_b"), *attempts("{", "}"), *attempts("[", "]")]
    return body.withColumn("record", F.coalesce(*tries)).drop("_b")


def truth_records(spark: SparkSession, root: str, facility_type: str | None = None) -> DataFrame:
    """Ground-truth files, without the template."""
    truth = readable(scan_records(spark, root, "*_gt.json")).filter(
        ~F.col("file_name").startswith("TEMPLATE")
    )
    out = truth.withColumn(
        "facility_type", F.coalesce(F.try_variant_get("record", "$.meta.facility_type", "string"), F.col("facility_type"))
    )
    return out.filter(F.col("facility_type") == facility_type) if facility_type else out


def predicted_records(spark: SparkSession, root: str) -> DataFrame:
    """Cached predictions by ``record_key``: one file ``<competition>_<record>.json`` each in one folder.
    Unreadable files are left out, as ``quarantine`` shows them."""
    found = readable(scan_records(spark, root, "*.json", recursive=False))
    return found.select(F.regexp_replace("file_name", r"\.json$", "").alias("record_key"), F.col("record").alias("predicted"))


def with_predictions(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth records with the prediction made for them, NULL where there is none.

    The names are joined before they are compared, since both parts may hold underscores."""
    stem = F.regexp_replace("file_name", r"_gt\.json$", "")
    keyed = truth.withColumn("record_key", F.concat("competition_id", F.lit("_"), stem))
    return keyed.join(predicted, "record_key", "left")


def all_patterns(spark: SparkSession, root: str) -> DataFrame:
    """facility_type and pattern of every ``<facility>.json`` under ``_patterns``; unreadable ones are NULL.

    The folder is named itself, so Spark does not hide it."""
    found = scan_records(spark, f"{root}/_patterns", "*.json", recursive=False)
    return found.select(F.regexp_replace("file_name", r"\.json$", "").alias("facility_type"), F.col("record").alias("pattern"))
