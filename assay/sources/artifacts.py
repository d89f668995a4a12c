"""Artifact trees: all files of all kinds below some roots, with what is wrong with them.

Lines know their number: a line's place in its block (a file split) and the
lines of the blocks before it. A tree's lines are read once for what is wrong
with them, which leaves one row for each stretch of lines and is written to the
checkpoint folder, and once more where its rows are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.joins import join_keyed
from ..functions.literals import strict_json
from ..functions.session import checkpointed

#: Names of the artifacts of a run, by the way they are read, and which of them belong together.
JSON_FILES = ("bulk_plan.json", "bulk_summary.json", "bulk_validation_summary.json", "audit_summary.json", "preference_summary.json")
LINE_FILES = ("candidates.jsonl", "audit_candidates.jsonl", "failure_vectors.jsonl", "preference_pairs.jsonl")
TEXT_FILES = ("report.md", "validate_report.md")
AUDIT_SET = ("audit_candidates.jsonl", "audit_summary.json", "candidates.jsonl", "failure_vectors.jsonl", "report.md")
PREFERENCE_SET = ("preference_pairs.jsonl", "preference_summary.json", "report.md")
BULK_SET, BULK_SUMMARIES = ("bulk_plan.json", "bulk_summary.json", "bulk_validation_summary.json"), ("bulk_summary.json", "bulk_validation_summary.json")
#: Folders whose name is no formula; folders below which the next name is one.
NO_FORMULA, MARKERS = ("", ".", "outputs", "smoke", "formula_runs"), ("dpo_preferences",)
#: Blocks of files, stretches of lines and artifacts with an error that are broadcast at most.
BROADCAST_BLOCKS = 200_000
#: Bits of the place within a stretch of lines, whose broken ones are listed in one row.
STRETCH_BITS = 16


def numbered_lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """(value, file, block, at) of every line; ``with_line_numbers`` turns block and at into a number.

    A block lies in one task, whose lines count up in ``at``.
    """
    text = spark.read.options(**options).text(paths)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def with_line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Add line_no (from 1) to ``rows``, which are some of ``lines``; only the blocks are counted over."""
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", (before - F.col("_first") + 1).alias("_shift"))
    placed = with_few(rows, blocks, ["file", "block"])
    return placed.withColumn("line_no", F.col("at") + F.col("_shift")).drop("_shift")


def parsed_lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """(file, block, at, blank, opens, row) of every line; ``row`` (VARIANT) is null where the line is no JSON, or no line of an artifact.

    A row is an object if it is there and ``opens`` with a brace. A filter on
    ``row`` may parse the line once more: none is laid on the lines themselves.
    """
    text = spark.read.options(**options).text(paths)
    file = F.col("_metadata.file_path")
    wanted = F.contains(file, F.lit(LINE_FILES[0]))
    for name in LINE_FILES[1:]:
        wanted = wanted | F.contains(file, F.lit(name))
    opens = F.startswith(F.ltrim("value", F.lit(" \t\r\n")), F.lit("{"))
    return text.select(
        file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        (F.trim("value") == "").alias("blank"), opens.alias("opens"), strict_json(F.when(wanted, F.col("value"))).alias("row"),
    )


def line_stretches(lines: DataFrame) -> DataFrame:
    """(file, block, _stretch, _first, _n, _broken) of ``parsed_lines``: how many lines a stretch has, and its broken ones."""
    broken = F.when(~F.col("blank") & ~(F.col("opens") & F.col("row").isNotNull()), F.struct("at", F.col("row").isNotNull().alias("json")))
    return lines.groupBy("file", "block", F.shiftright("at", STRETCH_BITS).alias("_stretch")).agg(F.min("at").alias("_first"), F.count("*").alias("_n"), F.collect_list(broken).alias("_broken"))


def line_errors(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, message, line_no) of the broken lines of ``line_stretches`` with ``keys``, of which the artifact's path is the first.

    Lines are counted from 1 over all files of an artifact in order of their names, blank ones too.
    """
    at = ["file", "block", "_stretch"]
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(keys[0]).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = stretches.select(keys[0], *at, "_n", "_first").select(*at, (before - F.col("_first") + 1).alias("_shift"))
    placed = with_few(stretches.where(F.size("_broken") > 0), shifts, at).select(*keys, "_shift", F.explode("_broken").alias("_line"))
    message = F.when(F.col("_line.json"), "JSONL row must be an object").otherwise("invalid JSON")
    return placed.select(*keys, message.alias("message"), (F.col("_line.at") + F.col("_shift")).alias("line_no"))


def with_few(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row for each value of ``keys``), broadcast if it has been counted to be small."""
    few = right.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    return left.join(F.broadcast(right), keys, how) if few else join_keyed(left, right, keys, how)


def plain_path(uri: Column) -> Column:
    """A file's path from its URI: decoded, without scheme."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(uri, r"\+", "%2B")), r"^[A-Za-z0-9]+:/+", "/")


def formula_of_path(path: Column, is_file: bool = True, markers: tuple[str, ...] = MARKERS) -> Column:
    """The folder after a marker, else the folder a file lies in (or the folder itself), if its name can be a formula."""
    parts = F.split(path, "/")
    found = [F.when(F.array_position(parts, F.lit(m)) > 0, F.try_element_at(parts, (F.array_position(parts, F.lit(m)) + 1).cast("int"))) for m in markers]
    own = F.try_element_at(parts, F.lit(-2 if is_file else -1))
    known = F.try_element_at(parts, F.lit(-1)).isin(*JSON_FILES, *LINE_FILES) if is_file else F.lit(True)
    return F.coalesce(*found, F.when(known & ~own.isin(*NO_FORMULA), own))


def artifact_path(path: Column, names: tuple[str, ...]) -> Column:
    """The artifact a file belongs to: the file itself, or the folder of that name which Spark has written it into; else null."""
    found = F.regexp_extract(path, r"^(.*/(?:" + "|".join(n.replace(".", r"\.") for n in names) + r"))(?:/part-[^/]*)?$", 1)
    return F.when(found != "", found)


def artifact_tree(spark: SparkSession, roots: list[str], markers: tuple[str, ...] = MARKERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, errors, files) of all artifacts below ``roots``.

    An artifact is a file of a known name, or a folder of that name with the
    parts that Spark writes. ``rows``: root, path, artifact, path_formula, form
    (lines, json, text), ok, _ord and row (VARIANT), one for each JSON line, JSON
    file and text file; ``ok`` is false for all rows of an artifact with an error. ``errors``:
    empty_artifact, corrupt_json, malformed_jsonl with line_no (over all parts of
    an artifact), and missing_artifact for what a folder with related artifacts lacks. Nothing
    raises.
    """
    rows, errors, files, lines = [], [], [], {}
    keys = ["path", "root", "artifact", "path_formula"]
    glob = lambda names: {"recursiveFileLookup": "true", "pathGlobFilter": "{" + ",".join(names) + "}"}
    nowhere = F.lit(None).cast("long")

    def of(df: DataFrame, root: str, names: tuple[str, ...]) -> DataFrame:
        df = df.withColumns({"root": F.lit(root), "path": artifact_path(plain_path(F.col("file")), names)}).where("path is not null")
        return df.withColumns({"artifact": F.regexp_extract("path", r"([^/]+)$", 1), "path_formula": formula_of_path(F.col("path"), True, markers)})

    for root in sorted(set(roots)):
        # The listing alone: contents are not read. A scan leaves empty files out, the list of names does not.
        found = spark.read.format("binaryFile").options(**glob((*JSON_FILES, *LINE_FILES, *TEXT_FILES, "part-*"))).load(root)
        names = spark.createDataFrame([(f, 0) for f in found.inputFiles()], "file string, length long")
        listed = found.select(F.col("path").alias("file"), "length").unionByName(names)
        listed = of(listed, root, JSON_FILES + LINE_FILES + TEXT_FILES).groupBy("root", "path", "artifact", "path_formula").agg(F.sum("length").alias("length"))
        plain = F.rtrim(plain_path(F.lit(root)), F.lit("/"))
        files.append(listed.withColumn("directory", F.regexp_replace("path", r"/[^/]+$", "")).withColumn("at_root", F.col("directory") == plain))
        lines[root] = parsed_lines(spark, root, **glob((*LINE_FILES, "part-*")))
        whole = spark.read.options(**glob(JSON_FILES)).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        whole = of(whole, root, JSON_FILES).withColumn("row", strict_json("value"))
        one = lambda c: F.struct(F.col(c).alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("at")).alias("_ord")
        rows.append(whole.where("row is not null").select("root", "path", "artifact", "path_formula", F.lit("json").alias("form"), one("file"), "row"))
        errors.append(whole.where("row is null and value != ''").select("root", "path", "artifact", F.lit("corrupt_json").alias("issue"), F.lit("invalid JSON").alias("message"), F.col("path_formula").alias("formula"), nowhere.alias("line_no")))
        rows.append(listed.where(F.col("artifact").isin(*TEXT_FILES)).select("root", "path", "artifact", "path_formula", F.lit("text").alias("form"), one("path"), F.lit(None).cast("variant").alias("row")))
    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[: len(parts) // 2]).unionByName(union(parts[len(parts) // 2 :]))
    files = union(files)
    empty = files.where("length = 0").select("root", "path", "artifact", F.lit("empty_artifact").alias("issue"), F.lit("artifact file is empty").alias("message"), F.col("path_formula").alias("formula"), nowhere.alias("line_no"))
    stretches = checkpointed(union([line_stretches(x).withColumn("_root", F.lit(root)) for root, x in lines.items()]))
    # What a file's path says is taken out of it once for each file, not for each line, and written, lest Spark infer a filter of lines from it.
    known = checkpointed(union([of(stretches.where(F.col("_root") == root).select("file").distinct(), root, LINE_FILES) for root in lines]))
    for root, some in lines.items():
        placed = with_few(some.where("opens"), known.where(F.col("root") == root), ["file"])
        rows.append(placed.select("root", "path", "artifact", "path_formula", F.lit("lines").alias("form"), F.struct("file", "block", "at").alias("_ord"), "row"))
    stretches = union([of(stretches.where(F.col("_root") == root), root, LINE_FILES) for root in lines])
    bad = line_errors(stretches, keys).select("root", "path", "artifact", F.lit("malformed_jsonl").alias("issue"), "message", F.col("path_formula").alias("formula"), "line_no")
    broken = checkpointed(bad.unionByName(union(errors)).unionByName(empty))
    # Artifacts with an error: one row each, however many errors.
    bad_files = broken.select("path").distinct().withColumn("_bad", F.lit(True))
    rows = with_few(union(rows), bad_files, ["path"], "left").withColumn("ok", F.col("_bad").isNull()).drop("_bad")
    # Where no line is broken, all that open with a brace are objects.
    rows = rows.where("ok or row is not null or form = 'text'")
    return rows, broken.unionByName(missing_artifacts(files, markers)), files


def missing_artifacts(files: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """What folders with some artifacts of an audit, of preferences or of a bulk run lack of the others."""
    folders = files.groupBy("root", "directory", "at_root").agg(F.collect_set("artifact").alias("present"))  # at most eleven names
    names = lambda xs: F.array(*map(F.lit, xs))
    has = lambda xs: F.arrays_overlap("present", names(xs))
    none = F.array().cast("array<string>")
    lacks = lambda wanted: F.when(has([w for w in wanted if w != "report.md"]), F.array_except(names(wanted), "present")).otherwise(none)
    bulk = F.when(
        F.col("at_root") & has(BULK_SET),
        F.array_compact(F.array(F.when(~F.array_contains("present", BULK_SET[0]), BULK_SET[0]), F.when(~has(BULK_SUMMARIES), BULK_SUMMARIES[0]))),
    ).otherwise(none)
    gaps = F.concat(F.transform(bulk, lambda x: F.struct(x.alias("artifact"), F.lit(True).alias("bulk"))), F.transform(F.concat(lacks(AUDIT_SET), lacks(PREFERENCE_SET)), lambda x: F.struct(x.alias("artifact"), F.lit(False).alias("bulk"))))
    rows = folders.select("root", "directory", F.explode(gaps).alias("gap"))
    return rows.select(
        "root", F.concat_ws("/", "directory", "gap.artifact").alias("path"), "gap.artifact", F.lit("missing_artifact").alias("issue"), F.lit("expected artifact is missing").alias("message"),
        F.when(~F.col("gap.bulk"), formula_of_path(F.col("directory"), False, markers)).alias("formula"), F.lit(None).cast("long").alias("line_no"),
    )


def format_of(path: str, given: str = "auto") -> str:
    """csv, json or jsonl: as given, else by the file's ending, else jsonl."""
    ending = path.rsplit(".", 1)[-1].lower()
    return given if given != "auto" else ending if ending in ("csv", "json", "jsonl") else "jsonl"


def validation_input(spark: SparkSession, path: str, given: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of a CSV, JSON or JSONL file: text fields in ``fields`` (map), or what is wrong and where.

    Rows: _ord, fields. Issues: file, line_no, reason (malformed_row), value. A
    CSV line with more or fewer fields than the header, a JSON line that is no
    object and a JSON file that cannot be read are issues, not failures.
    """
    from .readers import json_rows, whole_json

    kind = format_of(path, given)
    issue = lambda df, line: df.select("file", line.alias("line_no"), F.lit("malformed_row").alias("reason"), F.col("value"))
    nowhere = F.lit(None).cast("long")
    if kind == "json":
        rows = json_rows(spark, path).select(F.struct("file", F.col("_ord").cast("long").alias("at")).alias("_ord"), F.try_variant_get("_raw", "$", "map<string,string>").alias("fields"))
        broken = whole_json(spark, path).where("issue is not null").select("file", F.col("issue").alias("value"))
        return rows.where("fields is not null"), issue(broken, nowhere)
    lines = numbered_lines(spark, path)
    some = lines.where("trim(value) != ''")
    if kind == "jsonl":
        read = some.withColumn("fields", F.try_variant_get(strict_json("value"), "$", "map<string,string>"))
        return read.where("fields is not null").select(F.struct("file", "at").alias("_ord"), "fields"), issue(with_line_numbers(read.where("fields is null"), lines), F.col("line_no"))
    # A quoted field may hold line breaks, so the CSV reader cuts the rows itself; a row it cannot fit keeps its text.
    first = some.orderBy("file", "block", "at").first()
    import csv

    header = [h.strip() for h in next(csv.reader([first.value]))] if first else []
    schema = ", ".join([*(f"c{i} string" for i in range(max(1, len(header)))), "_broken string"])
    read = spark.read.schema(schema).options(header="true", multiLine="true", escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", enforceSchema="true").csv(path)
    # The filter holds for every row: a scan may not be asked for the broken text alone.
    read = read.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where("length(coalesce(c0, '')) >= 0")
    fields = F.map_from_arrays(F.array(*map(F.lit, header)), F.array(*(F.col(f"c{i}") for i in range(len(header))))) if header else F.create_map().cast("map<string,string>")
    good = read.where("_broken is null").select(F.struct("file", "at").alias("_ord"), fields.alias("fields"))
    return good, issue(read.where("_broken is not null").withColumn("value", F.col("_broken")), nowhere)
