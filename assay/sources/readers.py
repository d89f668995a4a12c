"""Sources: JSON lines, JSON, CSV, CIF folders, artifact trees.

Every reader returns a DataFrame with ``_ord``: (file, block, row) in reading
order, which later operators use wherever order carries meaning. File listings
are driver work; the rows are read by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import literals
from ..functions.columns import first_present, nullable, to_int
from ..functions.joins import dealt
from ..functions.literals import strict_json
from ..functions.numbering import numbered
from .files import read_text

#: Names of the artifacts of a run.
ARTIFACTS = ("bulk_plan.json", "bulk_summary.json", "audit_summary.json", "candidates.jsonl", "audit_candidates.jsonl", "failure_vectors.jsonl", "preference_pairs.jsonl", "preference_summary.json")
#: Fields of a generated sequence.
SEQUENCE = ("g", "W", "A", "X", "L")
#: Keys that may wrap the rows of a JSON file.
WRAPPERS = ("validation_results", "results", "rows", "items")


def lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """(value, file, _ord) of every line that is not blank."""
    text = spark.read.options(**options).text(paths)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return text.select("value", F.col("_metadata.file_path").alias("file"), order.alias("_ord")).where("trim(value) != ''")


def jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Typed rows of JSON lines with _ord, file and the whole row as _raw (VARIANT).

    Strict: a line that is not a JSON object raises with its file and text.
    Otherwise such lines are left out; ``bad_lines`` returns them.
    """
    rows = lines(spark, paths).withColumn("_raw", strict_json("value"))
    good = F.coalesce(F.startswith(F.trim("value"), F.lit("{")) & F.col("_raw").isNotNull(), F.lit(False))
    if strict:
        fail = F.raise_error(F.concat("file", F.lit(": not a JSON object: "), F.substring("value", 1, 200))).cast("boolean")
        rows = rows.where(F.when(good, True).otherwise(fail))
    else:
        rows = rows.where(good)
    return rows.withColumn("_row", F.from_json("value", schema)).select("_ord", "file", "_raw", "_row.*")


def bad_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, _ord, issue, value) of the lines ``jsonl`` cannot take."""
    rows = lines(spark, paths)
    good = F.startswith(F.trim("value"), F.lit("{")) & strict_json("value").isNotNull()
    return rows.where(~F.coalesce(good, F.lit(False))).select("file", "_ord", F.lit("malformed_jsonl").alias("issue"), "value")


def whole_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, _raw, issue) of whole JSON files: empty_artifact, corrupt_json or null."""
    text = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    raw = strict_json("value")
    issue = F.when(F.trim("value") == "", "empty_artifact").when(raw.isNull(), "corrupt_json")
    return text.select("file", raw.alias("_raw"), issue.alias("issue"))


def json_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, _ord, _raw): the rows of JSON files that hold a list, a wrapped list or one object."""
    docs = whole_json(spark, paths).where("issue is null")
    wrapped = [F.try_variant_get("_raw", f"$.{k}", "array<variant>") for k in WRAPPERS]
    items = F.coalesce(F.try_variant_get("_raw", "$", "array<variant>"), *wrapped, F.array("_raw"))
    return docs.select("file", F.posexplode(items).alias("_ord", "_raw"))


def get(path: str, kind: str = "string") -> Column:
    """A field of the raw row, null where it is absent or of another type."""
    return F.try_variant_get("_raw", "$." + path, kind)


def csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All columns as text, with file and _ord; all files share the first one's header.

    Names are lower-cased but for the sequence fields, which become seq_g, seq_W,
    seq_A, seq_X and seq_L: ``A`` and ``a`` may both occur.
    """
    import csv as text_csv

    first = spark.read.text(paths).first()
    header = next(text_csv.reader([first.value])) if first else []
    names = ["seq_" + c if c in SEQUENCE else c.lower() for c in (h.strip() for h in header)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(paths, header=True, schema=schema, enforceSchema=True, multiLine=True, escape='"')
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    return rows.select(*(F.col(f"`{n}`") for n in names), F.col("_metadata.file_path").alias("file"), order.alias("_ord"))


def alias(df: DataFrame, *names: str) -> Column:
    """First non-empty value over the aliases that exist."""
    found = [F.col(f"`{n}`") for n in names if n in df.columns]
    return nullable(first_present(*found)) if found else F.lit(None).cast("string")


def numbers(text: Column) -> Column:
    """All numbers of a text, as an array of double."""
    found = F.regexp_extract_all(text, F.lit(r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def triples(values: Column) -> Column:
    """A flat array as an array of triples."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / 3).cast("int") - 1), lambda i: F.slice(values, i * 3 + 1, 3))


def lattice(values: Column) -> Column:
    """3x3 lattice from nine numbers, or from edges and angles (six), or three edges."""
    v = lambda i: F.element_at(values, i)
    cos = lambda i: F.cos(F.radians(v(i)))
    sin_g = F.sin(F.radians(v(6)))
    cx = v(3) * cos(5)
    cy = v(3) * (cos(4) - cos(5) * cos(6)) / sin_g
    cz = F.sqrt(F.greatest(v(3) * v(3) - cx * cx - cy * cy, F.lit(0.0)))
    zero = F.lit(0.0)
    six = F.array(F.array(v(1), zero, zero), F.array(v(2) * cos(6), v(2) * sin_g, zero), F.array(cx, cy, cz))
    three = F.array(F.array(v(1), zero, zero), F.array(zero, v(2), zero), F.array(zero, zero, v(3)))
    size = F.size(values)
    return F.when(size == 9, triples(values)).when(size == 6, six).when(size == 3, three)


def lattice_lengths(matrix: Column) -> Column:
    return F.transform(matrix, lambda r: F.sqrt(r[0] * r[0] + r[1] * r[1] + r[2] * r[2]))


def lattice_angles(matrix: Column) -> Column:
    def angle(i: int, j: int) -> Column:
        a, b = matrix[i], matrix[j]
        dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
        norm = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2]) * F.sqrt(b[0] * b[0] + b[1] * b[1] + b[2] * b[2])
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm))))

    return F.array(angle(1, 2), angle(0, 2), angle(0, 1))


def formula_of(species: Column | str) -> Column:
    """Formula of a species array: first-seen order, counts above one."""
    s = F.col(species) if isinstance(species, str) else species
    part = lambda e: F.concat(e, F.when(F.size(F.filter(s, lambda x: x == e)) > 1, F.size(F.filter(s, lambda x: x == e)).cast("string")).otherwise(""))
    return F.array_join(F.transform(F.array_distinct(s), part), "")


def clean_id(text: Column | str) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")


#: Score-like columns that are kept as metadata.
SCORES = ("score", "logprob", "log_probability", "temperature", "sample_temperature", "sampling_temperature", "rank")


def sampling_csv(spark: SparkSession, paths: str | list[str], source_format: str = "sampling_csv") -> DataFrame:
    """Generated samples: sequence fields g, W, A, X, L, lattice and condition columns.

    The lattice is a matrix or lengths in one field, else three lengths, else
    edges and angles. ``species_text``, ``coords_text`` and ``wyckoff_text`` are
    the fields as written; ``adapters.csv_structures`` reads them.
    """
    rows = dealt(csv(spark, paths))  # a file is one task, which is to split lines only: literals take most of the time
    a = lambda *names: alias(rows, *names)
    given = F.array_compact(F.array(*(a(c).try_cast("double") for c in ("a", "b", "c", "alpha", "beta", "gamma"))))
    rows = rows.withColumns({"_stated": literals.literal(a("lattice_matrix", "lattice", "seq_L")), "_lengths": literals.literal(a("lattice_lengths", "lengths"))})
    rows = rows.withColumns({"_stated": literals.matrix_numbers(F.col("_stated")), "_lengths": literals.matrix_numbers(F.col("_lengths")), "_given": given})
    stated, lengths, given = F.col("_stated"), F.col("_lengths"), F.col("_given")
    rows = rows.withColumn("_values", F.coalesce(F.when(F.size(stated) != 6, stated), F.when(F.size(lengths) == 3, lengths), F.when(F.size(given) == 6, given), stated))
    rows = rows.withColumn("_matrix", lattice(F.col("_values")))
    number = F.col("_ord.row")
    scores = [x for c in SCORES for x in (F.lit(c), a(c))]
    return rows.select(
        "_ord", "file",
        F.coalesce(a("candidate_id", "sample_id", "id", "name"), F.format_string("row_%06d", number)).alias("candidate_id"),
        a("composition", "formula", "target_formula").alias("composition"), to_int(a("space_group", "spacegroup", "sg", "seq_g")).alias("space_group"),
        F.struct(*(a("seq_" + c).alias(c) for c in SEQUENCE)).alias("raw_sequence_fields"),
        F.col("_matrix").alias("lattice_matrix"), a("structure_ref", "cif_path").alias("structure_ref"), a("cif", "cif_text").alias("cif_text"),
        a("species", "atom_types", "elements", "seq_A").alias("species_text"), a("frac_coords", "fractional_coords", "coords", "seq_X").alias("coords_text"), a("wyckoff_letters", "wyckoff", "seq_W").alias("wyckoff_text"),
        to_int(a("num_sites", "num_atoms", "natoms")).alias("num_sites"), a("prototype").alias("prototype"),
        a("formula_condition").alias("formula_condition"), to_int(a("spacegroup_condition")).alias("spacegroup_condition"), F.coalesce(a("mode"), F.lit("csp")).alias("mode"),
        a("source_checkpoint").alias("source_checkpoint"), a("temperature").try_cast("double").alias("temperature"), to_int(a("top_k")).alias("top_k"), a("k").alias("K"),
        F.map_filter(F.create_map(*scores), lambda k, v: v.isNotNull()).alias("scores"), F.lit(source_format).alias("source_format"),
    )


def cif_folder(spark: SparkSession, folder: str) -> DataFrame:
    """One unparsed stub for each ``*.cif`` file; the id is the file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cif").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.cif$", 1)
    text = F.col("content").cast("string")
    return files.select(
        F.col("path").alias("_ord"), clean_id(name).alias("candidate_id"), F.col("path").alias("structure_ref"), text.alias("cif_text"),
        F.regexp_extract(text, r"(?m)^data_(\S+)", 1).alias("data_name"), F.lit("unparsed_cif").alias("parse_status"), F.lit("cif_directory").alias("source_format"),
    )


def list_files(spark: SparkSession, roots: list[str], names: tuple[str, ...] = ARTIFACTS) -> DataFrame:
    """(path, directory, name, length) of the known artifacts below the roots."""
    hits = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(names) + "}").load(roots)
    return hits.select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


def formula_from_path(path: Column | str, marker: str = "formulas") -> Column:
    """The path segment after ``marker``."""
    parts = F.split(path, "/")
    at = F.array_position(parts, F.lit(marker))
    return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def reference_rows(spark: SparkSession, paths: str | list[str], formulas: list[str]) -> tuple[DataFrame, DataFrame]:
    """Reference rows of the wanted formulas, and (seen, selected, failed) counts."""
    rows = lines(spark, paths).withColumn("_raw", F.try_parse_json("value"))
    formula = F.try_variant_get("_raw", "$.formula", "string")
    wanted = F.coalesce(formula.isin(formulas), F.lit(False))
    counts = rows.agg(F.count("*").alias("seen"), F.count_if(wanted).alias("selected"), F.count_if(F.col("_raw").isNull()).alias("failed"))
    return rows.where(wanted).select("_ord", formula.alias("formula"), "_raw"), counts


def prepare_references(rows: DataFrame, prefix: str = "ref") -> DataFrame:
    """CSV rows as references: CIF text, else CIF path, else structure text; generated ids."""
    rows = numbered(rows, "_ord", name="_number", start=0)
    a = lambda *names: alias(rows, *names)
    number = F.col("_number")
    kind = F.when(a("cif", "cif_text").isNotNull(), "cif_text").when(a("cif_path", "structure_ref").isNotNull(), "cif_path").when(a("structure").isNotNull(), "structure")
    return rows.select(
        "_ord", F.coalesce(a("reference_id", "id", "material_id"), F.format_string(prefix + "_%06d", number)).alias("reference_id"),
        a("formula", "composition").alias("formula"), kind.alias("kind"), F.coalesce(a("cif", "cif_text"), a("cif_path", "structure_ref"), a("structure")).alias("structure"),
    )


def formula_bank(spark: SparkSession, path: str) -> list[str]:
    """Formulas of a small JSON file: a list or {"formulas": [...]}."""
    import json

    data = json.loads(read_text(spark, path))
    formulas = data["formulas"] if isinstance(data, dict) else data
    if not formulas:
        raise ValueError(f"{path}: no formulas")
    if len(set(formulas)) != len(formulas):
        raise ValueError(f"{path}: duplicate formulas")
    return list(formulas)


def read_config(spark: SparkSession, path: str, *overrides: dict) -> dict:
    """A JSON configuration, on whatever file system, with nested overrides."""
    import json

    held = json.loads(read_text(spark, path))
    if not isinstance(held, dict):
        raise ValueError(f"{path}: a configuration must be a JSON object")
    return merged_config(held, *overrides)


def merged_config(defaults: dict, *overrides: dict) -> dict:
    """Nested dicts merged from left to right."""
    out = dict(defaults)
    for extra in overrides:
        for key, value in extra.items():
            out[key] = merged_config(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out
