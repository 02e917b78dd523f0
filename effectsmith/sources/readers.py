"""Readers of the study's files, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HITS_CSV = {"End X [m]": "x_m", "End Y [m]": "y_m", "End Z [m]": "z_m", "Final Time [ns]": "t_ns", "Energy Deposited [eV]": "energy_ev"}
MANIFEST_SCHEMA = (
    "sample_name string, hits_file string, gap double, qx array<double>, qy array<double>, chip_z double, height double, width double,"
    " thickness double, n_sim double, f_01 double, r double, s double, i_ph double, pt double, n_cooper double"
)


def zero_byte_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of files without any byte under a path or pattern: readers pass over them, so they are listed by the file
    system, on the driver like every listing. Hidden files (``_``, ``.``) are none."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = []
    for status in fs.globStatus(root) or []:
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            file = files.next()
            if file.getLen() == 0 and file.getPath().getName()[0] not in "_.":
                found.append((file.getPath().toString(),))
    return spark.createDataFrame(found, "file string")


PACKED_SCHEMA = "file string, line_no long, length long, text string"


def packed(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, length, text) as ``writers.write_packed`` wrote them."""
    return spark.read.schema(PACKED_SCHEMA).parquet(path)


def packed_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``text_lines`` of packed files."""
    doc = F.regexp_extract("file", pattern, 1) if pattern else F.col("file")
    return packed(spark, path).filter("text is not null").select(doc.alias("doc"), F.col("line_no").cast("int").alias("line_no"), "text")


def packed_listing(spark: SparkSession, path: str, pattern: str = r"([^/]+?)_hitsfile") -> DataFrame:
    """``file_listing`` of packed files: names and lengths alone are read."""
    files = packed(spark, path).groupBy(F.col("file").alias("path")).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
    return files.withColumn("sample_name", F.regexp_extract("path", pattern, 1))


def packed_hits_checked(spark: SparkSession, path: str, pattern: str = r"([^/]+?)_hitsfile") -> tuple[DataFrame, DataFrame]:
    """``hits_csv_checked`` of packed files; a file whose only row has no text is an empty one."""
    rows = packed(spark, path)
    lines = rows.select("file", F.regexp_replace("text", r"\r$", "").alias("text")).filter(F.trim("text") != "")
    return checked_hits(lines, rows.filter("text is null or trim(text) = ''").select("file").distinct(), pattern)


def hits_csv_checked(spark: SparkSession, path: str, pattern: str = r"([^/]+?)_hitsfile") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of many CSV files of hits. Each file's own header says where the five columns are; other
    columns may stand between them.

    rows: (sample_name, x_m, ...); an empty field is null. rejects: (sample_name, reason, text): ``short row`` and
    ``not a number`` with the line, ``no header`` and ``no rows`` (a header alone) once a file, ``empty file`` for
    files without any text, zero bytes included. A file without header has all its lines rejected under that one row.
    """
    options = {"recursiveFileLookup": "true"}
    lines = spark.read.options(**options).text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r$", "").alias("text")).filter(F.trim("text") != "")
    listed = spark.read.options(**options).format("binaryFile").load(path).select(F.col("path").alias("file")).unionByName(zero_byte_files(spark, path))
    return checked_hits(lines, listed, pattern)


def checked_hits(lines: DataFrame, listed: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """rows and rejects of ``lines`` (file, text), none of them blank; ``listed``: (file) of all files that may have none."""
    sample = lambda c: F.regexp_extract(c, pattern, 1)
    names = F.transform(F.split("text", ","), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    # only lines with all the names in them are taken apart for it
    is_header = F.lit(True)
    for c in HITS_CSV:
        is_header = is_header & F.col("text").contains(c)
    is_header = F.when(is_header, F.forall(F.array(*[F.lit(c) for c in HITS_CSV]), lambda c: F.array_contains(names, c))).otherwise(F.lit(False))
    # counts need no sort, and headers are few: a greatest array over all lines would sort them
    heads = lines.filter(is_header).select("file", names.alias("header")).groupBy("file").agg(F.max("header").alias("header"))
    files = lines.groupBy("file").agg(F.count("*").alias("n")).join(heads, "file", "left")
    empty = listed.select(sample("file").alias("sample_name")).join(files.select(sample("file").alias("sample_name")), "sample_name", "left_anti")
    whole = [
        empty.select("sample_name", F.lit("empty file").alias("reason")),
        files.filter("header is null").select(sample("file").alias("sample_name"), F.lit("no header").alias("reason")),
        files.filter("header is not null and n = 1").select(sample("file").alias("sample_name"), F.lit("no rows").alias("reason")),
    ]
    places = [(F.array_position("header", F.lit(a)) - 1).cast("int").alias(f"{b}_at") for a, b in HITS_CSV.items()]
    places = heads.select("file", F.size("header").alias("n_columns"), *places)  # found once a file
    data = lines.filter(~is_header).join(places, "file").withColumn("parts", F.split("text", ","))
    data = data.withColumns({f"{b}_field": F.trim(F.get("parts", F.col(f"{b}_at"))) for b in HITS_CSV.values()})
    typed = data.select(
        sample("file").alias("sample_name"), "text", (F.size("parts") != F.col("n_columns")).alias("short"),
        *[F.when(F.col(f"{b}_field") != "", F.col(f"{b}_field")).alias(f"{b}_text") for b in HITS_CSV.values()],
    )
    typed = typed.withColumns({b: F.col(f"{b}_text").try_cast("double") for b in HITS_CSV.values()})
    wrong = F.lit(False)
    for b in HITS_CSV.values():
        wrong = wrong | (F.col(f"{b}_text").isNotNull() & F.col(b).isNull())
    reason = F.when(F.col("short"), "short row").when(wrong, "not a number")
    judged = typed.select("sample_name", "text", reason.alias("reason"), *HITS_CSV.values())
    rejects = judged.filter("reason is not null").select("sample_name", "reason", "text")
    for rows in whole:
        rejects = rejects.unionByName(rows.withColumn("text", F.lit(None).cast("string")))
    return judged.filter("reason is null").select("sample_name", *HITS_CSV.values()), rejects


def hits_schema(header: list[str] | None = None) -> str:
    """Schema of hits files with this header; the five columns that count are numbers, others are text."""
    return ", ".join(f"`{c}` {'double' if c in HITS_CSV else 'string'}" for c in header or HITS_CSV)


def hits_table(spark: SparkSession, path: str) -> DataFrame:
    """``hits_csv`` of files of many samples, whose first column is the sample's name."""
    rows = spark.read.schema(hits_schema(["sample_name", *HITS_CSV])).option("header", True).option("enforceSchema", False).csv(path)
    return rows.select("sample_name", *[F.col(f"`{a}`").alias(b) for a, b in HITS_CSV.items()])


def hits_csv(spark: SparkSession, path: str, pattern: str = r"([^/]+?)_hitsfile") -> DataFrame:
    """Hits of many CSV files that have the five columns; the sample's name is in the file's path. Files with other
    columns, and broken ones, are for ``hits_csv_checked``.
    """
    rows = spark.read.schema(hits_schema()).option("header", True).option("enforceSchema", False).csv(path)
    named = rows.select(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("sample_name"), *[F.col(f"`{a}`").alias(b) for a, b in HITS_CSV.items()])
    return named


def manifest_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Manifest records, one JSON object a line; blank lines are no records."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def text_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(doc, line_no, text) of text files read whole; a line end at the end of a file starts no line. ``doc`` is the
    file's path, or what the first group of ``pattern`` finds in it."""
    file = F.col("_metadata.file_path")
    doc = F.regexp_extract(file, pattern, 1) if pattern else file
    whole = spark.read.text(path, wholetext=True).select(doc.alias("doc"), F.regexp_replace("value", r"\n\z", "").alias("value"))
    return split_lines(whole, "doc", "value")


def split_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no, text) of a table of documents; a null text has no lines."""
    each = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("p", "text"))
    return each.select("doc", (F.col("p") + 1).alias("line_no"), "text")


def design_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide design back to long: (sample_id, name, value)."""
    wide = spark.read.option("header", True).csv(path)
    typed = wide.select(F.col("sample_id").cast("long"), *[F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns if c != "sample_id"])
    return typed.unpivot("sample_id", [c for c in typed.columns if c != "sample_id"], "name", "value")


def log_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, text) of every line of many text files; ``file`` is the file's name, or what the first group of
    ``pattern`` finds in its path."""
    file = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1) if pattern else F.col("_metadata.file_name")
    return spark.read.text(path).select(file.alias("file"), F.col("value").alias("text"))


def summary_csv(spark: SparkSession, path: str, electrodes: int) -> DataFrame:
    """The study's summary with its electrode columns; names in lower case but for those."""
    each = ", ".join(f"electrode_{i}_QPs double" for i in range(electrodes))
    schema = f"sample_name string, top_gap_eV double, num_surface_hits long, {each}, total_QPs double, peak_DG_MHz double, total_integrated_DG double"
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return rows.withColumnsRenamed({c: c.lower() for c in rows.columns if not c.startswith("electrode_")})


def file_listing(spark: SparkSession, path: str, pattern: str = r"([^/]+?)_hitsfile") -> DataFrame:
    """(path, length, sample_name) of files; their content is not read."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length")
    return rows.withColumn("sample_name", F.regexp_extract("path", pattern, 1))


def latest_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of every sample's last run (``writers.write_run``), with ``run`` and the file that they stand in. Only the
    numbers of samples that several runs computed are joined in, so whole records are not shuffled."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("file_at"))
    last = rows.groupBy("sample_id").agg(F.max("run").alias("last"), F.min("run").alias("first")).filter("first < last").select("sample_id", "last")
    return rows.join(F.broadcast(last), "sample_id", "left").filter("last is null or run = last").drop("last")
