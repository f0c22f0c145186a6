"""Signal files: CSV with diagnostics by line, sample catalogues, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremolo.config import AUDIO_KEPT, UPLOAD_BYTES
from tremolo.functions.scalars import formatted, parsed, significant
from tremolo.operators import signals as sig
from tremolo.operators.sessions import audio_name
from tremolo.session import Stage

_ISSUE = "struct<code:string,message:string,field:string>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, size) of files; bytes, so that broken encodings are seen. Files over the limit aren't read: their content is null."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= UPLOAD_BYTES).select("path", "content", F.col("length").alias("size"))
    return small.unionByName(files.where(F.col("length") > UPLOAD_BYTES).select("path", F.lit(None).cast("binary").alias("content"), F.col("length").alias("size")))


def header_mode(header: Column) -> Column:
    """'pair', 'single', or the code of what is wrong with the header."""
    cells = F.transform(F.split(F.lower(header), ","), lambda c: F.trim(c))
    return (
        F.when(cells == F.array(F.lit("timestamp"), F.lit("amplitude")), "pair")
        .when(cells == F.array(F.lit("amplitude")), "single")
        .when(~F.array_contains(cells, "amplitude"), "missing_column")
        .otherwise("file_format")
    )


def parse_lines(files: DataFrame) -> DataFrame:
    """(sample_id, mode, line_no, cells) of each non-blank line; mode tells of the header, line 1 is the header.

    ``files`` has sample_id, content (bytes) and size, and may have kind, the name's ending: other than csv
    is invalid_file_type. Line numbers count non-blank lines.
    """
    kind = F.col("kind") if "kind" in files.columns else F.lit("csv")
    text = F.when(F.is_valid_utf8(F.col("content")), F.regexp_replace(F.decode("content", "UTF-8"), r"^\x{FEFF}", ""))
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    rows = files.select("sample_id", text.alias("text"), lines.alias("lines"), "size", F.lower(kind).alias("kind"))
    mode = (
        F.when(F.col("kind") != "csv", "invalid_file_type")
        .when(F.col("size") > UPLOAD_BYTES, "file_too_large")
        .when(F.col("text").isNull(), "file_format")
        .when(F.size("lines") == 0, "empty_data")
        .otherwise(F.coalesce(F.when(F.size("lines") == 1, F.when(header_mode(F.col("lines")[0]).isin("pair", "single"), "empty_data")), header_mode(F.get("lines", F.lit(0)))))
    )
    rows = rows.select("sample_id", mode.alias("mode"), "lines")  # told once a file: beside a line no text or lines of its file go on
    rows = rows.select("sample_id", "mode", F.posexplode_outer("lines").alias("pos", "line"))
    cells = F.transform(F.split("line", ",", -1), lambda c: F.trim(c))
    return rows.select("sample_id", "mode", (F.col("pos") + 1).cast("long").alias("line_no"), cells.alias("cells"))


#: Lines to a block in which a long file's rows are numbered.
LINES = 1 << 16


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """``parse_lines`` of the CSV files at ``path``, of any size, read by split: no task holds a file.

    A split's lines are numbered where they are; the splits before add their counts. The header's mode goes with
    every line, by a join with one row a file.
    """
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    where = [plain(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("start")]
    stage = Stage(spark, "lines")
    raw = stage.write(spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("k"), "value").where(F.trim("value") != ""))
    counts = raw.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stage.write(counts.select("path", "start", F.coalesce(before, F.lit(0)).alias("before"), "valid"))
    number = F.row_number().over(Window.partitionBy("path", "start").orderBy("k"))
    rows = raw.withColumn("_n", number).join(offsets.drop("valid"), ["path", "start"]).withColumn("line_no", (F.col("_n") + F.col("before")).cast("long"))
    line = F.when(F.col("line_no") == 1, F.regexp_replace("value", r"^\x{FEFF}", "")).otherwise(F.col("value"))
    rows = stage.write(rows.select("path", "line_no", line.alias("line")))
    files = spark.read.format("binaryFile").load(path).select("path", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("kind"))  # lists them, their contents aren't read
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    heads = rows.groupBy(same(F.col("path")).alias("_p")).agg(F.max_by(F.struct("line"), -F.col("line_no"))["line"].alias("head"), F.max("line_no").alias("n"))
    valid = offsets.groupBy(same(F.col("path")).alias("_p")).agg(F.bool_and("valid").alias("valid"))
    known = files.withColumn("_p", same(F.col("path"))).drop("path").join(heads, "_p", "left").join(valid, "_p", "left")
    mode = (
        F.when(F.col("kind") != "csv", "invalid_file_type").when(~F.col("valid"), "file_format").when(F.col("n").isNull(), "empty_data")
        .when((F.col("n") == 1) & header_mode(F.col("head")).isin("pair", "single"), "empty_data").otherwise(header_mode(F.col("head")))
    )
    known = stage.write(known.select("_p", mode.alias("mode")))
    sample = F.regexp_replace(F.element_at(F.split("_p", "/"), -1), r"\.[^.]*$", "")
    out = known.join(rows.withColumn("_p", same(F.col("path"))), "_p", "left")
    cells = F.transform(F.split("line", ",", -1), lambda c: F.trim(c))
    return out.select(sample.alias("sample_id"), "mode", "line_no", cells.alias("cells"))


def read_long_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``read_csv`` for files of any size: lines by split, points numbered and intervals taken within blocks of lines."""
    return scan_lines(Stage(spark, "long").write(split_lines(spark, path)), long=True)


def scan(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``scan_lines`` of whole CSV files (sample_id, content, size and maybe kind)."""
    return scan_lines(parse_lines(files))


def scan_lines(lines: DataFrame, long: bool = False) -> tuple[DataFrame, DataFrame]:
    """(signals, scans) of the lines of CSV files; with ``long`` no window spans a whole file.

    ``signals``: sample_id, idx, ts (null where the file has none or one of its times is bad),
    amplitude. ``scans``: a row for each file with n_samples, rate (inferred from times), file_error
    and the errors and warnings of its rows, by line. Rows of empty cells are passed over;
    a wrong number of cells is invalid_value; an empty amplitude is missing_value; one that is no
    finite number is invalid_value; a bad time warns once and discards all times of the file.
    """
    width = F.when(F.col("mode") == "pair", 2).otherwise(1)
    ok = F.col("mode").isin("pair", "single")
    rows = lines.where(ok & (F.col("line_no") > 1) & F.exists("cells", lambda c: c != ""))
    cell = F.get("cells", width - 1)
    value = parsed(cell)
    code = F.when(F.size("cells") != width, "invalid_value").when(cell == "", "missing_value").when(value.isNull(), "invalid_value")
    field = F.when(F.size("cells") != width, "row").otherwise("amplitude")
    rows = rows.withColumns({"code": code, "field": field, "amplitude": value, "ts": F.when(F.col("mode") == "pair", parsed(F.get("cells", F.lit(0))))})
    good = rows.where("code IS NULL").select("sample_id", "mode", "line_no", "ts", "amplitude")
    times = good.groupBy("sample_id").agg(F.min(F.when((F.col("mode") == "pair") & F.col("ts").isNull(), F.col("line_no"))).alias("bad_time"), F.count(F.lit(1)).alias("n_samples"))
    order = Window.partitionBy("sample_id").orderBy("line_no")
    signals = good.join(times.select("sample_id", "bad_time"), "sample_id").withColumn("ts", F.when(F.col("bad_time").isNull(), F.col("ts")))
    if long:
        signals = Stage(lines.sparkSession, "points").write(sig.indexed(signals, "sample_id", F.floor(F.col("line_no") / LINES), "line_no").select("sample_id", "idx", "ts", "amplitude"))
    else:
        signals = signals.select("sample_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "ts", "amplitude")
    message = F.concat(F.lit("line "), F.col("line_no"), F.lit(": "), F.col("field"), F.when(F.col("code") == "missing_value", " is missing").otherwise(" is invalid"))
    bad = rows.where("code IS NOT NULL").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "code", message.alias("message"), "field"))).alias("bad"))
    if long:
        rate = sig.sampling_rate(signals)
    else:
        step = F.col("ts") - F.lag("ts").over(Window.partitionBy("sample_id").orderBy("idx"))
        rate = signals.withColumn("_d", step).groupBy("sample_id").agg(F.median("_d").alias("_m"))
        rate = rate.select("sample_id", F.when(F.col("_m") > 0, 1 / F.col("_m")).alias("rate"))
    heads = lines.groupBy("sample_id").agg(F.max("mode").alias("mode"))
    out = heads.join(times, "sample_id", "left").join(bad, "sample_id", "left").join(rate, "sample_id", "left")
    file_error = F.when(~F.col("mode").isin("pair", "single"), F.struct(F.col("mode").alias("code"), F.concat(F.lit("the file can't be used: "), F.col("mode")).alias("message")))
    warn = F.struct(F.lit("invalid_value").alias("code"), F.concat(F.lit("line "), F.col("bad_time"), F.lit(": bad timestamp; all timestamps are ignored")).alias("message"), F.lit("timestamp").alias("field"))
    none = F.array().cast(f"array<{_ISSUE}>")
    errors = F.coalesce(F.transform("bad", lambda b: F.struct(b["code"].alias("code"), b["message"].alias("message"), b["field"].alias("field"))), none)
    return signals, out.select(
        "sample_id", "mode", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "rate", file_error.alias("file_error"), errors.alias("errors"), F.when(F.col("bad_time").isNotNull(), F.array(warn)).otherwise(none).alias("warnings"),
    )


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``scan`` of the files at ``path``; a sample is named by its file without the ending."""
    file = F.element_at(F.split("path", "/"), -1)
    return scan(read_files(spark, path).select(F.regexp_replace(file, r"\.[^.]*$", "").alias("sample_id"), "content", "size", F.regexp_extract(file, r"\.([^.]*)$", 1).alias("kind")))


def strict(scans: DataFrame) -> DataFrame:
    """``scans`` that fails at run time on the first error of any file."""
    first = F.coalesce(F.col("file_error.code"), F.get("errors", F.lit(0))["code"])
    checked = F.when(first.isNotNull(), F.raise_error(F.concat(F.col("sample_id"), F.lit(": "), first)))
    return scans.where(F.coalesce(checked.cast("string"), F.lit("")) == "")


SAMPLE = "sample_id string, file string, device_type string, sampling_rate double, rotation_speed double, sensor_position string, condition string, condition_label string, n_samples long, source string, note string"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of sample metadata: a JSON object a file; others are left out; the id defaults to the file's name."""
    rows = spark.read.schema(SAMPLE + ", _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path).withColumn("_file", F.input_file_name())
    name = F.regexp_replace(F.element_at(F.split("_file", "/"), -1), r"\.json$", "")
    return rows.where("_broken IS NULL").withColumn("sample_id", F.coalesce("sample_id", F.url_decode(name))).drop("_broken", "_file").orderBy("sample_id")


def csv_lines(signals: DataFrame) -> DataFrame:
    """(sample_id, idx, value): lines of a CSV file, the header at -1."""
    body = signals.select("sample_id", "idx", F.concat(formatted("%.6f,", "ts"), significant(F.col("amplitude"), 8)).alias("value"))
    head = signals.select("sample_id").distinct().select("sample_id", F.lit(-1).cast("long").alias("idx"), F.lit("timestamp,amplitude").alias("value"))
    return head.unionByName(body)


def write_csv(signals: DataFrame, path: str) -> None:
    """One folder a sample; Spark's committer makes it whole or not at all."""
    csv_lines(signals).repartition("sample_id").sortWithinPartitions("sample_id", "idx").select("sample_id", "value").write.partitionBy("sample_id").mode("overwrite").text(path)


def sample_lookup(requests: DataFrame, samples: DataFrame, shown: int = 50) -> DataFrame:
    """``requests`` (request_id, sample_id) with sample_error: the first ``shown`` known ids, where the sample isn't in the catalogue."""
    first = samples.select("sample_id").distinct().orderBy("sample_id").limit(shown).agg(F.array_sort(F.collect_list("sample_id")).alias("_known"))
    found = samples.select("sample_id", F.lit(True).alias("_found")).distinct()
    rows = requests.join(found, "sample_id", "left").join(first, F.lit(True))
    error = F.when(F.col("_found").isNull(), F.concat(F.lit("sample_not_found; known: "), F.array_join("_known", ", ")))
    return rows.withColumn("sample_error", error).drop("_found", "_known")


def write_samples(samples: DataFrame, path: str) -> None:
    """A folder for each sample with its metadata as a JSON object, indented; characters beyond ASCII stay as they are."""
    rows = samples.select(F.col("sample_id").alias("_id"), F.to_json(F.struct(*samples.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    rows.repartition("_id").write.partitionBy("_id").mode("overwrite").text(path)


def write_audio(sounds: DataFrame, path: str, keep: int = AUDIO_KEPT) -> int:
    """Writes WAV files (session_id, slot, wav) into a folder and keeps its newest ``keep`` files; the number of files removed.

    Names of another form than allowed are passed over. At most ``keep`` sounds are written, of the largest
    session_id and slot, one by one, so that what passes through the driver is bounded.
    """
    spark = sounds.sparkSession
    named = sounds.withColumn("_name", audio_name(F.col("session_id"), F.col("slot"))).where("_name IS NOT NULL AND wav IS NOT NULL")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    for r in named.orderBy(F.desc("_name")).limit(keep).select("_name", "wav").toLocalIterator():
        out = store.create(spark._jvm.org.apache.hadoop.fs.Path(folder, r["_name"]), True)
        out.write(bytearray(r["wav"]))
        out.close()
    files = sorted(((f.getModificationTime(), f.getPath().getName()) for f in store.listStatus(folder) if f.getPath().getName().endswith(".wav")), reverse=True)
    for _, name in files[keep:]:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), False)
    return len(files[keep:])
