"""Sources and sinks (S1-S12).  Explicit schemas everywhere, no inference."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.numeric import finite_or_null, py_strip
from pairlab.operators.scan import prefix_agg
from pairlab.session import materialize

#: files a task writes or reads, and folders it lists; rows of a batch of names, and bytes of a batch of texts
FILES_PER_TASK, FOLDERS_PER_TASK, LISTED_ROWS, BATCH_BYTES = 1 << 13, 1 << 11, 1 << 13, 1 << 23


def read_records(spark: SparkSession, path: str, schema: T.StructType,
                 required: Sequence[str] = ()) -> DataFrame:
    """JSON-lines scan with a fixed schema; a malformed line fails the job.

    ``required`` columns must be in the schema and in the records of every file
    (one aggregate over the keys of the lines): a file without one raises.
    """
    missing = [c for c in required if c not in schema.fieldNames()]
    if missing:
        raise ValueError(f"required columns missing from schema: {missing}")
    if required:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.json_object_keys("value").alias("keys"))
        has = [F.coalesce(F.bool_or(F.array_contains("keys", c)), F.lit(False)).alias(f"has_{i}") for i, c in enumerate(required)]
        bad = lines.groupBy("file").agg(*has).filter(" OR ".join(f"NOT has_{i}" for i in range(len(required)))).first()
        if bad is not None:
            raise ValueError(f"{bad['file']} lacks {[c for i, c in enumerate(required) if not bad[f'has_{i}']]}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """One scan per split, tagged with ``split`` and unioned."""
    out = None
    for split, path in paths.items():
        d = read_records(spark, path, schema).withColumn("split", F.lit(split))
        out = d if out is None else out.unionByName(d)
    return out


def _records_with_breaks(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw) of records that may hold line breaks in quotes: a record ends at a
    line break after an even number of quotes (a running count per file, in blocks)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "raw"))
    quotes = F.length("raw") - F.length(F.replace(F.col("raw"), F.lit('"'), F.lit("")))
    lines = prefix_agg(whole.withColumn("_q", quotes), ["file"], "at", [("_before", "sum", "_q", False)])
    starts = (F.coalesce("_before", F.lit(0)) % 2 == 0).cast("int")
    numbered = prefix_agg(lines.withColumn("_starts", starts), ["file"], "at", [("record", "sum", "_starts", True)])
    # the lines of one record
    parts = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("_l"))
    return parts.select("file", F.array_join(F.transform("_l", lambda x: x["raw"]), "\n").alias("raw")).filter("raw <> ''")


def read_csv_metrics(spark: SparkSession, path: str, schema: T.StructType, *, multiline: bool = False):
    """S3: CSV files with a header line; unparsable rows go to an error table
    instead of failing the job.

    With ``multiline`` values in quotes may hold line breaks and doubled quotes (each
    file is then read whole, by one task); without it a line is a row and files are split.

    A file's header (the line that has exactly the schema's names) says in which
    order its columns come; a file without one has the schema's order.  A row
    with too few or many values, or one that is not of its column's type, is bad.
    Returns (good, bad); bad rows keep the raw line and their file.
    """
    names = schema.fieldNames()
    if multiline:
        lines = _records_with_breaks(spark, path)
    else:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    name = lambda x: F.btrim(F.trim(x), F.lit('"'))
    fields = F.transform(F.split("raw", ","), name)
    lines = lines.withColumn("is_header", F.array_sort(fields) == F.array(*[F.lit(n) for n in sorted(names)]))
    # one row a file
    headers = lines.filter("is_header").groupBy("file").agg(F.max(fields).alias("header"))
    ddl = ", ".join(f"c{i} STRING" for i in range(len(names))) + ", _corrupt STRING"
    rows = (lines.filter("NOT is_header").join(headers, "file", "left")
            .withColumn("header", F.coalesce("header", F.array(*[F.lit(n) for n in names])))
            .withColumn("r", F.from_csv("raw", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **({"escape": '"'} if multiline else {})})))
    cells = F.array(*[F.col(f"r.c{i}") for i in range(len(names))])
    text = {n: F.get(cells, F.array_position("header", n).cast("int") - 1) for n in names}
    typed = rows.select("file", "raw", F.col("r._corrupt").isNotNull().alias("_bad"),
                        *[text[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields],
                        *[text[n].isNotNull().alias(f"_has_{n}") for n in names])
    wrong = F.col("_bad")
    for n in names:
        wrong = wrong | (F.col(f"_has_{n}") & F.col(n).isNull())
    return typed.filter(~wrong).select(*names, "file"), typed.filter(wrong).select("file", "raw")


def read_keyed_documents(spark: SparkSession, pattern: str, *, key_regex: str = r"([^/.]+)\.[^/]*$") -> DataFrame:
    """One row per file: key = file name up to its first dot, stripped text."""
    d = spark.read.text(pattern, wholetext=True)
    return d.select(F.regexp_extract(F.col("_metadata.file_path"), key_regex, 1).alias("key"),
                    py_strip(F.col("value")).alias("text"))


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark gives it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _store(uri: str):
    """Arrow's file system of a folder, and the folder's path in it."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].strip("/")
    store, base = fs.FileSystem.from_uri(uri)
    return store, base.rstrip("/")


def _arrow_reads(uri: str) -> bool:
    """Whether Arrow has a file system for ``uri`` (and it is no pattern)."""
    if set("*?[{") & set(uri):
        return False
    try:
        _store(uri)
    except Exception:
        return False
    return True


def _in_uri(name: str) -> str:
    """A name as it stands in a file's URI (``_metadata.file_path``)."""
    legal = lambda c: c.isalnum() or c in "_-!.~'()*,;:$&+=@" if c < "\x80" else c.isprintable()
    return "".join(c if legal(c) else "".join(f"%{x:02X}" for x in c.encode()) for c in name)


def _list_testcases(spark: SparkSession, root: str) -> DataFrame:
    """(problem_id, folder, name, size) of the files ``input.*.txt`` and ``output.*.txt`` of every folder of ``root``, written once.

    A task lists the root, many list its folders: no listing of files passes the driver.
    """
    def folders(batches):
        from pyarrow import fs
        for _ in batches:
            store, base = _store(root)
            names = [i.base_name for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.type == fs.FileType.Directory]
            for lo in range(0, len(names), LISTED_ROWS):
                part = names[lo:lo + LISTED_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([_in_uri(x) for x in part], pa.string()), pa.array(part, pa.string())], names=["problem_id", "folder"])

    def files(batches):
        from pyarrow import fs
        store, base = _store(root)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)
        for b in batches:
            rows = []
            for problem, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = ((i.base_name, i.size) for i in store.get_file_info(fs.FileSelector(f"{base}/{folder}")) if i.type == fs.FileType.File)
                rows += [(problem, folder, x, n) for x, n in found if x.endswith(".txt") and x.startswith(("input.", "output.")) and x.count(".") > 1]
                if len(rows) >= LISTED_ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    names, kinds = ["problem_id", "folder", "name", "size"], [pa.string(), pa.string(), pa.string(), pa.int64()]
    found = materialize(spark.range(0, 1, 1, 1).mapInArrow(folders, "problem_id string, folder string"), "folders")
    found = found.repartition(-(-found.count() // FOLDERS_PER_TASK) or 1, "folder")
    return materialize(found.mapInArrow(files, "problem_id string, folder string, name string, size long"), "files")


def _read_tests(tests: DataFrame, root: str) -> DataFrame:
    """(problem_id, tc_no, folder, input, expected) with two files' names -> with their texts."""
    names = ["problem_id", "tc_no", "input", "expected"]

    def read(batches):
        store, base = _store(root)

        def text(folder, name):
            if name is None:
                return None
            with store.open_input_file(f"{base}/{folder}/{name}") as f:
                return f.read()

        for b in batches:
            lo, texts, size = 0, ([], []), 0
            for i, (folder, *pair) in enumerate(zip(*[b.column(c).to_pylist() for c in (2, 3, 4)], strict=True)):
                for out, name in zip(texts, pair, strict=True):
                    out.append(text(folder, name))
                    size += len(out[-1] or b"")
                if size >= BATCH_BYTES or i + 1 == b.num_rows:
                    part = b.slice(lo, i + 1 - lo)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.binary()) for x in texts)], names=names)
                    lo, texts, size = i + 1, ([], []), 0

    d = tests.select("problem_id", "tc_no", "folder", "input", "expected").mapInArrow(read, "problem_id string, tc_no int, input binary, expected binary")
    return d.select("problem_id", "tc_no", *[F.col(c).cast("string").alias(c) for c in ("input", "expected")])


def read_testcases(spark: SparkSession, root: str, allow: DataFrame | None = None) -> DataFrame:
    """``root/<problem>/input.N.txt`` and ``output.N.txt`` paired by
    (problem_id, tc_no); ``allow`` (problem_id, tc_no) keeps listed tests only
    (ids given as int or text both match); a name without a number is no test.

    Folders are listed and files read by tasks, through Arrow's file systems; names are
    paired before texts are read.  A store that Arrow does not know, or a pattern as
    ``root``, is listed by Spark's driver and read by its own reader.
    """
    uri = _qualified(spark, root)
    by_tasks = _arrow_reads(uri)
    files = _list_testcases(spark, uri) if by_tasks else None

    def scan(kind):
        number = lambda c: F.regexp_extract(c, kind + r"\.(\d+)\.txt$", 1).try_cast("int").alias("tc_no")
        if by_tasks and not (d := files.filter(F.col("name").startswith(f"{kind}."))).isEmpty():
            # Spark's readers give no row for an empty file
            return d.filter("size > 0").select("problem_id", number(F.col("name")), "folder", F.col("name").alias(kind)).filter("tc_no IS NOT NULL")
        # (raises if there is no such file)
        d = spark.read.text(os.path.join(root, "*", f"{kind}.*.txt"), wholetext=True)
        p = F.col("_metadata.file_path")
        return d.select(F.regexp_extract(p, r"([^/]+)/[^/]+$", 1).alias("problem_id"), number(p),
                        F.col("value").alias(kind)).filter("tc_no IS NOT NULL")
    out = scan("input").join(scan("output").drop("folder").withColumnRenamed("output", "expected"),
                             ["problem_id", "tc_no"], "left")
    if allow is not None:
        out = out.join(allow.select("problem_id", F.col("tc_no").cast("int").alias("tc_no")),
                       ["problem_id", "tc_no"], "left_semi")
    if by_tasks:
        out = _read_tests(out.repartition(-(-files.count() // FILES_PER_TASK) or 1, "problem_id", "tc_no"), uri)
    return out


TIMING_SCHEMA = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("command", T.StringType()), T.StructField("mean", T.DoubleType()),
    T.StructField("times", T.ArrayType(T.DoubleType()))])))])


def read_timing_json(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark JSON files -> (file, tc_no, mean, times); a bad file, or a
    command without an input number, gives no rows."""
    d = (spark.read.schema(TIMING_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE")
         .json(path).withColumn("file", F.col("_metadata.file_path")))
    r = d.select("file", F.explode("results").alias("r"))
    return r.select("file", F.regexp_extract("r.command", r"input_(\d+)", 1).try_cast("int").alias("tc_no"),
                    F.col("r.mean").alias("mean"), F.col("r.times").alias("times")).filter("tc_no IS NOT NULL")


def _finite(c: Column, t: T.DataType) -> Column:
    """``c`` with NaN and infinities as NULL, at any depth."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return finite_or_null(c)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, v: _finite(v, t.valueType))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_finite(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    return c


def write_records(df: DataFrame, path: str, *, inf_as_null: bool = False, mode: str = "errorifexists") -> None:
    """JSON-lines sink (a folder of part files); optionally NaN/inf -> null (nested ones too)."""
    if inf_as_null:
        df = df.select(*[_finite(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    df.write.mode(mode).json(path)


def write_named_texts(df: DataFrame, root: str, *, n_rows: int = 0) -> int:
    """One file for every row of ``df`` (name, text) below ``root``; returns how many.

    Tasks write through Arrow's file systems (``file:``, ``hdfs:``, ``s3:``, ``gs:``);
    a name is written whole, so a task that runs again writes the same files.  With
    ``n_rows`` (about the rows of ``df``) they are dealt out by name: however few
    splits ``df`` has, a task writes about ``FILES_PER_TASK``, those of a folder together.
    """
    def write(batches):
        from pyarrow import fs
        uri = root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root
        store, base = fs.FileSystem.from_uri(uri)
        made: set[str] = set()
        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"], strict=True):
                folder = f"{base}/{name}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    if len(made) >= FILES_PER_TASK:
                        made.clear()
                    made.add(folder)
                with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write((text or "").encode())
            yield pd.DataFrame({"n": [len(pdf)]})
    d = df.select("name", "text")
    if n_rows > FILES_PER_TASK:
        d = d.repartitionByRange(-(-n_rows // FILES_PER_TASK), "name")
    return d.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_summary(df: DataFrame, path: str, *, experiment: str | None = None) -> None:
    """Small report rows appended as CSV with header; earlier experiments stay.

    The report meets in one file after its own job ran in parallel.
    """
    if experiment is not None:
        df = df.withColumn("experiment", F.lit(experiment))
    df.repartition(1).write.mode("append").option("header", "true").csv(path)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a written stage if complete (``_SUCCESS``), else compute and
    write it; either way return the re-read table (lineage cut at the file)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def versioned_write(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """Write under ``path/v=<run_id>`` and never overwrite an earlier copy."""
    target = os.path.join(path, f"v={run_id or uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(target)
    return target


def normalise_keyed_json(df: DataFrame, col: str, *, value_type: str = "map<string,array<string>>",
                         outer: str = "tc_no", inner: str = "output", leaf: str = "program_id") -> DataFrame:
    """Nested JSON objects {test: {output: [ids]}} -> rows; test keys to int."""
    m = F.from_json(F.col(col), f"map<string,{value_type}>")
    d = df.select("*", F.explode(F.transform_keys(m, lambda k, v: k.cast("int"))).alias(outer, "_inner")).drop(col)
    d = d.select("*", F.explode("_inner").alias(inner, "_ids")).drop("_inner")
    return d.select("*", F.explode("_ids").alias(leaf)).drop("_ids")
