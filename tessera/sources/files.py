"""File sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"arrow": "arrow", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text"}


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder by name, hidden ones left out; a file is its own listing."""
    fs, p = _hadoop(spark, path)
    if fs.getFileStatus(p).isFile():
        return [path]
    return sorted(str(s.getPath()) for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._")


def read_files(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A file or a folder by extension; all files of a folder must have the first one's type."""
    files = listing(spark, path)
    kinds = [f.rsplit(".", 1)[-1] for f in files]
    if not files or kinds[0] not in FORMATS:
        raise ValueError(f"no known files at {path}")
    if any(k != kinds[0] for k in kinds):
        raise ValueError(f"file types differ: {sorted(set(kinds))}")
    kind = kinds[0]
    if kind == "arrow":
        return read_arrow(spark, files)
    reader = spark.read.format(FORMATS[kind])
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    if kind == "json":
        reader = reader.option("multiLine", True)
    return reader.load(files)


def read_arrow(spark: SparkSession, files: list[str]) -> DataFrame:
    """Arrow IPC files; each is read by one task through Spark's own binary reader."""
    import pyarrow as pa

    def first_schema(data: bytes):
        try:
            return pa.ipc.open_file(data).schema
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(data).schema

    from pyspark.sql.pandas.types import from_arrow_schema

    def schema_only(it):
        for b in it:
            for content in b.column(0):
                yield pa.RecordBatch.from_pydict({"schema": [first_schema(content.as_buffer()).serialize().to_pybytes()]})

    # the file is opened by a task; what reaches the driver is its schema
    head = spark.read.format("binaryFile").load(files[0]).select("content").mapInArrow(schema_only, "schema binary").first()[0]
    schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(head))))

    def run(it):
        for b in it:
            for content in b.column(0):
                data = content.as_buffer()
                try:
                    r = pa.ipc.open_file(data)
                    yield from (r.get_batch(i) for i in range(r.num_record_batches))
                except pa.ArrowInvalid:
                    yield from pa.ipc.open_stream(data)

    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, schema)


def read_parquet_union(spark: SparkSession, paths: list[str], heterogeneous: bool = False) -> DataFrame:
    """Parquet files one after the other; with ``heterogeneous`` columns that a file lacks are null, and NaN too."""
    parts = [spark.read.parquet(p) for p in paths]
    if not heterogeneous:
        return reduce(DataFrame.unionByName, parts)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("float", "double") else F.col(c) for c, t in out.dtypes))


def read_rollouts(spark: SparkSession, path: str, mask: str | None = None) -> DataFrame:
    """Rollout JSONL files, in order of the step in their names: ``step, idx, line`` and top-level fields as text;
    ``mask`` is a regular expression whose matches become ``*``."""
    raw = spark.read.text(path).withColumn("step", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.jsonl?$", 1).try_cast("long"))
    line = F.regexp_replace("value", mask, "*") if mask else F.col("value")
    rows = raw.select("step", line.alias("line"), F.monotonically_increasing_id().alias("__o"))
    from pyspark.sql import Window

    w = Window.partitionBy("step").orderBy("__o")
    return rows.withColumn("idx", F.row_number().over(w) - 1).select("step", "idx", "line", *(F.get_json_object("line", f"$.{k}").alias(k) for k in ("input", "output", "gts", "score", "request_id")))


def by_request(rows: DataFrame, request_id: str) -> DataFrame:
    """Point lookup by request id, hyphens ignored."""
    return rows.where(F.replace("request_id", F.lit("-"), F.lit("")) == request_id.replace("-", ""))


def read_documents(spark: SparkSession, glob: str, schema: str | T.StructType, sample: str | None = None) -> DataFrame:
    """One JSON document per file, with ``sample_id`` from its folder; a sample filter prunes folders."""
    at = glob.replace("*", sample, 1) if sample else glob
    d = spark.read.option("multiLine", True).schema(schema).json(at)
    return d.withColumn("path", F.col("_metadata.file_path")).orderBy("path")


def last_progress(spark: SparkSession, path: str, order: str = "current_steps") -> DataFrame:
    """The latest record of a training log in JSON lines."""
    return latest(spark.read.json(path), order)


def latest(r: DataFrame, order: str) -> DataFrame:
    """The record of highest order."""
    return r.agg(F.max_by(F.struct(*r.columns), order).alias("r")).select("r.*")


def log_tail(text: Column, most: int = 20_000) -> Column:
    return F.right(text, F.lit(most))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What is stored at ``path``, or else ``build()`` stored there. A store that was not written to its end (no schema
    can be read from it) is built anew; any other fault is raised."""
    from pyspark.errors import AnalysisException

    if exists(spark, path):
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def staged(spark: SparkSession, source: str, cache_dir: str) -> str:
    """A copy of a remote file or folder below ``cache_dir/<md5 of its path>``, by the Hadoop file systems; an existing
    copy of the same names and sizes is used. Spark reads remote paths by itself: this is for other readers."""
    import hashlib

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    src = at(source)
    dest = at(f"{cache_dir.rstrip('/')}/{hashlib.md5(source.encode()).hexdigest()}/{src.getName()}")
    fs, to = src.getFileSystem(conf), dest.getFileSystem(conf)

    def listing(system, root) -> set:
        found, it = set(), system.listFiles(root, True)
        whole = len(system.getFileStatus(root).getPath().toString())
        while it.hasNext():
            f = it.next()
            if not f.getPath().getName().startswith(".") and not f.getPath().getName().endswith(".crc"):
                found.add((f.getPath().toString()[whole:], f.getLen()))
        return found

    if not (to.exists(dest) and listing(fs, src) == listing(to, dest)):
        to.delete(dest, True)
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, to, dest, False, True, conf)
        if listing(fs, src) != listing(to, dest):
            raise OSError(f"the copy of {source} differs from it")
    return dest.toString()


def tool_capabilities(spark: SparkSession, path: str) -> DataFrame:
    """``name, description, usage_notes`` of a JSON array of tools; an entry without a name or description is an error."""
    t = spark.read.schema("name string, description string, usage_notes string").option("multiLine", True).json(path)
    fault = F.raise_error(F.lit("a tool needs a name and a description")).cast("string")
    return t.withColumn("name", F.when(F.col("name").isNull() | F.col("description").isNull(), fault).otherwise(F.col("name")))


def predictions(rows: DataFrame, prompt: str, predict: str, label: str) -> DataFrame:
    """Prediction rows as JSON lines: ``value`` holds prompt, predict and label."""
    return rows.select(F.to_json(F.struct(F.col(prompt).alias("prompt"), F.col(predict).alias("predict"), F.col(label).alias("label"))).alias("value"))


def layout_pages(payload: Column) -> Column:
    """Array of page texts of an OCR layout payload (JSON): pages below meta.layout_result, layout_result, result, or at
    the top, first found wins; a page is its markdown text, else its pruned result as fenced JSON, else empty. A payload
    without pages is an error when read."""
    v = F.try_parse_json(payload)
    pages = F.coalesce(*(F.try_variant_get(v, f"{p}.layoutParsingResults", "array<variant>") for p in ("$.meta.layout_result", "$.layout_result", "$.result", "$")))
    found = F.coalesce(pages, F.raise_error(F.lit("no layoutParsingResults in the payload")).cast("array<variant>"))

    def one(p):
        pruned = F.try_variant_get(p, "$.prunedResult", "variant")
        return F.coalesce(F.try_variant_get(p, "$.markdown.text", "string"), F.when(pruned.isNotNull() & ~F.coalesce(F.is_variant_null(pruned), F.lit(True)), F.concat(F.lit("```json\n"), F.to_json(pruned), F.lit("\n```"))), F.lit(""))

    return F.transform(found, one)


def rollout_cache_path(root: str, project: str, experiment: str, batch_size: int, n: int) -> str:
    return f"{root}/{project}/{experiment}/batch={batch_size}/n={n}"


def save_batch(batch, path: str) -> None:
    """A batch as Parquet with its metadata as JSON beside it."""
    batch.df.write.mode("overwrite").parquet(f"{path}/rows")
    spark = batch.df.sparkSession
    spark.createDataFrame([(json.dumps(batch.meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_batch(spark: SparkSession, path: str):
    from ..operators.batch import Batch

    return Batch(spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta").first()[0]))


def load_rollout_cache(spark: SparkSession, root: str, project: str, experiment: str, batch_size: int, n: int, expected: dict | None = None):
    """A dumped batch of the same settings, or None: where none was dumped, or its metadata differ from ``expected``."""
    path = rollout_cache_path(root, project, experiment, batch_size, n)
    if not exists(spark, f"{path}/meta"):
        return None
    batch = load_batch(spark, path)
    return batch if all(batch.meta.get(k) == v for k, v in (expected or {}).items()) else None


def write_extras(rows: DataFrame, path: str, columns: list[str], extras: dict[str, list], order: str = "row") -> list[str]:
    """Rows as JSON lines with the extra columns whose length is the number of rows, by position; returns their names."""
    n = rows.count()
    fit = {k: v for k, v in extras.items() if len(v) == n}
    out = rows.select(order, *columns)
    for k, v in fit.items():
        out = out.join(rows.sparkSession.createDataFrame(list(enumerate(v)), f"__at long, {k} string"), F.col(order) == F.col("__at")).drop("__at")
    out.orderBy(order).drop(order).write.mode("overwrite").json(path)
    return sorted(fit)


def write_shards(rows: DataFrame, path: str, workers: int, order: str = "row", error: str = "error") -> dict:
    """JSON lines by worker (``order`` modulo ``workers``), errors apart, and a manifest of the counts in worker order."""
    dealt = rows.withColumn("worker", F.pmod(F.col(order), F.lit(workers)))
    good, bad = dealt.where(F.col(error).isNull()).drop(error), dealt.where(F.col(error).isNotNull())
    good.write.mode("overwrite").partitionBy("worker").json(f"{path}/shards")
    bad.write.mode("overwrite").partitionBy("worker").json(f"{path}/errors")
    counts = {r["worker"]: (r["written"], r["errors"]) for r in dealt.groupBy("worker").agg((F.count("*") - F.count(error)).alias("written"), F.count(error).alias("errors")).collect()}
    manifest = {"workers": [{"worker": w, "written": counts.get(w, (0, 0))[0], "errors": counts.get(w, (0, 0))[1]} for w in range(workers)]}
    rows.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_shards(spark: SparkSession, path: str, order: str = "row") -> DataFrame:
    """The shards merged in worker order, rows of a worker by ``order``."""
    return spark.read.json(f"{path}/shards").orderBy("worker", order)


def write_steps(rows: DataFrame, path: str, step: str = "step") -> None:
    """JSON lines partitioned by step; a step that is written again replaces its own files only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step).json(path)


def write_with_errors(rows: DataFrame, good: str, bad: str, error: str = "error") -> dict[str, int]:
    """Rows without an error to one sink, the others to a dead-letter sink; returns the counts (the manifest)."""
    from pyspark.sql import Observation

    seen = Observation()
    observed = rows.observe(seen, F.count("*").alias("rows"), F.count(error).alias("errors"))
    observed.where(F.col(error).isNull()).drop(error).write.mode("overwrite").json(good)
    counts = dict(seen.get)
    rows.where(F.col(error).isNotNull()).write.mode("overwrite").json(bad)
    return {"rows": counts["rows"], "written": counts["rows"] - counts["errors"], "errors": counts["errors"]}


def write_checked(rows: DataFrame, path: str, rejects: str, **rules: Column) -> None:
    """Rows that keep every rule to ``path``; the others, with the rules they break, to ``rejects``."""
    from ..operators.trajectory import violations

    ok = reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in rules.values()))
    rows.where(ok).write.mode("overwrite").json(path)
    violations(rows, **rules).write.mode("overwrite").json(rejects)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows (step, name, value) appended to a table."""
    metrics.select("step", "name", F.col("value").cast("double").alias("value")).write.mode("append").parquet(path)
