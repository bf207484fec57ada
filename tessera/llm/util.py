"""Shared helpers: scratch tables in the cluster's shared folder, file access from tasks, guards."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separator of every contract: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's scratch folder below ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset (tests, local runs) a temporary
    folder is set; a cluster must name a folder that driver and executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        base = _roots.get("base") or _roots.setdefault("base", "file://" + tempfile.mkdtemp(prefix="tessera-"))
    app = spark.sparkContext.applicationId
    root = f"{base.rstrip('/')}/tessera-{app}"
    if root not in _roots:
        _roots[root] = root
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder at the driver's exit; a session that has ended is no error."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone
        return


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's setting by which a finished query's shuffle files go at once, not at the driver's next long garbage collection.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(df: DataFrame, path: str) -> None:
    """Write ``df`` to ``path``. What is written needs its shuffles no more, so their files are given back."""
    conf = df.sparkSession.conf
    before = conf.get(_RELEASE, None)
    conf.set(_RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_RELEASE)
        else:
            conf.set(_RELEASE, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    while name in df.columns:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """XXH64 over all columns, whatever their types: an order for rows that share a key."""
    from pyspark.sql import types as T

    plain = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.ArrayType)
    return F.xxhash64(*(F.col(f"`{f.name}`") if isinstance(f.dataType, plain) and "map<" not in f.dataType.simpleString() else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema))


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def filesystem(path: str):
    """(pyarrow filesystem, path in it) for a URI or plain path; used by tasks to write and read own-format files."""
    from pyarrow import fs

    if path.startswith("s3a://"):
        path = "s3://" + path[6:]
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, _UPPER, _UPPER.lower())


_TABLE = {ord(a): a.lower() for a in _UPPER}


def lower_ascii_py(text: str) -> str:
    """Lower-case A-Z only, in Python; ``str.lower`` is the same for ASCII texts and faster."""
    return text.lower() if text.isascii() else text.translate(_TABLE)


def as_bytes(texts):
    """An Arrow column of texts as UTF-8 bytes, without a copy."""
    import pyarrow as pa

    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def word_bytes(text: bytes | None) -> list[bytes]:
    """Maximal runs without U+0020 and U+0009 to U+000D, A-Z lower-cased, of a text in UTF-8: ``bytes`` methods know
    ASCII letters and ASCII white space only, which are exactly these."""
    return text.lower().split() if text else []


def words_py(text: str) -> list[str]:
    """Maximal runs without U+0020 and U+0009 to U+000D."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def crc32_text(c: Column) -> Column:
    """crc32 of an integer written as text."""
    return F.crc32(c.cast("string").cast("binary"))


def bucket_count(n: int, per: int, least: int = 1) -> int:
    return max(least, -(-n // per))


def batches(it: Iterable, columns: list[str]):
    """Arrow batches as tuples of the named columns."""
    for b in it:
        yield tuple(b.column(b.schema.get_field_index(c)) for c in columns)


def crc32_py(data: bytes, start: int = 0) -> int:
    return zlib.crc32(data, start) & 0xFFFFFFFF
