"""What the text operators share: reading, the shared scratch folder, tokens."""

from __future__ import annotations

import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a run of the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (unset, as in tests) one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        import atexit

        _own_dirs[app] = tempfile.mkdtemp(prefix="ampline-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def materialise(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    df.sparkSession._jvm.System.gc()  # the cleaner removes the shuffle files of plans that nothing holds any more
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes materialised tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Columns of documents that operators read by name.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def packed(docs: DataFrame) -> DataFrame:
    """docs with all columns but OWN in one, `carried`, so that no name of theirs meets an operator's."""
    extra = [c for c in docs.columns if c not in OWN]
    kept = [F.col(c) for c in docs.columns if c in OWN]
    return docs.select(*kept, *([F.struct(*[docs[f"`{c}`"] for c in extra]).alias("carried")] if extra else []))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that packed() had, in their order."""
    return df.select(*[F.col(c) if c in OWN else F.col("carried").getField(c).alias(c) for c in columns])


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold(doc_id, mod: int) -> int:
    """crc32(doc_id as text) mod `mod`; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def fold_column(doc_id, mod: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[list[tuple]]:
    """Rows of Arrow batches as tuples, `step` at a time, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield list(zip(*(c.to_pylist() for c in part.columns), strict=True))


def row_uid(index: int) -> int:
    """A number no other row of this stage has; stable where the result is materialised."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 36) | index
