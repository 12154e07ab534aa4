"""Tables in the cluster's shared folder, and small helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: `spark.checkpoint.dir`, or one of our own where it is unset.

    A folder of our own is a local temporary one, so it is refused unless Spark
    runs in one process (as tests do).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("bytelode.scratch.dir", None)
        if not named:
            named = tempfile.mkdtemp(prefix="bytelode-")
            spark.conf.set("bytelode.scratch.dir", named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder, and read back.

    It cuts the lineage, survives lost executors, and the files' size lets Spark
    broadcast the table only where it is under the session's threshold.
    """
    path = f"{shared_dir(df.sparkSession)}/bytelode-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that `durable` wrote."""
    jvm = df.sparkSession._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Lets Spark hand Python workers no more than 4 MB at once (or one row), unless the session says otherwise."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those whose key has the least hash.

    Where there are more, a threshold on the hash leaves little more than `most` rows in
    all before they are ordered; ordering all would send `most` rows of every partition.
    """
    place = F.shiftrightunsigned(F.xxhash64(key), 1)
    share = (1.2 * most + 200) / max(rows.count(), 1)
    if share < 1:
        rows = rows.where(place < int(2**63 * share))
    return rows.orderBy(place, key).limit(most)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches so that each holds about `chars` bytes of text (a longer text stands alone).

    At the end it gives back what Arrow's allocator keeps, since workers outlive tasks.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        begin = total = 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > chars:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        if begin < len(sizes):
            yield batch.slice(begin)
    pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
