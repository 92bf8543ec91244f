"""Session helpers: a local session for tests and the bench, and the shared
checkpoint folder that jobs use to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session configured like the test and bench runs.

    On a cluster the session comes from the launcher; nothing here is needed
    there except what `ensure_checkpoint_dir` reads.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("thresher")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in spark.checkpoint.dir.

    The setting is read from the session; only when it is unset (local tests)
    do we make a scratch folder of our own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir() if hasattr(
            spark.sparkContext, "getCheckpointDir") else None
    if not configured:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="thresher-ckpt-")  # local sessions only
        spark.conf.set("spark.checkpoint.dir", configured)
    try:
        spark.sparkContext.setCheckpointDir(configured)
    except Exception:  # pragma: no cover - Connect sessions have no SparkContext
        pass
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster, since the checkpoint folder is the cluster's shared one)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SENT_TO: set[str] = set()


def send_source(spark: SparkSession) -> None:
    """Give the executors this package, as --py-files would; once per
    application.  Needed where tasks run its Python."""
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SENT_TO:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="thresher-source-"), "thresher_source.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SENT_TO.add(app)


def finished_epochs(spark: SparkSession, path: str) -> list[int]:
    """The epochs whose folder `epoch=N` under `path` is complete."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[6:]) for n in names if n.startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


#: Rows of a micro-batch that one file holds, and so one task reads at least.
ROWS_PER_FILE = 10_000


def files_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_FILE))


def arrive(part: "DataFrame", inbox: str, files: int, form: str = "parquet") -> None:
    """Add `part` to an inbox as exactly `files` files, so that a stream with as
    many files a trigger takes it as one micro-batch, in as many tasks."""
    spark = part.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(inbox)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def there() -> int:
        return sum(s.getPath().getName().startswith("part-") for s in fs.listStatus(p)) if fs.exists(p) else 0

    before = there()
    (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").format(form).save(inbox)
    for _ in range(files - (there() - before)):  # empty partitions leave no file
        spark.createDataFrame([], part.schema).coalesce(1).write.mode("append").format(form).save(inbox)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the cluster's file system (Hadoop API)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the cluster's file system (Hadoop API)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _fingerprint(spark: SparkSession, path: str) -> str:
    """Every file under a path with its length and modification time (Hadoop API)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return path
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return f"{path}:{sorted(found)}"


_CODE_DIGEST: str | None = None


def code_digest() -> str:
    """Digest of this package's source: a derived table built by other code
    is never reused."""
    global _CODE_DIGEST
    if _CODE_DIGEST is None:
        import hashlib

        root = os.path.dirname(os.path.abspath(__file__))
        h = hashlib.sha1()
        for d, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    with open(os.path.join(d, f), "rb") as fh:
                        h.update(f.encode() + fh.read())
        _CODE_DIGEST = h.hexdigest()[:16]
    return _CODE_DIGEST


def materialized(spark: SparkSession, name: str, inputs: list[str], build,
                 partition_by: list[str] | None = None, sort_within: list[str] | None = None) -> "DataFrame":
    """A derived table written once under the shared checkpoint folder and
    read back: later plans start from the stored table (lineage cut, no
    recomputation, survives executor loss).  The folder name carries a
    digest of the inputs (path, length, modification time) and of the code,
    so changed inputs or changed code never reuse a table.
    A table counts as written once its _SUCCESS marker exists."""
    import hashlib

    base = ensure_checkpoint_dir(spark).rstrip("/")
    parts = [code_digest()] + [_fingerprint(spark, p) for p in sorted(inputs)]
    digest = hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]
    path = f"{base}/tables/{name}-{digest}"
    if not _path_exists(spark, f"{path}/_SUCCESS"):
        df = build()
        aside = f"{path}-{uuid.uuid4().hex}"
        w = df
        if partition_by:
            # built once, to a folder of its own: sampling its keys reads it again
            df.write.parquet(f"{aside}-rows")
            w = spark.read.schema(df.schema).parquet(f"{aside}-rows")
            # range partitioning samples the keys, so one hot partition value
            # is split over many writer tasks (by the sort columns) instead of
            # landing in one; each task writes sorted files of few partitions
            w = w.repartitionByRange(*(partition_by + (sort_within or [])))
        if sort_within:
            w = w.sortWithinPartitions(*((partition_by or []) + sort_within))
        # written aside and renamed: two drivers that build the same table
        # don't touch each other's files, and the first to finish publishes
        writer = w.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(aside)
        if partition_by:
            delete_folder(spark, f"{aside}-rows")
        jvm = spark.sparkContext._jvm
        to = jvm.org.apache.hadoop.fs.Path(path)
        fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(to) or not fs.rename(jvm.org.apache.hadoop.fs.Path(aside), to):
            return spark.read.parquet(aside)
    return spark.read.parquet(path)
