"""Headerless binary pairs: a file of int64 ids beside a file of float32 vectors.

Row ``i`` of one belongs to row ``i`` of the other. Two files given by their own paths are a pair,
whatever they are called; two folders hold files of the same names, which pair up file by file.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.schema import DOC_ID, DOC_VECTOR, VECTORS

ID_BYTES = 8
ELEMENT_BYTES = 4
# Vector bytes that one task reads, and that it holds at a time.
RANGE_BYTES, PIECE_BYTES = 128 << 20, 8 << 20


def file_counts(spark: SparkSession, path: str, record_bytes: int) -> DataFrame:
    """``(path, stem, n_rows)`` of the files at ``path``; fails on a partial last record."""
    files = spark.read.format("binaryFile").load(path)
    partial = F.concat(F.lit("partial record at the end of "), F.col("path"))
    rows = F.col("length") / record_bytes
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.when(F.col("length") % record_bytes != 0, F.raise_error(partial))
        .otherwise(rows.cast("bigint"))
        .alias("n_rows"),
    ).select("path", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "n_rows")


def _is_file(counts: DataFrame, path: str) -> bool:
    """Whether a path names a single file: then its listing is the path itself."""
    listed = counts.select("path").take(2)
    return len(listed) == 1 and listed[0][0].rstrip("/").endswith(_plain(path))


def _plain(path: str) -> str:
    """A path without scheme and last slash."""
    return "/" + path.split("://")[-1].split(":")[-1].strip("/")


def pair_files(spark: SparkSession, vectors_path: str, ids_path: str, dim: int) -> DataFrame:
    """``(stem, vectors_path, ids_path, n_rows, n_ids)`` of each pair, from file sizes alone."""
    vectors = file_counts(spark, vectors_path, ELEMENT_BYTES * dim).withColumnsRenamed(
        {"path": "vectors_path", "stem": "vectors_stem"}
    )
    ids = file_counts(spark, ids_path, ID_BYTES).withColumnsRenamed(
        {"path": "ids_path", "stem": "ids_stem", "n_rows": "n_ids"}
    )
    single = _is_file(vectors.withColumnRenamed("vectors_path", "path"), vectors_path)
    if single != _is_file(ids.withColumnRenamed("ids_path", "path"), ids_path):
        raise ValueError("give two files or two folders")
    if single:
        one = ids.head()
        return vectors.select(
            F.col("vectors_stem").alias("stem"),
            "vectors_path",
            F.lit(one["ids_path"]).alias("ids_path"),
            "n_rows",
            F.lit(one["n_ids"]).alias("n_ids"),
        )
    paired = vectors.join(ids, F.col("vectors_stem") == F.col("ids_stem"), "full")
    return paired.select(
        F.coalesce("vectors_stem", "ids_stem").alias("stem"),
        "vectors_path",
        "ids_path",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_ids", F.lit(0)).alias("n_ids"),
    )


def read_raw_pair(spark: SparkSession, vectors_path: str, ids_path: str, dim: int) -> DataFrame:
    """The vector table of a raw pair. Fails when ids and vectors differ in number.

    Executors cut the pairs into ranges of rows, and a task reads its range from both files side
    by side, a few megabytes at a time. No vector is shuffled or joined. The paths must be
    reachable by every executor.
    """
    pairs = pair_files(spark, vectors_path, ids_path, dim)
    unmatched = [p.stem for p in pairs.where("n_rows <> n_ids").take(5)]
    if unmatched:
        raise ValueError(f"ids and vectors differ in number in {unmatched}")
    step = max(1, RANGE_BYTES // (ELEMENT_BYTES * dim))
    piece = max(1, PIECE_BYTES // (ELEMENT_BYTES * dim))
    ranges = pairs.where("n_rows > 0").select(
        "vectors_path",
        "ids_path",
        "n_rows",
        F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1, F.lit(step))).alias("first"),
    )
    tasks = ranges.count()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                last = min(row["first"] + step, row["n_rows"])
                files = []
                for column, width in (("ids_path", ID_BYTES), ("vectors_path", ELEMENT_BYTES * dim)):
                    system, path = fs.FileSystem.from_uri(row[column])
                    file = system.open_input_file(path)
                    file.seek(row["first"] * width)
                    files.append(file)
                for at in range(row["first"], last, piece):
                    n = min(piece, last - at)
                    docs = np.frombuffer(files[0].read(n * ID_BYTES), dtype="<i8")
                    values = np.frombuffer(files[1].read(n * ELEMENT_BYTES * dim), dtype="<f4")
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs), pa.ListArray.from_arrays(offsets, pa.array(values))],
                        VECTORS.names,
                    )
                for file in files:
                    file.close()

    # Only the ranges themselves move, one to a task.
    spread = ranges.repartition(max(1, min(tasks, 100_000)), "vectors_path", "first")
    return spread.mapInArrow(read, VECTORS)


def write_raw_pair(
    vectors: DataFrame, vectors_path: str, ids_path: str, mode: str = "error"
) -> DataFrame:
    """Write a vector table as a folder of raw pairs, one pair of files per task.

    Returns ``(stem, n_rows)`` of the files. The paths must be reachable by every executor. Each
    attempt of a task writes hidden files, which take their names when they are complete. Folders
    that hold files are refused, unless ``mode`` is ``overwrite``, which empties them first.
    """
    from pyarrow import fs

    if mode not in ("error", "overwrite"):
        raise ValueError(f"mode must be 'error' or 'overwrite', not {mode!r}")
    for folder in (ids_path, vectors_path):
        system, root = fs.FileSystem.from_uri(folder)
        held = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        if held and mode == "error":
            raise ValueError(f"{folder} is not empty")
        system.create_dir(root, recursive=True)
        if held:
            system.delete_dir_contents(root)

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        stem = f"part-{task.partitionId():05d}"
        rows = 0
        outputs, moves = [], []
        for folder, suffix in ((ids_path, "i64"), (vectors_path, "f32")):
            system, root = fs.FileSystem.from_uri(folder)
            # Spark's file sources do not list names that begin with a dot.
            attempt = f"{root}/.{stem}-{task.taskAttemptId()}.{suffix}"
            outputs.append(system.open_output_stream(attempt))
            moves.append((system, attempt, f"{root}/{stem}.{suffix}"))
        for batch in batches:
            rows += len(batch)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            outputs[0].write(ids.astype("<i8").tobytes())
            outputs[1].write(values.astype("<f4").tobytes())
        for output in outputs:
            output.close()
        for system, attempt, final in moves:
            system.move(attempt, final)
        yield pa.RecordBatch.from_pydict({"stem": [stem], "n_rows": [rows]})

    written = vectors.select(DOC_ID, DOC_VECTOR).mapInArrow(store, "stem string, n_rows bigint")
    return vectors.sparkSession.createDataFrame(written.collect(), written.schema)
