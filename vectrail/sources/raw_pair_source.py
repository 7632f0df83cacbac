"""Raw pairs of ids and vectors as a Spark data source, ``raw_pairs``.

A table is a folder with ``ids`` and ``vectors`` files and a manifest that lists those that belong to
it. Files are written under names of their own and count only once the manifest names them, which is
replaced in one move when all tasks are done. So a write that is killed leaves what was there before.

    register(spark)
    vectors.write.format("raw_pairs").option("path", folder).option("dim", 768).mode("append").save()
    spark.read.format("raw_pairs").option("path", folder).load()

Options: ``path``; ``dim``, the length of the vectors, read from the manifest if there is one;
``range_bytes``, vector bytes that one task reads; ``ids_path`` and ``vectors_path`` instead of
``path`` for folders without a manifest, whose files pair by name. Paths must be reachable by every
executor. A schema of ``doc_id`` alone reads no vectors.
"""

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from vectrail.schema import DOC_ID, DOC_VECTOR, VECTORS

NAME, MANIFEST = "raw_pairs", "_manifest.json"
_ID_BYTES, _ELEMENT_BYTES = 8, 4
_PIECE_BYTES = 8 << 20


def register(spark: SparkSession) -> None:
    """Make the format known to a session, which must hand it filters; the package must be shipped
    to the executors."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawPairs)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _manifest(path: str) -> dict | None:
    system, root = _system(path)
    try:
        with system.open_input_file(f"{root}/{MANIFEST}") as file:
            return json.loads(file.read())
    except FileNotFoundError:
        return None


def _sizes(folder: str) -> dict[str, tuple[str, int]]:
    """Path and bytes of the files of a folder, by their names without ending."""
    from pyarrow import fs

    system, root = _system(folder)
    files = system.get_file_info(fs.FileSelector(root))
    shown = [f for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    scheme = folder[: folder.index("://") + 3] if "://" in folder else ""
    return {f.base_name.rsplit(".", 1)[0]: (scheme + f.path, f.size) for f in shown}


def _files(path: str, stem: str) -> list[str]:
    return [f"{path}/ids/{stem}.i64", f"{path}/vectors/{stem}.f32"]


def _delete_file(path: str) -> None:
    system, file = _system(path)
    try:
        system.delete_file(file)
    except FileNotFoundError:
        pass


@dataclass
class _Range(D.InputPartition):
    """Rows of one pair that a task reads."""

    ids: str
    vectors: str
    first: int
    last: int


@dataclass
class _Written(D.WriterCommitMessage):
    stem: str
    n_rows: int


class RawPairs(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return VECTORS

    def reader(self, schema: T.StructType) -> "RawPairReader":
        unknown = set(schema.names) - set(VECTORS.names)
        if unknown:
            raise ValueError(f"raw pairs have {VECTORS.names}, not {sorted(unknown)}")
        return RawPairReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> "RawPairWriter":
        if not {DOC_ID, DOC_VECTOR} <= set(schema.names):
            raise ValueError(f"raw pairs need {VECTORS.names}")
        return RawPairWriter(self.options, schema, overwrite)


class RawPairReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.names = options, schema.names
        self.filters: list[D.Filter] = []
        self.manifest = _manifest(options["path"]) if "path" in options else None
        if "path" in options and self.manifest is None:
            raise ValueError(f"no finished table of raw pairs at {options['path']}")
        self.dim = int(options.get("dim") or (self.manifest or {}).get("dim") or 0)
        if self.dim < 1:
            raise ValueError("the option dim is missing")

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Filters on the id are answered from the ids before any vector is read."""
        simple = (D.EqualTo, D.In, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)
        for each in filters:
            if isinstance(each, simple) and each.attribute == (DOC_ID,):
                self.filters.append(each)
            elif not (isinstance(each, D.IsNotNull) and each.attribute == (DOC_ID,)):
                yield each

    def _pairs(self) -> list[tuple[str, str, int]]:
        if self.manifest is not None:
            root = self.options["path"].rstrip("/")
            return [(*_files(root, p["stem"]), p["n_rows"]) for p in self.manifest["parts"]]
        ids, vectors = _sizes(self.options["ids_path"]), _sizes(self.options["vectors_path"])
        pairs = []
        for stem in sorted(ids.keys() | vectors.keys()):
            (i_path, i_size), (v_path, v_size) = ids.get(stem, ("", 0)), vectors.get(stem, ("", 0))
            for path, size, width in ((i_path, i_size, _ID_BYTES), (v_path, v_size, _ELEMENT_BYTES * self.dim)):
                if size % width:
                    raise ValueError(f"partial record at the end of {path}")
            if i_size // _ID_BYTES != v_size // (_ELEMENT_BYTES * self.dim):
                raise ValueError(f"ids and vectors differ in number in {stem}")
            pairs.append((i_path, v_path, i_size // _ID_BYTES))
        return pairs

    def partitions(self) -> list[D.InputPartition]:
        step = max(1, int(self.options.get("range_bytes", 128 << 20)) // (_ELEMENT_BYTES * self.dim))
        return [
            _Range(ids, vectors, first, min(first + step, rows))
            for ids, vectors, rows in self._pairs()
            for first in range(0, rows, step)
        ]

    def _chosen(self, docs: np.ndarray) -> np.ndarray:
        kept = np.ones(len(docs), dtype=bool)
        for each in self.filters:
            if isinstance(each, D.In):
                kept &= np.isin(docs, [v for v in each.value if v is not None])
            else:
                kept &= {
                    D.EqualTo: np.equal,
                    D.GreaterThan: np.greater,
                    D.GreaterThanOrEqual: np.greater_equal,
                    D.LessThan: np.less,
                    D.LessThanOrEqual: np.less_equal,
                }[type(each)](docs, each.value)
        return kept

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives for no partitions at all
            return
        width = _ELEMENT_BYTES * self.dim
        piece = max(1, _PIECE_BYTES // width)
        opened = {}
        for column, path in ((DOC_ID, partition.ids), (DOC_VECTOR, partition.vectors)):
            if column in self.names or column == DOC_ID:
                system, root = _system(path)
                opened[column] = system.open_input_file(root)
        for at in range(partition.first, partition.last, piece):
            n = min(piece, partition.last - at)
            docs = np.frombuffer(opened[DOC_ID].read_at(n * _ID_BYTES, at * _ID_BYTES), dtype="<i8")
            if len(docs) != n:
                raise ValueError(f"{partition.ids} is shorter than {partition.last} ids")
            kept = self._chosen(docs)
            if not kept.any():
                continue
            columns = {DOC_ID: pa.array(docs[kept])}
            if DOC_VECTOR in opened:
                # From the first to the last row that is wanted.
                rows = np.flatnonzero(kept)
                low, high = rows[0], rows[-1] + 1
                data = opened[DOC_VECTOR].read_at((high - low) * width, (at + low) * width)
                if len(data) != (high - low) * width:
                    raise ValueError(f"{partition.vectors} is shorter than {partition.last} vectors")
                values = np.frombuffer(data, dtype="<f4").reshape(high - low, self.dim)[kept[low:high]]
                offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * self.dim)
                columns[DOC_VECTOR] = pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.names], self.names)
        for file in opened.values():
            file.close()


class RawPairWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.dim, self.names, self.write_id = int(options["dim"]), schema.names, uuid.uuid4().hex
        before = _manifest(self.path)
        if before and not overwrite and before["dim"] != self.dim:
            raise ValueError(f"the table has {before['dim']} dimensions, not {self.dim}")

    def _delete(self, stem: str) -> None:
        for path in _files(self.path, stem):
            _delete_file(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        # Every attempt of a task has names of its own, so a second one never meets the first.
        stem = f"part-{TaskContext.get().partitionId():05d}-{self.write_id}-{uuid.uuid4().hex[:8]}"
        outputs, rows = [], 0
        try:
            for path in _files(self.path, stem):
                system, file = _system(path)
                system.create_dir(file.rsplit("/", 1)[0], recursive=True)
                outputs.append(system.open_output_stream(file))
            for batch in iterator:
                docs, vectors = (batch.column(self.names.index(c)) for c in (DOC_ID, DOC_VECTOR))
                values = vectors.flatten().to_numpy(zero_copy_only=False)
                if docs.null_count or vectors.null_count or len(values) != len(docs) * self.dim:
                    raise ValueError(f"raw pairs hold ids and vectors of {self.dim} values, no NULL")
                if set(vectors.value_lengths().unique().to_pylist()) - {self.dim}:
                    raise ValueError(f"every vector must have {self.dim} values")
                outputs[0].write(docs.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                outputs[1].write(values.astype("<f4").tobytes())
                rows += len(batch)
            for output in outputs:
                output.close()
        except BaseException:
            self._delete(stem)
            raise
        return _Written(stem, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        before = _manifest(self.path) or {"parts": []}
        kept = [] if self.overwrite else before["parts"]
        parts = [{"stem": m.stem, "n_rows": m.n_rows} for m in messages if m is not None and m.n_rows]
        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        draft = f"{root}/.{MANIFEST}-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as file:
            file.write(json.dumps({"dim": self.dim, "parts": [*kept, *parts]}).encode())
        system.move(draft, f"{root}/{MANIFEST}")
        for message in messages:
            if message is not None and not message.n_rows:
                self._delete(message.stem)
        if self.overwrite:
            for part in before["parts"]:
                self._delete(part["stem"])

    def abort(self, messages: list[_Written | None]) -> None:
        for message in messages:
            if message is not None:
                self._delete(message.stem)


def remove_strays(path: str) -> int:
    """Delete files that no manifest names: what tasks left that were killed. Not while one writes."""
    manifest, path = _manifest(path), path.rstrip("/")
    if manifest is None:
        raise ValueError(f"no finished table of raw pairs at {path}")
    named = {part["stem"] for part in manifest["parts"]}
    strays = [file for folder in ("ids", "vectors") for stem, (file, _) in _sizes(f"{path}/{folder}").items() if stem not in named]
    for file in strays:
        _delete_file(file)
    return len(strays)
