"""Two formats of corpora as data sources: JSON lines by split, and dense matrices of tokens and masks.

Reading is dealt out by ranges of files; no task reads more than RANGE_BYTES, wherever its lines begin. Writing has two
phases: tasks write under hidden names and say what they wrote; the commit renames what counts, replaces the list of files and
deletes the rest. A task that failed, or ran twice, leaves nothing that a reader would see; neither does a job that failed
(a task that outlives its failed job may leave a hidden file).

    register(spark)
    df.write.format("split_lines").option("split", "train").mode("append").save(folder)
    spark.read.format("split_lines").schema(...).option("split", "train").load(folder)
    df.write.format("token_matrix").option("width", 64).mode("overwrite").save(folder)

Defined results: several folders (option folders, a JSON list) are tried in their order, and the first that has the split is
read; a split that none has is an error; an empty line is passed over and a malformed one is an error; fields that the schema
has not are ignored and missing ones are null. A matrix row of another width, with nulls, or with a number that its type
cannot hold fails the write.
"""

from __future__ import annotations

import io
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

RANGE_BYTES = 32 << 20
READ_ROWS = 4096
MATRIX = "tokens array<int>, mask array<int>"


def opened(uri: str):
    """(Arrow file system, path), alike on the driver and on executors."""
    from pyarrow import fs

    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def listing(folder: str, name: str) -> list[dict] | None:
    """The files that a committed write of this name left in a folder, or None."""
    from pyarrow import fs as afs

    fs, path = opened(folder)
    if fs.get_file_info(f"{path}/{name}.files.json").type != afs.FileType.File:
        return None
    with fs.open_input_stream(f"{path}/{name}.files.json") as f:
        return json.loads(f.read())["files"]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    hidden: list[tuple[str, str]]  # (hidden name, final name)
    about: list[dict]


class TwoPhaseWriter(DataSourceArrowWriter):
    """Files under hidden names, renamed by the commit; the list of files is what readers go by."""

    def __init__(self, folder: str, name: str, overwrite: bool):
        self.folder, self.name, self.overwrite, self.job = folder, name, overwrite, uuid.uuid4().hex

    def fresh(self, suffix: str) -> tuple[str, str]:
        final = f"{self.name}-{uuid.uuid4().hex}{suffix}"
        return f".{self.job}-{final}", final

    def _sweep(self, fs, path: str) -> None:
        from pyarrow import fs as afs

        for f in fs.get_file_info(afs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(f".{self.job}-"):
                fs.delete_file(f.path)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = opened(self.folder)
        fs.create_dir(path, recursive=True)
        before = listing(self.folder, self.name) or []
        told = [m for m in messages if m is not None]
        for m in told:
            for hidden, final in m.hidden:
                fs.move(f"{path}/{hidden}", f"{path}/{final}")
        files = ([] if self.overwrite else before) + [a for m in told for a in m.about]
        with fs.open_output_stream(f"{path}/.{self.job}-list") as f:
            f.write(json.dumps({"files": files}).encode())
        fs.move(f"{path}/.{self.job}-list", f"{path}/{self.name}.files.json")
        if self.overwrite:
            for old in before:
                for name in old["names"]:
                    fs.delete_file(f"{path}/{name}")
        self._sweep(fs, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(*opened(self.folder))


class LinesWriter(TwoPhaseWriter):
    def write(self, batches) -> Written:
        fs, path = opened(self.folder)
        fs.create_dir(path, recursive=True)
        hidden, final = self.fresh(".jsonl")
        rows = 0
        with fs.open_output_stream(f"{path}/{hidden}") as f:
            for batch in batches:
                lines = [json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False) for row in batch.to_pylist()]
                f.write("".join(x + "\n" for x in lines).encode("utf-8", "surrogatepass"))
                rows += len(lines)
            size = f.tell()
        return Written([(hidden, final)], [{"names": [final], "rows": rows, "bytes": size}])


class LinesReader(DataSourceReader):
    def __init__(self, schema: StructType, files: list[tuple[str, int]]):
        self.schema, self.files = schema, files

    def partitions(self) -> list[Range]:
        return [Range(p, at, min(size, at + RANGE_BYTES)) for p, size in self.files for at in range(0, max(size, 1), RANGE_BYTES)]

    def read(self, part: Range):
        import pyarrow as pa
        import pyarrow.json as pj
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        options = pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
        fs, path = opened(part.path)
        with fs.open_input_file(path) as f:
            data = self._lines(f, part)
        step = 4 << 20
        while data:  # whole lines, some megabytes at a time
            cut = len(data) if len(data) <= step else (data.find(b"\n", step) + 1 or len(data))
            block, data = data[:cut], data[cut:]
            if block.strip():
                table = pj.read_json(io.BytesIO(block), pj.ReadOptions(use_threads=False, block_size=max(1 << 20, len(block) + 1)), options)
                for batch in table.select(schema.names).cast(schema).to_batches(READ_ROWS):
                    yield pa.RecordBatch.from_arrays(batch.columns, schema=schema)

    @staticmethod
    def _lines(f, part: Range) -> bytes:
        """The lines that begin in a range: a line belongs to where its first byte is."""
        at, size = part.start, f.size()
        if at:  # a line that begins here follows a line end
            f.seek(at - 1)
            while at < size:
                more = f.read(1 << 16)
                place = more.find(b"\n")
                if place >= 0:
                    at = f.tell() - len(more) + place + 1
                    break
                at = f.tell()
        if at >= part.end:
            return b""
        f.seek(at)
        data = f.read(part.end - at)
        while not data.endswith(b"\n") and f.tell() < size:
            more = f.read(1 << 16)
            place = more.find(b"\n")
            data += more if place < 0 else more[: place + 1]
            if place >= 0:
                break
        return data


def files_of(folders: list[str], split: str) -> list[tuple[str, int]]:
    """The files of a split and their sizes, in the first folder that has it; FileNotFoundError if none has."""
    from pyarrow import fs as afs

    for folder in folders:
        files = listing(folder, split)
        if files is not None:
            return [(f"{folder}/{f['names'][0]}", f["bytes"]) for f in files]
        fs, path = opened(f"{folder}/{split}.jsonl")
        info = fs.get_file_info(path)
        if info.type == afs.FileType.File:
            return [(f"{folder}/{split}.jsonl", info.size)]
    raise FileNotFoundError(f"no {split}.jsonl in {', '.join(folders)}")


class SplitLines(DataSource):
    """JSON lines of a split: what a committed write left, or a plain file {split}.jsonl."""

    @classmethod
    def name(cls) -> str:
        return "split_lines"

    def schema(self) -> str:
        from loomery.sources.tables import CORPUS_SCHEMA

        return CORPUS_SCHEMA

    def _folders(self) -> list[str]:
        return json.loads(self.options["folders"]) if "folders" in self.options else [self.options["path"]]

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(schema, files_of(self._folders(), self.options.get("split", "train")))

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        return LinesWriter(self._folders()[0], self.options.get("split", "train"), overwrite)


class MatrixWriter(TwoPhaseWriter):
    def __init__(self, folder: str, overwrite: bool, width: int):
        super().__init__(folder, "matrix", overwrite)
        self.width = width

    def write(self, batches) -> Written:
        fs, path = opened(self.folder)
        fs.create_dir(path, recursive=True)
        names = [self.fresh(s) for s in (".u16", ".u8")]
        rows = 0
        with fs.open_output_stream(f"{path}/{names[0][0]}") as tokens, fs.open_output_stream(f"{path}/{names[1][0]}") as mask:
            for batch in batches:
                for column, out, kind, top in (("tokens", tokens, "<u2", 1 << 16), ("mask", mask, "u1", 1 << 8)):
                    out.write(self._dense(batch.column(column), column, kind, top))
                rows += batch.num_rows
        return Written(names, [{"names": [final for _, final in names], "rows": rows, "width": self.width}])

    def _dense(self, lists, column: str, kind: str, top: int) -> bytes:
        import numpy as np

        flat = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy())
        if lists.null_count or flat.null_count or (sizes != self.width).any():
            raise ValueError(f"{column} is not {self.width} wide")
        values = flat.to_numpy(zero_copy_only=False)
        if len(values) and (values.min() < 0 or values.max() >= top):
            raise ValueError(f"a number of {column} is out of bounds")
        return values.astype(kind).tobytes()


class MatrixReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.files = folder, listing(folder, "matrix")
        if self.files is None:
            raise FileNotFoundError(f"no matrix in {folder}")

    def partitions(self) -> list[Range]:
        out = []
        for i, f in enumerate(self.files):
            step = max(1, RANGE_BYTES // (3 * f["width"]))
            out += [Range(str(i), at, min(f["rows"], at + step)) for at in range(0, f["rows"], step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        import numpy as np
        import pyarrow as pa

        if part.start == part.end:
            return
        about = self.files[int(part.path)]
        fs, path = opened(self.folder)
        width = about["width"]
        with fs.open_input_file(f"{path}/{about['names'][0]}") as tokens, fs.open_input_file(f"{path}/{about['names'][1]}") as mask:
            for at in range(part.start, part.end, READ_ROWS):
                n = min(part.end, at + READ_ROWS) - at
                bounds = pa.array(np.arange(n + 1, dtype=np.int32) * width)
                own = [np.frombuffer(f.read_at(n * width * size, at * width * size), kind).astype(np.int32) for f, kind, size in ((tokens, "<u2", 2), (mask, "u1", 1))]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(bounds, pa.array(x)) for x in own], names=["tokens", "mask"])


class TokenMatrix(DataSource):
    """Rows of one width: tokens in 16 bits, masks in 8, in files of raw numbers."""

    @classmethod
    def name(cls) -> str:
        return "token_matrix"

    def schema(self) -> str:
        return MATRIX

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], overwrite, int(self.options["width"]))


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    spark.dataSource.register(SplitLines)
    spark.dataSource.register(TokenMatrix)
