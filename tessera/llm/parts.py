"""Wide rows kept as part files in the shared folder, and gone back to by place.

A pass over texts or pages writes them, compressed, to part files and gives a narrow
row for each. What is then joined, grouped and sorted are narrow rows; their places
lead back to the wide ones, so those are never shuffled. A task names its files after
its own attempt and reports them with its rows, so a repeated task leaves an unused
file and never a wrong one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import textvec
from tessera.llm.scratch import materialize, small_batches

#: Bytes of the wide column in a batch of a part file, about.
PIECE = 1 << 18
#: Names that Spark and Arrow give one kind of store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def storage(path: str):
    """File system and plain path of a shared folder, created if missing; a kind that Arrow cannot open is an error."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    try:
        system, plain = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")
    except pa.ArrowInvalid as e:
        raise ValueError(f"tasks cannot write to {path}: set spark.checkpoint.dir to a file, hdfs, s3, gs or abfs folder") from e
    system.create_dir(plain, recursive=True)
    return system, plain


def same(n: int, value: str) -> pa.Array:
    return pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [value]).cast(pa.string())


def store(rows: DataFrame, folder: str, wide: int, facts: Callable[[pa.RecordBatch], list[pa.Array]], ddl: str) -> DataFrame:
    """Keep all columns of ``rows`` and list (part, row, the facts named in ``ddl``) for each; column ``wide`` bounds batches."""
    names = ["part", "row", *T.StructType.fromDDL(ddl).names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = storage(folder)
        part, sink, writer, done = uuid.uuid4().hex, None, None, 0
        for batch in batches:
            for piece in textvec.slices(batch, wide, PIECE):
                if writer is None:
                    sink = system.open_output_stream(f"{plain}/{part}.rows", compression=None)
                    writer = pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(piece)
                at = pa.array(np.arange(done, done + piece.num_rows, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([same(piece.num_rows, part), at, *facts(piece)], names)
                done += piece.num_rows
        if writer is not None:
            writer.close()
            sink.close()

    return materialize(small_batches(rows).mapInArrow(run, f"part string, row int, {ddl}"), "stored")


class Reader:
    """A part file read once, from its first row to its last."""

    ending = "rows"

    def __init__(self, folder: str, part: str):
        system, plain = storage(folder)
        self.file = system.open_input_file(f"{plain}/{part}.{self.ending}")
        self.batches = iter(pa.ipc.open_stream(self.file))
        self.first, self.end, self.batch = 0, 0, None

    def next_batch(self) -> bool:
        self.batch = next(self.batches, None)
        if self.batch is None:
            self.file.close()
            return False
        self.first, self.end = self.end, self.end + self.batch.num_rows
        return True


def by_part(df: DataFrame, parts: int, *order: str) -> DataFrame:
    """A part's rows together and in order, about one part to a task."""
    return df.repartitionByRange(parts, "part").sortWithinPartitions("part", *order)


def of_parts(batches: Iterator[pa.RecordBatch], folder: str, reader: type[Reader] = Reader) -> Iterator[tuple[Reader, pa.Table]]:
    """For narrow rows in order of part and row: each batch of wide rows that has some, with them."""

    def meet(part: str, rows: pa.Table) -> Iterator[tuple[Reader, pa.Table]]:
        wide, at = reader(folder, part), 0
        row = rows["row"].to_numpy()
        while at < len(row) and wide.next_batch():
            to = int(np.searchsorted(row, wide.end))
            if to > at:
                yield wide, rows.slice(at, to - at).combine_chunks()
            at = to

    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            part = batch["part"][0].as_py()
            if held and held[0]["part"][0].as_py() != part:
                yield from meet(held[0]["part"][0].as_py(), pa.Table.from_batches(held))
                held = []
            alike = np.asarray(pc.equal(batch["part"], part))
            n = len(alike) if alike.all() else int(np.argmin(alike))
            held.append(batch.slice(0, n))
            batch = batch.slice(n)
    if held:
        yield from meet(held[0]["part"][0].as_py(), pa.Table.from_batches(held))


def take(places: DataFrame, folder: str, parts: int, schema: T.StructType) -> DataFrame:
    """The wide rows at ``places`` (part, row), each once for every place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide, rows in of_parts(batches, folder):
            yield wide.batch.take(pa.array(rows["row"].to_numpy() - wide.first))

    return by_part(places.select("part", "row"), parts, "row").mapInArrow(run, schema)
