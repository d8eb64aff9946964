"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n: the split every learned operator uses."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def ready_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.  A cluster names its shared folder in ``spark.checkpoint.dir``; only a
    local session (tests) may fall back to a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="partloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable shared checkpoint folder."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Give memory that a task no longer uses back to the system: Python workers outlive their tasks, and what they keep
    would be missing in the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def released(work):
    """A group function of one table that leaves no freed memory behind."""

    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        release()
        return out

    return run


def released_pair(work):
    """A co-group function that leaves no freed memory behind."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        release()
        return out

    return run


def free_name(taken: Iterable[str], name: str = "found") -> str:
    """``name``, or a longer one if a column has it already (names differ in more than their case)."""
    low = {t.lower() for t in taken}
    while name in low:
        name += "_"
    return name


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column`` (always whole rows, at least one)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Total UTF-8 bytes of a text column (one aggregated row reaches the driver)."""
    return int(docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)


def annotate(docs: DataFrame, make, fields: str, keep: list[str] | None = None, reads: list[str] | None = None) -> tuple[DataFrame, str]:
    """Add one struct column computed by Python from whole rows, without a shuffle.

    ``make()`` is called once per task and returns a function from a record batch (about 4 MB of text) to a list of
    Arrow arrays, one per field of ``fields`` (a DDL string).  ``keep`` columns pass through unchanged whatever their
    names; the struct gets a name that clashes with none of them, which is returned too."""
    reads = reads or ["doc_id", "text"]
    keep = ["doc_id"] if keep is None else keep
    name = free_name([*keep, *reads])
    source = docs.select(*dict.fromkeys([*keep, *reads]))
    kept = docs.select(*keep).schema
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept)
    names = [part.strip().split(" ")[0] for part in fields.split(",")]

    def run(batches):
        work = make()
        for batch in slices(batches, reads[-1]):
            if batch.num_rows:
                arrays = work(batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), pa.StructArray.from_arrays(arrays, names)], names=[*keep, name])
        del work
        release()

    inner = ", ".join(f"{n}: {part.strip().split(' ', 1)[1]}" for n, part in zip(names, fields.split(","), strict=True))
    return source.mapInArrow(run, f"{schema}, `{name}` struct<{inner}>"), name
