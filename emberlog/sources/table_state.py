"""What readers of a log table may see, and which ids are given out.

One small file per version in ``state/``, created exclusively: of two writers that
change the same version one succeeds and the other starts again from the new one.
It holds one entry per writer and one per compacted day, however many ingest
batches there were. Old versions go away with each change.

That rests on a store in which creating a file that exists fails, whoever was first.
``EXCLUSIVE_STORES`` names those; in others, such as object stores that look before they
write, two writers could both succeed, so a table's state there is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, SparkSession, functions as F

# Schemes of file systems whose create without overwriting is atomic.
EXCLUSIVE_STORES = ("file", "hdfs", "viewfs", "ofs", "abfs", "abfss")
NUMBER_WIDTH = 12
KEPT_VERSIONS = 3


@dataclass
class Writer:
    """``visible``: the last committed ingest batch; ``open``: the one being written."""

    visible: int = -1
    open: int = -1
    fingerprint: str = ""
    first_id: int = 0
    abandoned: list[int] = field(default_factory=list)


@dataclass
class CompactedDay:
    """The folder with the day's rows of all ingest batches up to ``upto``, by writer."""

    folder: str
    upto: dict[str, int]


@dataclass
class TableState:
    next_id: int = 1
    writers: dict[str, Writer] = field(default_factory=dict)
    days: dict[str, CompactedDay] = field(default_factory=dict)


def split_name(ingest_batch: str) -> tuple[str, int]:
    writer, _, number = ingest_batch.rpartition("-")
    if not writer or not number.isdigit():
        raise ValueError(f"name ingest batches <writer>-<number>: {ingest_batch!r}")
    return writer, int(number)


def folder_name(writer: str, number: int) -> str:
    return f"{writer}-{number:0{NUMBER_WIDTH}d}"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, folder: str) -> list[int]:
    files, path = _files(spark, folder)
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(int(name) for name in names if name.isdigit())


def read_text(spark: SparkSession, path: str) -> str:
    files, place = _files(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def require_exclusive(scheme: str) -> None:
    if scheme not in EXCLUSIVE_STORES:
        raise ValueError(
            f"a table's state needs a store that creates files exclusively ({', '.join(EXCLUSIVE_STORES)}), "
            f"not {scheme!r}"
        )


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not exist yet; whether it was created."""
    files, place = _files(spark, path)
    require_exclusive(files.getUri().getScheme())
    if files.exists(place):
        return False
    try:
        stream = files.create(place, False)
    except Exception as error:
        if "AlreadyExists" in str(error):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def _parse(text: str) -> TableState:
    read = json.loads(text)
    return TableState(
        read["next_id"],
        {name: Writer(**writer) for name, writer in read["writers"].items()},
        {day: CompactedDay(**one) for day, one in read["days"].items()},
    )


def _latest(spark: SparkSession, folder: str) -> tuple[int, TableState]:
    # A version can be removed or still be written while it is read; then a later
    # one is there or the text is not whole yet.
    for attempt in range(100):
        versions = _versions(spark, folder)
        if not versions:
            return 0, TableState()
        try:
            return versions[-1], _parse(read_text(spark, f"{folder}/{versions[-1]}"))
        except Exception:
            if attempt == 99:
                raise
    raise AssertionError


def read_state(spark: SparkSession, folder: str) -> TableState:
    return _latest(spark, folder)[1]


def change_state(spark: SparkSession, folder: str, change: Callable[[TableState], TableState]) -> TableState:
    """Apply a change to the newest state; the change may run more than once."""
    while True:
        version, state = _latest(spark, folder)
        changed = change(state)
        if create_text(spark, f"{folder}/{version + 1}", json.dumps(asdict(changed))):
            files, _ = _files(spark, folder)
            for old in _versions(spark, folder):
                if old <= version + 1 - KEPT_VERSIONS:
                    files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}"), False)
            return changed


def written_upto(writer: str, number: int) -> Column:
    """Whether a row's folder is one of a writer's ingest batches up to a number."""
    name = F.col("ingest_batch")
    return (
        name.startswith(f"{writer}-")
        & (F.length(name) == len(writer) + 1 + NUMBER_WIDTH)
        & (name <= folder_name(writer, number))
    )


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def committed_rows(state: TableState) -> Column:
    """Which rows belong to committed ingest batches, from the folder column only."""
    return any_of([
        written_upto(name, writer.visible)
        & ~F.col("ingest_batch").isin([folder_name(name, n) for n in writer.abandoned])
        if writer.abandoned else written_upto(name, writer.visible)
        for name, writer in state.writers.items() if writer.visible >= 0
    ])


def visible_rows(state: TableState) -> Column:
    """Which rows readers may see, from the folder columns only."""
    covered, compacted = [], []
    for day, one in state.days.items():
        on_day = F.col("event_date") == F.lit(day).cast("date")
        covered.append(on_day & any_of([written_upto(name, upto) for name, upto in one.upto.items()]))
        compacted.append(on_day & (F.col("ingest_batch") == one.folder))
    return (committed_rows(state) & ~any_of(covered)) | any_of(compacted)
