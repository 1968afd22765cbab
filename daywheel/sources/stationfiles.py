"""Station files as a data source: `spark.read.format("station").load(root)` reads all stations in one scan.

Files are root/state/station/station_<first year>_<last year>_daily.csv. A partition is a file or a range of bytes of one.
State and station come from the folders; conditions on them (`=`, `in`) prune folders before any file is opened.
Options: columns (comma-separated), states and stations (comma-separated, the same pruning without a condition), split_bytes.

Rows are text as it stands in the file, each file by its own header: columns it lacks are null, cells that a short row lacks
are null, cells beyond the header are left out, empty cells are null, blank lines no rows, and bytes that aren't UTF-8 become
replacement characters. A cell can't hold a line break. A root that is missing or holds no file gives no rows.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .schema import DATE, MEAN_MEASURES, RAW_DATE, STATION, SUM_MEASURES
from .station import fill_missing, normalize_decimals, parsed_date, resample_daily

#: Files beyond this are read by several tasks.
SPLIT_BYTES = 64 << 20
_PIECE = 1 << 20


@dataclass
class Range(InputPartition):
    """Lines of a file that start in [start, stop)."""

    uri: str
    state: str
    station: str
    start: int
    stop: int


def _open(root: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return system, path.rstrip("/")


def _folders(system: fs.FileSystem, path: str, only: set[str] | None) -> list[str]:
    """Names of path's folders; if `only` says which are wanted, nothing is listed."""
    if only is not None:
        found = system.get_file_info([f"{path}/{name}" for name in sorted(only)])
    else:
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)


class StationReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.root, self.columns = options["path"], columns
        self.size = int(options.get("split_bytes", SPLIT_BYTES))
        listed = lambda name: {x.strip() for x in options[name].split(",")} if name in options else None
        self.only = {"state": listed("states"), STATION: listed("stations")}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  the interface's name
        """Conditions on folders are taken over whole; Spark keeps the others."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            values = (f.value,) if isinstance(f, EqualTo) else getattr(f, "value", ())
            if name not in self.only or any(not isinstance(v, str) or not v or "/" in v or v in (".", "..") for v in values):
                yield f
                continue
            self.only[name] = set(values) if self.only[name] is None else self.only[name] & set(values)

    def partitions(self) -> list[Range]:
        system, path = _open(self.root)
        found = []
        for state in _folders(system, path, self.only["state"]):
            for station in _folders(system, f"{path}/{state}", self.only[STATION]):
                files = [f for f in system.get_file_info(fs.FileSelector(f"{path}/{state}/{station}")) if f.base_name.startswith(f"{station}_") and f.base_name.endswith("_daily.csv")]
                if len(files) > 1:
                    raise ValueError(f"more than one file of {state}/{station}: {sorted(f.path for f in files)}")
                for f in files:
                    found += [Range(f.path, state, station, at, min(at + self.size, f.size)) for at in range(0, f.size, self.size)]
        return found or [Range("", "", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        system, _ = _open(self.root)
        with system.open_input_file(partition.uri) as file:
            first = _line(file, 0)
            header = next(csv.reader([first.decode("utf-8-sig", "replace")], delimiter=";"), [])
            for piece in _pieces(file, max(partition.start, len(first)) if partition.start else len(first), partition.stop, partition.start > len(first)):
                rows = _parsed(piece, [h.strip() for h in header])
                columns = [rows.get(c, pa.nulls(rows[""], pa.string())) for c in self.columns]
                fixed = [pa.array([v] * rows[""], pa.string()) for v in (partition.state, partition.station)]
                yield pa.RecordBatch.from_arrays([*fixed, *columns], names=["state", STATION, *self.columns])


def _line(file: pa.NativeFile, at: int) -> bytes:
    """The rest of the line at a position, with its end."""
    file.seek(at)
    got = b""
    while b"\n" not in got[-_PIECE:] and (more := file.read(_PIECE)):
        got += more
    end = got.find(b"\n")
    return got if end < 0 else got[: end + 1]


def _pieces(file: pa.NativeFile, start: int, stop: int, inside: bool) -> Iterator[bytes]:
    """Whole lines that start in [start, stop), some MB at a time; inside: start may lie within a line, which isn't ours."""
    at = start
    if inside:
        at = start - 1 + len(_line(file, start - 1))
    while at < stop:
        file.seek(at)
        piece = file.read(min(4 * _PIECE, stop - at))
        if not piece:
            return
        if not piece.endswith(b"\n"):
            piece += _line(file, at + len(piece))
        at += len(piece)
        yield piece


def _parsed(piece: bytes, header: list[str]) -> dict:
    """Text columns by name, and under "" their number of rows."""
    odd: list[str] = []

    def aside(row) -> str:
        odd.append(row.text)
        return "skip"

    names = [f"c{i}" for i in range(len(header))]
    text = piece.decode("utf-8", "replace").encode()
    table = pyarrow.csv.read_csv(
        io.BytesIO(text),
        pyarrow.csv.ReadOptions(column_names=names, use_threads=False, block_size=max(len(text), 1)),
        pyarrow.csv.ParseOptions(delimiter=";", invalid_row_handler=aside),
        pyarrow.csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True, quoted_strings_can_be_null=True, null_values=[""]),
    ) if text.strip() else pa.table({n: pa.array([], pa.string()) for n in names})
    short = [[c or None for c in (row + [""] * len(header))[: len(header)]] for row in csv.reader(odd, delimiter=";") if row]
    found = {}
    for i, name in enumerate(header):
        parts = [*table.column(i).chunks, pa.array([row[i] for row in short], pa.string())]
        found.setdefault(name, pa.concat_arrays(parts))
    return found | {"": table.num_rows + len(short)}


class StationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "station"

    def _columns(self) -> list[str]:
        named = self.options.get("columns")
        return [c.strip() for c in named.split(",")] if named else [RAW_DATE, *MEAN_MEASURES, *SUM_MEASURES]

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in ("state", STATION, *self._columns()))

    def reader(self, schema) -> StationReader:
        return StationReader(self.options, self._columns())


def register(spark: SparkSession) -> None:
    """Make the format known to a session; its conditions reach the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StationSource)


def scan(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """(state, station_id, raw columns as text) of all stations under root."""
    register(spark)
    return spark.read.format("station").options(**options).load(root)


def cleaned(raw: DataFrame) -> DataFrame:
    """Raw rows with a date and numbers: rows whose date doesn't parse go, decimal commas become points, missing numbers 0."""
    measures = [c for c in raw.columns if c not in ("state", STATION, RAW_DATE)]
    rows = raw.select("state", STATION, parsed_date(F.col(RAW_DATE)).alias(DATE), *measures).where(F.col(DATE).isNotNull())
    return fill_missing(normalize_decimals(rows, ("state", STATION)))


def load_stations(spark: SparkSession, root: str, where: str | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Daily frames of all stations, or of those a condition on state and station_id picks: state, station_id, Data, measures, row_idx.

    As load_station does for one, but for columns a file lacks, which are missing numbers here. Stations are told apart by
    state and station_id.
    """
    named = {"columns": ",".join(dict.fromkeys((RAW_DATE, *columns)))} if columns else {}
    raw = scan(spark, root, **named)
    return resample_daily(cleaned(raw.where(where) if where else raw), keys=("state", STATION))
