"""Monthly grids in NPZ files: a data source that reads them by blocks of rows, and their writer.

A file `<kind>-<month>.npz` holds the axes `lats` and `lons` and fields of the shape (lats, lons) or (lats,
lons, k). Planning reads the axes of each file and no field; a task reads one block of latitudes of one
month, and of the fields only those in the schema it was asked for, row by row from the (perhaps compressed)
member, so its memory is one block and not one month.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructType

AXES = ("lats", "lons")
PLACE = "month int, i int, j int, lat double, lon double"
#: Fixed value: a cell is taken for a place if its centre lies within so many degrees on both axes.
NEAR_DEG = 0.75


def _opened(path: str):
    """File system and path in it. Paths without a scheme are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(member) -> tuple[tuple[int, ...], object]:
    """Shape and type of an array, from the start of its member."""
    from numpy.lib import format as npy

    version = npy.read_magic(member)
    shape, by_column, dtype = npy.read_array_header_1_0(member) if version == (1, 0) else npy.read_array_header_2_0(member)
    if by_column and len(shape) > 1:
        raise ValueError("grids must be stored by rows")
    if dtype.hasobject:
        raise ValueError("grids must not hold objects")
    return shape, dtype


def _rows(archive, name: str, start: int, stop: int):
    """Rows start to stop of a member; what lies before them is passed over in small pieces."""
    import numpy as np

    with archive.open(f"{name}.npy") as member:
        shape, dtype = _header(member)
        width = dtype.itemsize * int(np.prod(shape[1:], dtype="int64"))
        ahead = start * width
        while ahead > 0:
            ahead -= len(member.read(min(ahead, 1 << 20))) or ahead
        data = member.read((stop - start) * width)
    return np.frombuffer(data, dtype).reshape(stop - start, *shape[1:])


class GridBlock(InputPartition):
    def __init__(self, path: str, month: int, start: int, stop: int):
        self.path, self.month, self.start, self.stop = path, month, start, stop


class NpzGrids(DataSource):
    """Options: path (a folder), kind (start of the file names), months (comma-separated; default: all there are),
    lat_min, lat_max (blocks without a latitude between them are not read), rows (latitudes per block, 64).

    Columns: month, i, j, lat, lon and a field per array; a schema with fewer of them reads fewer arrays.
    Months without a file give no rows, fields that a file lacks are null; so are cells that are NaN.
    """

    @classmethod
    def name(cls) -> str:
        return "npzgrid"

    def _files(self) -> list[tuple[int, str]]:
        import re

        from pyarrow import fs

        system, at = _opened(self.options["path"])
        only = {int(m) for m in self.options.get("months", "").split(",") if m.strip()}
        named = re.compile(rf"{re.escape(self.options.get('kind', 'grid'))}-(\d\d)\.npz$")
        found = [(int(m[1]), f.path) for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if (m := named.match(f.base_name))]
        return sorted(x for x in found if not only or x[0] in only)

    def schema(self) -> StructType:
        """From the headers of the first file."""
        import zipfile

        system, _ = _opened(self.options["path"])
        out = StructType()
        for name, kind in (("month", IntegerType()), ("i", IntegerType()), ("j", IntegerType()), ("lat", DoubleType()), ("lon", DoubleType())):
            out.add(name, kind)
        for _, path in self._files()[:1]:
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                for name in sorted(x.removesuffix(".npy") for x in archive.namelist()):
                    with archive.open(f"{name}.npy") as member:
                        shape, dtype = _header(member)
                    if name not in AXES and len(shape) in (2, 3):
                        cell = {"b": BooleanType(), "i": LongType(), "u": LongType()}.get(dtype.kind, DoubleType())
                        out.add(name, ArrayType(cell) if len(shape) == 3 else cell)
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzReader(self, schema)


class NpzReader(DataSourceReader):
    def __init__(self, source: NpzGrids, schema: StructType):
        self.options, self.schema = dict(source.options), schema
        self.files = source._files()

    def partitions(self) -> list[InputPartition]:
        import zipfile

        system, _ = _opened(self.options["path"])
        rows = int(self.options.get("rows", 64))
        low, high = float(self.options.get("lat_min", -90)), float(self.options.get("lat_max", 90))
        blocks: list[InputPartition] = []
        for month, path in self.files:
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                with archive.open("lats.npy") as member:
                    (n,), _ = _header(member)
                lats = _rows(archive, "lats", 0, n)
            for start in range(0, n, rows):
                part = lats[start : start + rows]
                if ((part >= low) & (part <= high)).any():
                    blocks.append(GridBlock(path, month, start, min(start + rows, n)))
        return blocks or [GridBlock("", 0, 0, 0)]

    def read(self, block: GridBlock) -> Iterator:
        import zipfile

        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if not block.path:
            return
        wanted = to_arrow_schema(self.schema)
        low, high = float(self.options.get("lat_min", -90)), float(self.options.get("lat_max", 90))
        system, _ = _opened(self.options["path"])
        with system.open_input_file(block.path) as f, zipfile.ZipFile(f) as archive:
            there = {x.removesuffix(".npy") for x in archive.namelist()}
            with archive.open("lons.npy") as member:
                (n_lon,), _ = _header(member)
            lats, lons = _rows(archive, "lats", block.start, block.stop), _rows(archive, "lons", 0, n_lon)
            fields = {x.name: _rows(archive, x.name, block.start, block.stop) for x in wanted if x.name in there}
        for k, lat in enumerate(lats):
            if not low <= lat <= high:
                continue
            place = {"month": np.full(n_lon, block.month), "i": np.full(n_lon, block.start + k), "j": np.arange(n_lon), "lat": np.full(n_lon, float(lat)), "lon": lons.astype(float)}
            columns = []
            for x in wanted:
                values = place.get(x.name) if x.name in place else fields[x.name][k] if x.name in fields else None
                if values is None:
                    columns.append(pa.nulls(n_lon, x.type))
                elif values.ndim == 2:
                    flat = pa.array(values.ravel(), from_pandas=True).cast(x.type.value_type)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), flat).cast(x.type))
                else:
                    columns.append(pa.array(values, from_pandas=True).cast(x.type))
            yield pa.RecordBatch.from_arrays(columns, schema=wanted)


def read_grids(spark: SparkSession, folder: str, kind: str, fields: str | None = None, **options) -> DataFrame:
    """Grids of a folder as rows (month, i, j, lat, lon, fields); fields is DDL and names what is to be read (None: all)."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers may not have the package on their path
    spark.dataSource.register(NpzGrids)
    reader = spark.read.format("npzgrid").options(path=folder, kind=kind, **options)
    return (reader.schema(f"{PLACE}, {fields}") if fields else reader).load()


def write_grids(cells: DataFrame, folder: str, kind: str, lats: list[float], lons: list[float]) -> list[int]:
    """Writes a file per month of cells (month, i, j, fields) and returns the months.

    Cells that are absent or null are NaN, false in boolean fields, 0 in whole numbers; of repeated cells one
    stays. A month is put together in one task, whose memory is the size of the grid, however many samples
    the cells sum up. A file is complete when it gets its name, so tasks may run again.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    names = [f for f in cells.schema.fields if f.name not in ("month", "i", "j")]
    forms = {f.name: "bool" if f.dataType == BooleanType() else "int64" if isinstance(f.dataType, (IntegerType, LongType)) else "float64" for f in names}

    def put(key, part):
        import io
        import uuid

        import numpy as np
        import pandas as pd

        i, j = part["i"].to_numpy(int), part["j"].to_numpy(int)
        arrays = {"lats": np.asarray(lats, float), "lons": np.asarray(lons, float)}
        for name, form in forms.items():
            values = part[name]
            deep = values.map(lambda x: len(x) if hasattr(x, "__len__") else 0).max() if values.dtype == object and form == "float64" else 0
            shape = (len(lats), len(lons), deep) if deep else (len(lats), len(lons))
            grid = np.full(shape, np.nan) if form == "float64" else np.zeros(shape, form)
            given = values.notna().to_numpy()
            if given.any():
                grid[i[given], j[given]] = np.stack(values[given].to_list()) if deep else values[given].to_numpy(form)
            arrays[name] = grid
        data = io.BytesIO()
        np.savez_compressed(data, **arrays)
        system, at = _opened(folder)
        system.create_dir(at, recursive=True)
        temporary = f"{at}/.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as out:
            out.write(data.getbuffer())
        system.move(temporary, f"{at}/{kind}-{int(key[0]):02d}.npz")
        return pd.DataFrame({"month": [int(key[0])]})

    return sorted(r["month"] for r in cells.groupBy("month").applyInPandas(put, "month int").collect())


def _nearest(value: Column, first: float, step: float, n: int) -> Column:
    """Index of the nearest of n values, the lower of two equally near; those beyond the ends take the end."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((value - first) / step - 0.5))).cast("int")


def sample(points: DataFrame, grid: DataFrame, lats: tuple[float, float, int], lons: tuple[float, float, int], usable: Column) -> DataFrame:
    """points (month, lat, lon, ...) with the fields of their nearest cell; null where it is too far away or not usable.

    lats, lons: first value, step and number of values. Points meet cells by month and index, so the join is
    one of equal keys at any size of grid. A longitude is wrapped to [-180, 180) first and its nearest index
    is not sought across the antimeridian. usable is read on the grid; null counts as not usable.
    """
    x = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    i, j = _nearest(F.col("lat"), *lats), _nearest(x, *lons)
    off = F.pmod(lons[0] + lons[1] * j - x + 180.0, F.lit(360.0)) - 180.0
    near = (F.abs(lats[0] + lats[1] * i - F.col("lat")) <= NEAR_DEG) & (F.abs(off) <= NEAR_DEG)
    asked = points.withColumns({"_i": F.when(near, i), "_j": F.when(near, j)})
    cells = grid.where(usable).drop("lat", "lon").withColumnsRenamed({"i": "_i", "j": "_j"})
    return asked.join(cells, ["month", "_i", "_j"], "left").drop("_i", "_j")
