"""Readers and writers: Parquet and CSV tables of links and observations, and HDF5 files of links."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linkrain.functions.geo import haversine

LINKS = "cml_id string, site_a_lat double, site_a_lon double, site_b_lat double, site_b_lon double, length_km double"
SUBLINKS = "cml_id string, channel_id string, frequency_ghz double, polarization string"
_ROWS = 65_536
OBS = "cml_id string, channel_id string, time timestamp_ntz, time_ns bigint, tsl double, rsl double"


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str = OBS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_by_date(df: DataFrame, path: str, time: str = "time", mode: str = "overwrite") -> None:
    """Parquet in a folder for each date, so that scans of a period read only its days."""
    df.withColumn("date", F.to_date(time)).write.mode(mode).partitionBy("date").parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; one of our own, removed at the end, only where that is unset and there is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="linkrain-")
        atexit.register(shutil.rmtree, folder, True)
    return f"{folder}/{uuid.uuid4().hex}"


def with_length(links: DataFrame) -> DataFrame:
    return links.withColumn("length_km", haversine(F.col("site_a_lon"), F.col("site_a_lat"), F.col("site_b_lon"), F.col("site_b_lat")))


def _batches(about: dict[str, object], times: np.ndarray, tsl: np.ndarray, rsl: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one sub-link as Arrow batches: what is the same for all of them, then time (us since 1970), time_ns, tsl, rsl."""
    for i in range(0, len(times), _ROWS):
        at = slice(i, i + _ROWS)
        us = np.asarray(times[at], np.int64)
        same = {k: pa.repeat(pa.scalar(v, pa.string() if isinstance(v, str) else pa.float64()), len(us)) for k, v in about.items()}
        own = {"time": pa.array(us, pa.timestamp("us")), "time_ns": pa.array(us * 1000), "tsl": pa.array(np.asarray(tsl[at], float)), "rsl": pa.array(np.asarray(rsl[at], float))}
        yield pa.RecordBatch.from_pydict(same | own)


class _Groups(InputPartition):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names


class _Hdf5Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[_Groups]:
        import h5py

        with h5py.File(self.path, "r") as f:
            names = sorted(f)
        return [_Groups(self.path, names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)]

    def read(self, partition: _Groups) -> Iterator[pa.RecordBatch]:
        import h5py

        with h5py.File(partition.path, "r") as f:
            for name in partition.names:
                link = f[name]
                sites = {f"site_{s}_{c[:3]}": float(link.attrs[f"site_{s}_{c}"]) for s in "ab" for c in ("latitude", "longitude")}
                for channel in sorted(c for c in link if c.startswith("channel_")):
                    g = link[channel]
                    about = {"cml_id": str(link.attrs["id"]), "channel_id": channel, "frequency_ghz": float(g.attrs["frequency"]) / 1e9, "polarization": str(g.attrs["polarization"])} | sites
                    yield from _batches(about, np.round(g["time"][:] * 1e6), g["tx"][:], g["rx"][:])


class CmlHdf5(DataSource):
    """spark.dataSource.register(CmlHdf5); spark.read.format("cmlh5").option("links_per_task", 10).load(path). Needs h5py."""

    @classmethod
    def name(cls) -> str:
        return "cmlh5"

    def schema(self) -> str:
        return "cml_id string, channel_id string, frequency_ghz double, polarization string, site_a_lat double, site_a_lon double, site_b_lat double, site_b_lon double, time timestamp_ntz, time_ns bigint, tsl double, rsl double"

    def reader(self, schema) -> _Hdf5Reader:
        return _Hdf5Reader(self.options["path"], int(self.options.get("links_per_task", 10)))


#: Variables of the files and their columns.
_NETCDF = {"site_a_latitude": "site_a_lat", "site_a_longitude": "site_a_lon", "site_b_latitude": "site_b_lat", "site_b_longitude": "site_b_lon", "length": "length_km", "frequency": "frequency_ghz", "polarization": "polarization"}


class _NetcdfReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[_Groups]:
        import netCDF4

        with netCDF4.Dataset(self.path) as f:
            n = len(f.dimensions["cml_id"])
        return [_Groups(self.path, [*range(i, min(n, i + self.per_task))]) for i in range(0, n, self.per_task)]

    def read(self, partition: _Groups) -> Iterator[pa.RecordBatch]:
        import netCDF4

        with netCDF4.Dataset(partition.path) as f:
            dates = netCDF4.num2date(f["time"][:], f["time"].units, only_use_cftime_datetimes=False, only_use_python_datetimes=True)
            times = np.array(dates, "datetime64[us]").astype(np.int64)
            channels = [str(c) for c in f["channel_id"][:]]
            axes = [f["rsl"].dimensions.index(x) for x in ("channel_id", "time")]
            for i in partition.names:
                cut = tuple(i if x == "cml_id" else slice(None) for x in f["rsl"].dimensions)
                tsl, rsl = (np.ma.filled(np.ma.asarray(f[v][cut], float), np.nan) for v in ("tsl", "rsl"))
                if axes[0] > axes[1]:
                    tsl, rsl = tsl.T, rsl.T
                for c, channel in enumerate(channels):
                    about = {"cml_id": str(f["cml_id"][i]), "channel_id": channel}
                    for name, column in _NETCDF.items():
                        about[column] = self._value(f, name, i, c, str if column == "polarization" else float)
                    yield from _batches(about, times, tsl[c], rsl[c])

    @staticmethod
    def _value(f, name: str, link: int, channel: int, kind: type):
        """Of a variable over links, or links and channels; NaN or an empty string where the file has none."""
        if name not in f.variables:
            return kind("nan") if kind is float else ""
        at = {"cml_id": link, "channel_id": channel}
        value = f[name][tuple(at[d] for d in f[name].dimensions)]
        return kind("nan") if kind is float and np.ma.is_masked(value) else kind(value)


class CmlNetcdf(DataSource):
    """spark.read.format("cmlnetcdf") over dimensions cml_id, channel_id, time with variables tsl and rsl, and of links and
    channels coordinates, length (km), frequency (GHz) and polarization. Needs netCDF4."""

    @classmethod
    def name(cls) -> str:
        return "cmlnetcdf"

    def schema(self) -> str:
        return "cml_id string, channel_id string, site_a_lat double, site_a_lon double, site_b_lat double, site_b_lon double, length_km double, frequency_ghz double, polarization string, time timestamp_ntz, time_ns bigint, tsl double, rsl double"

    def reader(self, schema) -> _NetcdfReader:
        return _NetcdfReader(self.options["path"], int(self.options.get("links_per_task", 10)))
