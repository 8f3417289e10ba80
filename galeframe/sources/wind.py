"""The synthetic wind field as a data source of Spark: a reader's partitions are spans of hours."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Hours(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))


class SyntheticWindReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        get = lambda k, v: float(options.get(k, v))
        self.step, self.hours, self.every = get("step", 10.0), int(get("hours", 24)), int(get("every", 3))
        self.each = max(1, int(get("hours_per_partition", 12)))

    def partitions(self) -> list[InputPartition]:
        return [Hours(h, min(h + self.each, self.hours + 1)) for h in range(0, self.hours + 1, self.each)]

    def read(self, partition: InputPartition):
        import numpy as np
        import pyarrow as pa

        first, last = partition.value
        lat, lon = np.arange(-80.0, 80.0 + 1e-9, self.step), np.arange(-180.0, 180.0, self.step)
        for hour in range(first, last):
            if hour % self.every == 0:
                y, x = (a.ravel() for a in np.meshgrid(lat, lon, indexing="ij"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), hour, np.int32)), pa.array(y), pa.array(x)], ["hour", "lat", "lon"])


class SyntheticWind(DataSource):
    """``spark.read.format("synthetic_wind_lattice")``: (hour, lat, lon) of a lattice; ``with_wind`` adds the field as column expressions."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_wind_lattice"

    def schema(self) -> str:
        return "hour int, lat double, lon double"

    def reader(self, schema) -> SyntheticWindReader:
        return SyntheticWindReader(self.options)


def with_wind(lattice):
    from pyspark.sql import functions as F

    from galeframe.functions import wind

    u, v = wind.synthetic_uv(F.col("lat"), F.col("lon"), F.col("hour").cast("double"))
    tws, twd = wind.condition(F.col("u"), F.col("v"))
    return lattice.withColumns({"u": u, "v": v}).withColumns({"tws": tws, "twd": twd})
