"""A keyed table that grows by what changed: a base and deltas after it, merged where they are read.

``put`` writes the rows that changed, and nothing else, as a numbered delta; a number that is written again replaces what it held, so a batch that is
run twice leaves the same table.  Of all rows of a key the one with the greatest order counts, whatever delta it came in, and a row that is ``gone`` hides
its key.  ``compact`` writes a new base once the deltas have grown to a share of it, so each row is rewritten a bounded number of times.  A base covers the
deltas up to its number; the base before it, and the deltas since, stay for those that still read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deltas are merged into a new base once they have this share of its rows.
COMPACT_SHARE = 0.25


class Versions:
    """The table in a folder; rows have the columns of ``schema``, of which ``key`` and ``order`` are two, and ``gone``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, order: str):
        self.spark, self.folder, self.key, self.order = spark, folder, key, order
        self.schema = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("gone", T.BooleanType())])

    def _path(self, text: str):  # noqa: ANN202  a JVM object
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def whole(self, part: str) -> list[int]:
        """Numbers whose rows are all there: their commit marker is."""
        path, fs = self._path(f"{self.folder}/{part}")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if fs.exists(self._path(f"{s.getPath()}/_SUCCESS")[0]))

    def parts(self, until: int | None = None) -> tuple[int | None, list[int]]:
        """(base, deltas after it) as of a number."""
        bases = [v for v in self.whole("base") if until is None or v <= until]
        base = bases[-1] if bases else None
        return base, [v for v in self.whole("delta") if (base is None or v > base) and (until is None or v <= until)]

    def put(self, rows: DataFrame, number: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/delta/v={number}")

    def _rows(self, part: str, numbers: list[int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{part}/v={v}" for v in numbers])

    def merged(self, until: int | None = None) -> DataFrame:
        """The last row of each key, ``gone`` ones too."""
        base, deltas = self.parts(until)
        if base is None and not deltas:
            return self.spark.createDataFrame([], self.schema)
        held = None if base is None else self._rows("base", [base])
        if not deltas:
            return held
        # Of deltas there may be many rows a key, of the base one: only keys that changed are taken out of it.
        row = F.struct(*[c for c in self.schema.names if c != self.key])
        last = self._rows("delta", deltas)
        last = last if held is None else last.unionByName(held.join(last.select(self.key).distinct(), self.key, "left_semi"))
        last = last.groupBy(self.key).agg(F.max_by(row, F.struct(self.order, "gone")).alias("_row")).select(self.key, "_row.*").select(*self.schema.names)
        return last if held is None else held.join(self._rows("delta", deltas).select(self.key).distinct(), self.key, "left_anti").select(*self.schema.names).unionByName(last)

    def read(self, until: int | None = None) -> DataFrame:
        return self.merged(until).where(~F.col("gone")).drop("gone")

    def compact(self, share: float = COMPACT_SHARE) -> bool:
        """Write a new base if the deltas have grown enough; whether it did."""
        base, deltas = self.parts()
        if not deltas:
            return False
        before = 0 if base is None else self._rows("base", [base]).count()
        if base is not None and self._rows("delta", deltas).count() < share * before:
            return False
        self.merged(deltas[-1]).write.mode("overwrite").parquet(f"{self.folder}/base/v={deltas[-1]}")
        bases = self.whole("base")
        kept = bases[-2] if len(bases) > 1 else -1
        for part, numbers in (("base", bases[:-2]), ("delta", [v for v in self.whole("delta") if v <= kept])):
            for v in numbers:
                path, fs = self._path(f"{self.folder}/{part}/v={v}")
                fs.delete(path, True)
        return True
