"""Tables that grow by batches: each batch writes its own rows, and segments of like size are merged, so that what is written again grows with the logarithm of the batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from redactory.sources.tables import delete, files_of


class Segments:
    """Rows in folder, in segments of consecutive batches, each with over twice the rows of the next. merge: what becomes of the rows of two segments, as the newest row of a key; all rows without.

    A batch that is repeated overwrites its own segment: only segments of earlier batches
    are merged, before a batch begins, and those that a failed attempt left are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        self.spark, self.folder, self.schema, self.merge = spark, folder, schema, merge

    def _path(self, segment: tuple[int, int]) -> str:
        return f"{self.folder}/{segment[0]}-{segment[1]}"

    def listed(self) -> list[tuple[int, int]]:
        """Complete segments that no greater one holds, in order."""
        top, files = files_of(self.spark, self.folder)
        if not files.exists(top):
            return []
        done = [f.getPath() for f in files.listStatus(top) if files.exists(files_of(self.spark, f"{f.getPath().toString()}/_SUCCESS")[0])]
        found = [tuple(map(int, p.getName().split("-"))) for p in done]
        return sorted(s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in found))

    def read(self, before: int | None = None) -> DataFrame:
        """The rows of all batches before a number, or of all; merged."""
        paths = [self._path(s) for s in self.listed() if before is None or s[1] < before]
        return self.merge(self.spark.read.schema(self.schema).parquet(*paths)) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self, segment: tuple[int, int]) -> int:
        """From the files' footers."""
        return self.spark.read.schema(self.schema).parquet(self._path(segment)).count()

    def settle(self, batch_id: int) -> None:
        """Makes ready for a batch, which may be a repeated one."""
        held = self.listed()
        for s in held:
            if s[1] >= batch_id:
                delete(self.spark, self._path(s))
        held = [s for s in held if s[1] < batch_id]
        sizes = [self.rows(s) for s in held]
        while len(held) > 1 and sizes[-2] < 2 * sizes[-1]:
            whole = (held[-2][0], held[-1][1])
            both = self.spark.read.schema(self.schema).parquet(*map(self._path, held[-2:]))
            self.merge(both).write.mode("overwrite").parquet(self._path(whole))
            for s in held[-2:]:
                delete(self.spark, self._path(s))
            held[-2:] = [whole]
            sizes[-2:] = [self.rows(whole)]

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(self._path((batch_id, batch_id)))
