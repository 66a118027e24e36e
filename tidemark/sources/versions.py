"""A table of Parquet files whose versions are published whole: readers see one version, writers touch only the partitions they change."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "_part"


@dataclass
class Version:
    """What a version holds: for each partition its folder, and for each writer the last batch that is in it."""

    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """``schema`` rows in ``folder``, parted by ``part`` (an expression over the rows; its number of values should stay in the thousands, as
    days do). A version is a small JSON file that names the folders of its partitions; it is published by renaming it to the next number,
    which only one writer can, and nothing that it names is ever changed. So a write that dies leaves no trace, one that is
    done again with the same batch number changes nothing, and of two writers at once the later one starts anew on what the other left.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, part: Column):
        self.spark, self.folder, self.schema, self.part = spark, folder.rstrip("/"), schema, F.coalesce(part.cast("string"), F.lit("none"))
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._hadoop = jvm.org.apache.hadoop.fs
        self._path = lambda name: self._hadoop.Path(f"{self.folder}/{name}")
        self._fs = self._path("").getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._read = jvm.org.apache.commons.io.IOUtils.toString
        self._fs.mkdirs(self._path("versions"))

    def numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "_")

    def version(self, number: int | None = None) -> Version:
        """That of ``number``, by default the last; number 0 is empty."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return Version()
        stream = self._fs.open(self._path(f"versions/{number:012d}.json"))
        try:
            return Version(**json.loads(self._read(stream, "UTF-8")))
        finally:
            stream.close()

    def publish(self, new: Version) -> bool:
        """Whether ``new`` has become the next version; not if there is one of its number."""
        draft, final = self._path(f"versions/_{uuid.uuid4().hex}.json"), self._path(f"versions/{new.number:012d}.json")
        out = self._fs.create(draft, False)
        out.write(json.dumps(new.__dict__, sort_keys=True).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._context.rename(draft, final, options)  # fails where ``final`` exists
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                return False
            raise error
        return True

    def read(self, number: int | None = None, parts: set[str] | None = None, version: Version | None = None) -> DataFrame:
        """The rows of a version (the last by default), or of some of its partitions."""
        v = version or self.version(number)
        places = [f"{self.folder}/{place}" for name, place in sorted(v.parts.items()) if parts is None or name in parts]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def _written(self, df: DataFrame) -> dict[str, str]:
        """``df`` as new files; their folders by partition. Rows are dealt by partition first, else each task writes a file to each of them; adaptive
        execution deals a large partition over many tasks."""
        place = f"data/{uuid.uuid4().hex}"
        df.select(*self.schema.names, self.part.alias(PART)).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.folder}/{place}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(place)) if s.isDirectory()]
        return {unquote(n[len(PART) + 1 :]): f"{place}/{n}" for n in names if n.startswith(f"{PART}=")}

    def change(self, df: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], writer: str = "", batch: int | None = None, tries: int = 10) -> Version:
        """The version in which ``merge(old, df)`` stands for the partitions that ``df`` has rows of; the files of all others are kept.

        With ``batch`` (numbers of a ``writer`` go up) a batch that is in already is passed over.
        """
        touched = {r[0] for r in df.select(self.part).distinct().collect()}
        for _ in range(tries):
            now = self.version()
            if not touched or batch is not None and batch <= now.batches.get(writer, -1):
                return now
            new = self._written(merge(self.read(parts=touched, version=now), df))
            batches = now.batches | ({writer: batch} if batch is not None else {})
            kept = {name: place for name, place in now.parts.items() if name not in touched}
            if self.publish(Version(now.number + 1, kept | new, batches)):
                return self.version(now.number + 1)
        raise PySparkException(f"{tries} other versions came in between")

    def expire(self, keep: int = 10) -> int:
        """Removes all versions but the last ``keep``, and the partitions that only they name; how many folders went. No version may be read or
        written meanwhile that is not among these."""
        numbers = self.numbers()
        old, stay = numbers[:-keep], numbers[-keep:]
        needed = {p for n in stay for p in self.version(n).parts.values()}
        gone = {p for n in old for p in self.version(n).parts.values()} - needed
        for n in old:
            self._fs.delete(self._path(f"versions/{n:012d}.json"), False)
        for p in gone:
            self._fs.delete(self._path(p), True)
        return len(gone)


def filled_over(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with the non-null cells of new ones, and new rows; ``new`` has no key twice, and may lack columns."""
    other = [c for c in old.columns if c not in keys]
    both = old.join(new.withColumnsRenamed({c: f"_new_{c}" for c in new.columns if c not in keys}), keys, "full_outer")
    return both.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in both.columns else F.col(c) for c in other])
