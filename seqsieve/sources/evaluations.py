"""A table of evaluations that searches share: appended to, asked by key, the last write of a key wins.

An answer is known by (gkey, fingerprint, k_light, k_heavy, null_type, seed). Rows lie in folders by the first two digits of the
key's MD5, so that a question reads the folders of its keys only. Several writers may append at once.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("gkey", "fingerprint", "k_light", "k_heavy", "null_type", "seed")
SCHEMA = "gkey string, fingerprint string, k_light long, k_heavy long, null_type string, seed long, value string, stamp string, part string"


class Evaluations:
    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def read(self) -> DataFrame:
        """All writes, the last of each key only."""
        return _last(self._rows())

    def _rows(self) -> DataFrame:
        try:
            return self._spark.read.schema(SCHEMA).parquet(self._path)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self._spark.createDataFrame([], SCHEMA)

    def append(self, rows: DataFrame) -> None:
        """Write rows(KEYS, value). They are later than all writes that began before, by the writers' clocks."""
        stamp = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        part = F.substring(F.md5("gkey"), 1, 2)
        types = dict(p.split() for p in SCHEMA.split(", "))
        full = rows.select(*[F.col(c).cast(types[c]).alias(c) for c in (*KEYS, "value")], F.lit(stamp).alias("stamp"), part.alias("part"))
        full.repartition("part").write.mode("append").partitionBy("part").parquet(self._path)  # one file for each folder

    def answers(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of the table that answer asked(KEYS), asked rows without an answer). A null in a key equals a null."""
        asked = asked.withColumn("part", F.substring(F.md5("gkey"), 1, 2))
        parts = [r.part for r in asked.select("part").distinct().collect() if r.part is not None]  # 256 at most
        known = _last(self._rows().where(F.col("part").isin(parts)))
        same = lambda a, b: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in ("part", *KEYS)))
        hits = known.alias("k").join(asked.alias("a"), same("k", "a"), "left_semi")
        return hits, asked.alias("a").join(known.alias("k"), same("a", "k"), "left_anti").drop("part")

    def compact(self) -> int:
        """Put each folder's last writes into one file and delete the files that they came from; how many went. Files that appear
        meanwhile stay. Until the old files are gone a key is there twice, under one stamp, and read() gives one of them."""
        rows = self._rows()
        files = [r[0] for r in rows.select(F.input_file_name()).distinct().collect()]
        if not files:
            return 0
        kept = self._spark.read.schema(SCHEMA).option("basePath", self._path).parquet(*files)
        _last(kept).repartition("part").write.mode("append").partitionBy("part").parquet(self._path)
        jvm, conf = self._spark.sparkContext._jvm, self._spark.sparkContext._jsc.hadoopConfiguration()
        for name in files:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, False)
        return len(files)

    # What a search asks for an epoch: some dozens of genomes.

    def get(self, keys: list[tuple]) -> dict[tuple, dict]:
        if not keys:
            return {}
        types = dict(p.split() for p in SCHEMA.split(", "))
        hits, _ = self.answers(self._spark.createDataFrame([tuple(k) for k in keys], ", ".join(f"{c} {types[c]}" for c in KEYS)))
        return {tuple(r[c] for c in KEYS): json.loads(r.value) for r in hits.collect()}

    def put(self, found: dict[tuple, dict]) -> None:
        if found:
            types = dict(p.split() for p in SCHEMA.split(", "))
            self.append(self._spark.createDataFrame([(*k, json.dumps(v)) for k, v in found.items()], ", ".join(f"{c} {types[c]}" for c in (*KEYS, "value"))))


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", *KEYS).agg(F.max_by("value", "stamp").alias("value"), F.max("stamp").alias("stamp")).select(*KEYS, "value", "stamp", "part")
