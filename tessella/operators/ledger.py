"""A run's attempts on disk, from which a second session goes on."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: its number of rows and the exclusive or of their hashes."""
    plain = [F.to_json(F.struct(F.col(f.name))) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema.fields]
    told = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.lit(1), *plain)).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), *plain)).alias("y")).first()
    return hashlib.sha256(f"{sorted(df.columns)} {told['n']} {told['x']} {told['y']}".encode()).hexdigest()


class Ledger:
    """A folder with the tables of every attempt that was committed.

    Tables of an attempt are written to a folder of their own; then a small file
    that names the folder is moved into place, which commits them all at once.  A
    session that dies before leaves nothing that counts.  The file also holds the
    number of rows of each table, and the digest of what the run was started with.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> dict | None:
        if not self._fs.exists(self._at(name)):
            return None
        lines = self.spark.read.option("wholetext", True).text(str(self._at(name))).first()
        return json.loads(lines[0])

    def _put(self, name: str, held: dict) -> None:
        tmp = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(tmp)
        out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(tmp, self._at(name)):
            raise ValueError(f"{name} of {self.path} is there already: another session has written it")

    def begin(self, manifest: dict) -> None:
        """Write what the run is started with, or check that it goes on with the same."""
        held = self._read("manifest.json")
        if held is None:
            self._put("manifest.json", manifest)
        elif held != json.loads(json.dumps(manifest)):
            changed = sorted(k for k in {*held, *manifest} if held.get(k) != json.loads(json.dumps(manifest.get(k))))
            raise ValueError(f"{self.path} holds another run: {', '.join(changed)} differ")

    def commit(self, attempt: int, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write the tables of an attempt; they are returned as they are read back."""
        folder, counts = f"attempt-{attempt:03d}-{uuid.uuid4().hex}", {}
        for name, table in tables.items():
            table.write.parquet(str(self._at(f"{folder}/{name}")))
        back = {name: self.spark.read.schema(table.schema).parquet(str(self._at(f"{folder}/{name}"))) for name, table in tables.items()}
        counts = {name: table.count() for name, table in back.items()}
        self._put(f"attempt-{attempt:03d}.json", {"folder": folder, "rows": counts, "schema": {n: t.schema.json() for n, t in tables.items()}})
        return back

    def load(self, attempt: int) -> dict[str, DataFrame] | None:
        """The tables of a committed attempt, or None; tables that are not as they were committed are an error."""
        from pyspark.sql.types import StructType

        held = self._read(f"attempt-{attempt:03d}.json")
        if held is None:
            return None
        out = {}
        for name, rows in held["rows"].items():
            where = self._at(f"{held['folder']}/{name}")
            if not self._fs.exists(where):
                raise ValueError(f"{name} of attempt {attempt} in {self.path} is gone")
            out[name] = self.spark.read.schema(StructType.fromJson(json.loads(held["schema"][name]))).parquet(str(where))
            if out[name].count() != rows:
                raise ValueError(f"{name} of attempt {attempt} in {self.path} is not what was committed")
        return out
