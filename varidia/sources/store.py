"""A store of parsed read counts that is kept between runs and grows by sources.

Counts of a source (a VCF file or a folder of them) are a part, a folder of Parquet files sorted by (contig, pos), in BUCKETS
folders by contig; so a region reads one folder of each part and, by the row groups' ranges, the blocks that hold it. The manifest
names each part's source with its digest (path, length and time of change of its files). A source that is there already isn't
read again; one that has changed replaces its part. Each change writes the part first, then a new version of the manifest, and removes
what is no longer named; readers of the version before keep working until they end. One process at a time may write.
"""

from __future__ import annotations

import hashlib
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.counts import COUNTS
from ..operators.pileup import KEY, merge_records
from .readers import read_vcf

BUCKETS = 64
MANIFEST = "source string, digest string, part string, samples array<string>"


def _bucket(contig):
    return F.pmod(F.hash(contig), F.lit(BUCKETS)).cast("int")


class PileupStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def digest(self, source: str, rd_merge: str = "sum") -> str:
        jpath, fs = self._fs(source)
        if not fs.exists(jpath):
            raise FileNotFoundError(source)
        files, seen = fs.listFiles(jpath, True), [rd_merge]
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()

    def _versions(self) -> list[int]:
        jpath, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(jpath):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(jpath)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.path}/manifest/{n}/_SUCCESS")[0]))

    def entries(self) -> list:
        """The manifest, a row for each source."""
        found = self._versions()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{found[-1]}").collect() if found else []

    def _publish(self, rows: list[tuple]) -> None:
        """A new version of the manifest; parts that it doesn't name, and older versions, go."""
        found = self._versions()
        new = (found[-1] if found else 0) + 1
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{new}")
        named = {r[2] for r in rows}
        for folder, stale in (("manifest", lambda n: n != f"v{new}"), ("counts", lambda n: n.startswith("part=") and n[5:] not in named)):
            jpath, fs = self._fs(f"{self.path}/{folder}")
            for s in fs.listStatus(jpath) if fs.exists(jpath) else []:
                if stale(s.getPath().getName()):
                    fs.delete(s.getPath(), True)

    def _write(self, pileup: DataFrame) -> str:
        part = uuid4().hex
        rows = pileup.select(*KEY, *COUNTS, _bucket("contig").alias("bucket")).repartitionByRange("bucket", "contig", "pos").sortWithinPartitions("bucket", "contig", "pos")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/counts/part={part}")
        return part

    def add(self, source: str, rd_merge: str = "sum") -> bool:
        """Parse a source unless the store has it as it is now; returns whether it was read."""
        rows, digest = [tuple(r) for r in self.entries()], self.digest(source, rd_merge)
        if any(r[0] == source and r[1] == digest for r in rows):
            return False
        part = self._write(read_vcf(self.spark, source, rd_merge))
        samples = [r[0] for r in self._parts([part]).select("sample_id").distinct().orderBy("sample_id").collect()]
        self._publish([r for r in rows if r[0] != source] + [(source, digest, part, samples)])
        return True

    def _parts(self, parts: list[str]) -> DataFrame:
        paths = [f"{self.path}/counts/part={p}" for p in parts]
        return self.spark.read.option("basePath", f"{self.path}/counts").schema("sample_id string, contig string, pos long, a long, c long, g long, t long, part string, bucket int").parquet(*paths)

    def read(self, sources: list[str] | None = None, region: tuple[str, int, int] | None = None) -> DataFrame:
        """The pileup of some sources, or all; counts of a sample that several have are added up."""
        rows = [r for r in self.entries() if sources is None or r["source"] in sources]
        missing = set(sources or []) - {r["source"] for r in rows}
        if missing or not rows:
            raise ValueError(f"the store has no {', '.join(sorted(missing)) or 'source'}")
        df = self._parts([r["part"] for r in rows])
        if region:
            contig, start, end = region
            df = df.filter((F.col("bucket") == _bucket(F.lit(contig))) & (F.col("contig") == contig) & (F.col("pos") >= start) & (F.col("pos") < end))
        df = df.select(*KEY, *COUNTS)
        names = [s for r in rows for s in r["samples"]]
        return merge_records(df) if len(set(names)) < len(names) else df
