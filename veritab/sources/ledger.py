"""Result ledger with idempotent insert (A9, ST2)."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = (
    "real_path string, fake_path string, real_size bigint, fake_size bigint, score double, metric string, "
    "scorer string, tag string, bins double, model_name string, target_name string"
)
LEDGER_COLUMNS = [part.split()[0] for part in LEDGER_SCHEMA.split(", ")]
MODEL_KEY = ["fake_path", "metric", "scorer", "model_name", "target_name", "fake_size"]
BINS_KEY = ["fake_path", "metric", "bins", "fake_size"]


def conform(rows: DataFrame) -> DataFrame:
    """Ledger columns in ledger order and type; absent ones become NULL."""
    types = dict(part.split() for part in LEDGER_SCHEMA.split(", "))
    return rows.select(
        [
            (F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c)
            for c in LEDGER_COLUMNS
        ]
    )


def existing_rows(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """New rows whose result is already in the ledger, by the key their metric uses."""
    rows = conform(rows)

    def known(part: DataFrame, keys: list[str]) -> DataFrame:
        other = ledger.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        match = F.lit(True)
        for k in keys:
            match = match & part[k].eqNullSafe(other[f"__{k}"])
        return part.join(other, match, "left_semi")

    with_model = rows.filter(F.col("metric") == "efficacy_test")
    with_bins = rows.filter(F.col("metric") != "efficacy_test")
    return known(with_model, MODEL_KEY).unionByName(known(with_bins, BINS_KEY))


def upsert(ledger: DataFrame, rows: DataFrame, overwrite: bool = False) -> DataFrame:
    """Ledger plus new rows without exact copies; refuses known results unless told otherwise."""
    return conform(ledger).distinct().unionByName(new_rows(ledger, rows, overwrite))


def new_rows(ledger: DataFrame, rows: DataFrame, overwrite: bool = False) -> DataFrame:
    """The distinct rows that the ledger lacks."""
    rows = conform(rows)
    if not overwrite:
        known = existing_rows(ledger, rows).limit(1).collect()
        if known:
            raise ValueError(f"result already recorded: {known[0].asDict()}")
    return rows.subtract(conform(ledger))


# ------------------------------------------------------------------------- storage
# <path>/rows/<part>/        parquet parts, never changed
# <path>/commits/<number>    one small file each: the parts it adds, or all parts if it is a compaction
@dataclass
class _Folder:
    """Hadoop's file calls on one ledger; commits appear under their name complete or not at all."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.jvm = self.spark.sparkContext._jvm
        self.conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def commits(self) -> list[int]:
        folder = self.at("commits")
        if not self.files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self.files.listStatus(folder)]
        return sorted(int(name) for name in names if name.isdigit())

    def read(self, number: int) -> dict:
        lines = self.spark.read.text(f"{self.path}/commits/{number:09d}", wholetext=True).first()
        return json.loads(lines[0])

    def publish(self, number: int, content: dict) -> bool:
        """False if another writer took the number."""
        self.files.mkdirs(self.at("commits"))
        draft = self.at(f"drafts/{uuid.uuid4().hex}")
        stream = self.files.create(draft, True)
        stream.write(json.dumps(content).encode())
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf)
        gateway = self.spark.sparkContext._gateway
        qualified = [self.files.makeQualified(p) for p in (draft, self.at(f"commits/{number:09d}"))]
        try:
            context.rename(*qualified, gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            self.files.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True

    def parts(self) -> tuple[int, list[str]]:
        """The next number and the parts that make up the ledger now."""
        numbers, found = self.commits(), []
        for number in reversed(numbers):
            content = self.read(number)
            found = [*content["parts"], *found]
            if content["whole"]:
                break
        return (numbers[-1] + 1 if numbers else 0), found


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, _Folder(spark, path).parts()[1])


def _rows(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return conform(spark.read.schema(LEDGER_SCHEMA).parquet(*[f"{path}/rows/{part}" for part in parts]))


def save_results(spark: SparkSession, path: str, rows: DataFrame, overwrite: bool = False) -> None:
    """Append what the ledger lacks; readers see it once its commit is there.

    Only new rows are written.  A writer that finds its number taken looks at the ledger
    again, so rows that two writers bring at once are recorded once, or refused.
    """
    folder = _Folder(spark, path)
    while True:
        number, parts = folder.parts()
        part = uuid.uuid4().hex
        new_rows(_rows(spark, path, parts), rows, overwrite).write.parquet(f"{path}/rows/{part}")
        written = spark.read.schema(LEDGER_SCHEMA).parquet(f"{path}/rows/{part}")
        if not written.isEmpty() and not folder.publish(number, {"whole": False, "parts": [part]}):
            folder.files.delete(folder.at(f"rows/{part}"), True)
            continue
        return


def compact_ledger(spark: SparkSession, path: str) -> bool:
    """Write the ledger as one part; earlier parts stay for readers that hold them.  False if a writer came first."""
    folder = _Folder(spark, path)
    number, parts = folder.parts()
    if len(parts) < 2:
        return True
    part = uuid.uuid4().hex
    _rows(spark, path, parts).write.parquet(f"{path}/rows/{part}")
    return folder.publish(number, {"whole": True, "parts": [part]})
