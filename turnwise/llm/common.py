"""What the text operators share: folds by id, Arrow batches over whole rows, numbering at scale."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.session import materialise  # noqa: F401  (re-exported for the operators)

#: Rows and bytes of an Arrow batch; together they bound what a Python worker holds of its input.
BATCH_ROWS = 1000
BATCH_BYTES = 64 << 20
#: Rows of a table are numbered in stretches of 2 to this power.
RUN_BITS = 18

#: ASCII capitals to small letters, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with every ASCII byte outside letters and digits made a space.
LOWER_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, and ships this package to the workers; called before every Python stage."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the workers of this application the package's source, once, whatever folders they can see."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(dir=SparkFiles.getRootDirectory())) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_found(
    df: DataFrame, make: Callable[[], Callable[[pa.StructArray], pa.Array]], found: T.DataType | str
) -> DataFrame:
    """Adds what Python finds in each row: columns ``row`` (a struct of the input) and ``found``.

    ``make`` runs once per task and returns the function of a batch. Input columns stay inside
    ``row``, so their names never clash with results. One narrow stage, no shuffle.
    """
    bounded_batches(df.sparkSession)
    kind = T.DataType.fromDDL(found) if isinstance(found, str) else found
    packed = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"))
    schema = T.StructType([packed.schema["row"], T.StructField("found", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                row = batch.column(0)
                yield pa.RecordBatch.from_arrays([row, work(row)], ["row", "found"])

    return packed.mapInArrow(run, schema)


def unpacked(df: DataFrame, **added: Column) -> DataFrame:
    """The rows of ``with_found`` as plain columns again, with the given ones added."""
    names = [f.name for f in df.schema["row"].dataType.fields]
    kept = [F.col("row")[n].alias(n) for n in names if n not in added]
    return df.select(*kept, *[c.alias(n) for n, c in added.items()])


def texts_of(row: pa.StructArray, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column of a batch; missing texts are empty."""
    values = row.field(row.type.get_field_index(column))
    if row.null_count:
        values = pa.array(values.to_pylist(), pa.string())
    if not pa.types.is_string(values.type) and not pa.types.is_large_string(values.type):
        values = values.cast(pa.string())
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


def located(table: DataFrame) -> DataFrame:
    """A written table with the place of each row: ``_run`` (its file and stretch of rows there) and ``_at``.

    Places belong to the files, so they are the same in every pass and after a lost executor.
    """
    at, file = F.col("_metadata.row_index"), F.col("_metadata.file_path")
    return table.select("*", F.xxhash64(file, F.shiftright(at, RUN_BITS)).alias("_run"), at.alias("_at"))


def number_within(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 inside each key, for rows that come from a ``located`` table once each.

    A key's rows are cut by the stretch of the table that they stand in, whatever they hold, so neither
    a hot key nor rows that are all equal meet in one task. A stretch is numbered by a window; the totals
    of the key's earlier stretches are added. Window and join share one exchange.
    """
    totals = df.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                            F.col("_run").alias("_r"), before.alias("_before"))
    local = F.row_number().over(W.partitionBy(*keys, "_run").orderBy("_at"))
    numbered = df.withColumn("_local", local)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = numbered.join(offsets, [*same, F.col("_run") == F.col("_r")])
    kept = [c for c in df.columns if c not in ("_run", "_at")]
    return joined.select(*kept, (F.col("_before") + F.col("_local") - 1).cast("long").alias(name))
