"""Helpers shared by the training-data operators: shared scratch tables, folds, text units.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of white space between words: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a regular expression (one or more), for Spark's Java regexes and DuckDB's RE2.
SPACES_RE = r"[\x20\x09-\x0D]+"

_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this session inside the shared folder that ``spark.checkpoint.dir`` names.

    Only where the setting is absent and the master is local (as in tests) a local temporary folder is made;
    on a cluster without the setting this raises, because executors would not see such a folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
        _SCRATCH[app] = f"{base.rstrip('/')}/ragbench-{uuid.uuid4().hex}"
    return _SCRATCH[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path that no other table has, in the shared folder."""
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write the table to the shared folder and read it back.

    This cuts the lineage (a lost executor re-reads files, it does not recompute) and gives Catalyst the
    table's true size, so that a later join picks its strategy from a measured figure.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_scratch(spark: SparkSession) -> None:
    """Delete what this session has written to the shared folder; call it once results are consumed."""
    base = _SCRATCH.pop(spark.sparkContext.applicationId, None)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True for rows whose crc32(doc_id as text) mod 5 is 0; these are never learned from. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Columns:
    """A table's columns under numbered names, so that no name of an operator's own can clash with one of the table's.

    ``rows`` has the columns c0, c1, ...; ``name(x)`` is the numbered name of column x, and ``done`` gives a result its
    columns' own names back.
    """

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.rows = docs.toDF(*(f"c{k}" for k in range(len(self.names))))

    def name(self, column: str) -> str:
        at = [k for k, x in enumerate(self.names) if x == column] or [k for k, x in enumerate(self.names) if x.lower() == column.lower()]
        if not at:
            raise ValueError(f"no column {column} among {', '.join(self.names)}")
        return f"c{at[0]}"

    def done(self, rows: DataFrame, outputs: dict[str, Column | str] | None = None, changed: dict[str, Column] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
        """The table's columns, some ``changed`` (by numbered name), and the outputs in the place of columns that have their names.

        Letter case aside, as Spark compares names. Values come before names, in a select of their own: names of the
        table in the same select could be taken for columns that the values read.
        """
        outputs = outputs or {}
        gone = {x.lower() for x in (*outputs, *without)}
        kept = {f"c{k}": x for k, x in enumerate(self.names) if x.lower() not in gone}
        values = [(changed or {}).get(c, F.col(c)).alias(c) for c in kept]
        made = [(F.col(v) if isinstance(v, str) else v).alias(f"out{k}") for k, v in enumerate(outputs.values())]
        named = rows.select(*values, *made)
        return named.select(*(F.col(c).alias(x) for c, x in kept.items()), *(F.col(f"out{k}").alias(x) for k, x in enumerate(outputs)))
