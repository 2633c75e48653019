"""Table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Frames stored once per application, by (application, name, folder).
_ONCE: dict[tuple[str, ...], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``; the scan is pruned by whoever selects from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session without that setting (a local test run) gets a folder of its own, which goes with the process.
    """
    conf = spark.sparkContext.getConf()
    given = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return "file://" + _LOCAL[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: str, sf_dir: str, make) -> DataFrame:
    """``make()`` stored under ``name`` for the tables in ``sf_dir``, the first time it is asked for in this application."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _ONCE:
        _ONCE[key] = materialize(make(), name)
    return _ONCE[key]


def release(spark: SparkSession) -> None:
    """Removes everything that ``materialize`` and the streams of this application have stored. Frames built on it are void
    afterwards, so it is for the end of a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(app_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _ONCE if k[0] == spark.sparkContext.applicationId]:
        del _ONCE[key]


def app_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared folder."""
    return f"{shared_dir(spark)}/graphloom-" + re.sub(r"\W", "_", spark.sparkContext.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly, by turns, if it has fewer partitions than there are cores.

    For what follows as Python over whole texts: a table of a few small files would keep most cores idle, and the texts
    are cheaper to move than to parse. Tables with enough partitions stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(2 * cores)


def trimmed(col):
    """``col`` without blanks (any white space, no-break space, byte-order mark) on either side."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"^[\s\p{Z}﻿]+|[\s\p{Z}﻿]+$", "")


def clean_id(col):
    """An id as it is compared: no blanks around it, and no leading run of ``.`` and ``/`` in the path of ``file:<path>``."""
    return F.regexp_replace(trimmed(col), r"^file:[./]+", "file:")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
