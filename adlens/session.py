"""Session settings and the ways lineage is cut."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "adlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings come first."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(session: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only where none is named (tests, a laptop) it is one inside the warehouse. On a cluster a
    warehouse on the machine's own disk is refused: executors would not see each other's files.
    """
    context = session.sparkContext
    named = context.getCheckpointDir() or session.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = session.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/_adlens"


def durable(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from the files.

    For tables that several later steps read: the scan behind them runs once, a lost executor costs
    a re-read of the files, each step reads only the columns it needs, and the known file size lets
    the planner broadcast a table that is really small without shuffling the other side first.
    Tables of one session share one folder, which ``release`` removes when their results are used.
    """
    session = df.sparkSession
    path = f"{folder or tables_folder(session)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return session.read.schema(df.schema).parquet(path)


def tables_folder(session: SparkSession) -> str:
    """Where the tables of this application lie."""
    return f"{shared_folder(session)}/tables/{session.sparkContext.applicationId}"


def release(session: SparkSession, folder: str | None = None) -> None:
    """Remove the tables ``durable`` wrote for this application; results built on them end here."""
    path = session._jvm.org.apache.hadoop.fs.Path(folder or tables_folder(session))
    path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def checked(df: DataFrame) -> DataFrame:
    """Cut lineage through ``checkpoint()`` in the shared folder; Spark drops the files itself.

    For narrow tables inside loops, where the planner needs no file sizes.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
