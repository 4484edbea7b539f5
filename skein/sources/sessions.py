"""Session folders: (session_id, directory, is_dir, created_at)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.content import utc_text, uuid7_millis

SCHEMA = "session_id string, directory string, is_dir boolean, created_at double"


def scan_sessions(spark: SparkSession, root: str) -> DataFrame:
    """What lies in root/sessions; a missing folder has no rows. A listing on the driver: names only, no contents."""
    top = os.path.join(root, "sessions")
    rows = []
    if os.path.isdir(top):
        with os.scandir(top) as entries:
            rows = [(e.name, e.path, e.is_dir(), e.stat().st_ctime) for e in entries]
    return spark.createDataFrame(rows, SCHEMA)


def list_sessions(sessions: DataFrame) -> DataFrame:
    """Folders only, by id; ids that are no time-ordered UUID stay, and sort with them. The shown time is not the key."""
    rows = sessions.where("is_dir").select("session_id", "directory", utc_text(F.col("created_at")).alias("created"), uuid7_millis(F.col("session_id")).alias("id_millis"))
    return rows.orderBy("session_id")


def resumable(asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """Those asked-for ids whose folder is there, whether or not it has a history."""
    return asked.join(sessions.where("is_dir"), "session_id", "left_semi")


def paths(ids: DataFrame, root: str) -> DataFrame:
    """The folder of each session below root, and its store."""
    folder = F.concat_ws("/", F.lit(root.rstrip("/")), F.lit("sessions"), "session_id")
    return ids.select("session_id", folder.alias("directory"), F.concat_ws("/", folder, F.lit("checkpoints.sqlite")).alias("store"))
