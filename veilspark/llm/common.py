"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir, or the one that the session has been given.  Where neither is set, one is
    made if all runs in one process (tests); on a cluster that is an error, as a folder of one machine would not do."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared checkpoint folder and go on from there: survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: While it holds, what is run removes its shuffle files when it is done.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise_alone(df: DataFrame) -> DataFrame:
    """materialise, and remove the shuffle files that df came from as soon as it is written.

    Otherwise they stay until the driver happens to collect its garbage.  If df is run again, it makes them anew, and so
    do frames that another thread makes in this session meanwhile.
    """
    ensure_checkpoint_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(_RELEASE, None)
    conf.set(_RELEASE, "true")
    try:
        return df.select("*").checkpoint()  # the setting holds for frames made after it
    finally:
        if before is None:
            conf.unset(_RELEASE)
        else:
            conf.set(_RELEASE, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that df does not have (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Hashes are compared with a share of this many values.
SPOTS = 1 << 62


def bounded_sample(df: DataFrame, label: Column, name: Column, counts: dict, most: int) -> DataFrame:
    """Of each label at most `most` rows of df, those whose hash of `name` is smallest; adds label_ and spot_.

    counts: the rows of each label.  Names may repeat or be null; however many rows share a hash, no more than `most`
    come through.  A first cut at twice the expected share keeps what is sorted small; its chance to leave fewer than
    `most` rows although there are more is negligible for a few hundred and above.
    """
    lab, spot, place = "label_", "spot_", "place_"
    near = F.lit(False)
    for x, n in counts.items():
        near = near | ((F.col(lab) == F.lit(x)) & (F.col(spot) < F.lit(min(SPOTS, SPOTS * 2 * most // n))))
    marked = df.withColumn(lab, label).withColumn(spot, F.xxhash64(name).bitwiseAND(F.lit(SPOTS - 1))).where(near)
    ranked = marked.withColumn(place, F.row_number().over(Window.partitionBy(lab).orderBy(spot, name)))
    return ranked.where(F.col(place) <= most).drop(place)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keep_named(df: DataFrame, name: Column, names: DataFrame, text_col: str) -> DataFrame:
    """Of df's rows whose name (a string) is in names (one column, distinct) one each, the one of the smallest text."""
    own, kept, place = fresh(df, "name_", "kept_", "place_")
    there = df.withColumn(own, name).join(names.toDF(kept), F.col(own) == F.col(kept), "left_semi")
    return there.withColumn(place, F.row_number().over(Window.partitionBy(own).orderBy(col(text_col)))).where(F.col(place) == 1).drop(own, place)
