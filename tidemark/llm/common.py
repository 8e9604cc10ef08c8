"""Shared plumbing of the training-data operators: table access, durable cuts, row numbering."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.plans import tables
from tidemark.plans.tables import deleted, owned, saved, scratch, table

__all__ = ["ascii_lower", "deleted", "dropped", "dropped_but", "fresh", "numbered", "owned", "saved", "scratch", "staged", "table", "tidied", "words_of"]

#: The white space of the word contracts: space and the controls from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"


def tops_of(df: DataFrame) -> set[str]:
    return {f[: f.rindex("/")].rsplit("/", 1)[-1] for f in df.inputFiles()}


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by saved(), once nothing reads it any more."""
    for top in {f[: f.rindex("/")] for f in df.inputFiles()}:
        deleted(df.sparkSession, top)


def dropped_but(spark: SparkSession, *kept: DataFrame) -> None:
    """In a pipeline stage: deletes the tables that it has saved so far, but for those that ``kept`` read."""
    paths, names = tables.owner() or [], set().union(*map(tops_of, kept))
    for path in [p for p in paths if p.rsplit("/", 1)[-1] not in names]:
        deleted(spark, path)
        paths.remove(path)


#: (path, weak references to Spark's index of its files) of tables that results of stages read.
_left: list[tuple[str, list]] = []


def left_to(spark: SparkSession, out: DataFrame, paths: list[str]) -> None:
    """Tables that a result reads go once nothing can read them any more: when Spark's index of their files, which every
    plan over them refers to, is garbage, as Spark's own cleaner does it for shuffles. Those it doesn't read go now."""
    leaves, refs = out._jdf.queryExecution().analyzed().collectLeaves(), {}
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            place = leaf.relation().location()
            refs.setdefault(place.rootPaths().head().getName(), []).append(spark.sparkContext._jvm.java.lang.ref.WeakReference(place))
    for path in paths:
        _left.append((path, refs.get(path.rsplit("/", 1)[-1], [])))
    swept(spark)


def swept(spark: SparkSession) -> None:
    for item in [x for x in _left if all(ref.refersTo(None) for ref in x[1])]:
        deleted(spark, item[0])
        _left.remove(item)


def staged(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A pipeline stage: it owns the tables that it saves and deletes those that its result doesn't read. The others
    stay as long as the result, or what was made of it, can be read; or they go with the owner around the stage."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        swept(spark)
        with owned() as paths:
            out = stage(spark, docs, sf_dir)
        if tables.owner() is None:
            left_to(spark, out, paths)
        return out

    return run


def tidied(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that deletes the tables it has saved, but for those that its result reads. These stay, or go with the owner
    around the query: ``with owned(spark): query(spark, sf_dir).write...`` leaves none."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with owned():
            out = query(spark, sf_dir)
            dropped_but(spark, out)
        return out

    return run


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Maximal runs without blanks; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, one for each wanted name."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, group: str, order: list[Column], name: str, pieces: int, piece_of: Column) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... within each value of ``group``, without one task for a group.

    ``piece_of`` deals a group's rows to 0..pieces-1; rows are ranked inside (group, piece), and a table of
    pieces' sizes (groups x pieces rows, one for each combination that occurs) gives each piece its offset.
    """
    piece, size, base, rank = fresh(df, "piece", "piece_size", "piece_base", "piece_rank")
    dealt = df.withColumn(piece, piece_of)
    sizes = dealt.groupBy(group, piece).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col(group), F.col(piece), F.coalesce(F.sum(size).over(before), F.lit(0)).alias(base))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(group, piece).orderBy(*order)) - 1)
    return (
        ranked.join(bases, [group, piece], "left")
        .withColumn(name, (F.col(rank) + F.col(base)).cast(T.LongType()))
        .drop(piece, base, rank)
    )
