"""The first N items of every group, by statistics-guided skipping.

The rows are clustered into files by group and falling score, so that a row group's footer gives the groups it may hold and its highest score. Row groups
are read in falling order of that score, in two rounds. The first reads each group's best row group and all that hold the beginning of a group, whose
N-th score nobody knows before. Then the N-th score of every group that goes on in other row groups, in whatever file, is known, and what lies strictly
below it is skipped; the rest is read in falling order, the N-th score rising on the way. So a group with a third of all rows spreads over many files, of
which only the footers are read but for one row group, and what is left, at most N items of each group from each row group, is merged at last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.session import materialised, scratch

#: Bytes of a row group, the unit of skipping.
ROW_GROUP_BYTES = 1 << 20


def clustered(df: DataFrame, order: list[Column], path: str) -> DataFrame:
    """Writes df to files by its column g and order; (file) of each. Rows are spread by ranges, whose number follows their bytes, not by group alone."""
    by = [F.col("g"), *order]
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("file"))  # their contents aren't read


def _opened(uri: str):
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, path = pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
    return pq.ParquetFile(fs.open_input_file(path))


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files to their row groups: the number, the group if it holds a single one, else null, and its highest score."""
    for frame in frames:
        out = []
        for uri in frame["file"]:
            with _opened(uri) as file:
                at = {name: k for k, name in enumerate(file.schema_arrow.names)}
                for k in range(file.num_row_groups):
                    meta = file.metadata.row_group(k)
                    g, score = (meta.column(at[c]).statistics for c in ("g", "score"))
                    single = g is not None and g.has_min_max and g.min == g.max
                    out.append((uri, k, g.min if single else None, score.max if score is not None and score.has_min_max else math.inf))
        yield pd.DataFrame(out, columns=["file", "k", "only", "best"])


def _reader(columns: list[str], ties: list[str], n: int):
    """Row groups (file, k, only, best, nth), by file and falling best, to at most n items of each group from each; those below nth are passed over."""

    def leading(x: pd.DataFrame) -> pd.DataFrame:
        x = x.drop_duplicates(["g", "item"], keep="first")
        return x[x.groupby("g", sort=False).cumcount() < n]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, file = None, None
        held: dict[str, pd.DataFrame] = {}  # at most n rows of each group that is alone in its row groups
        for frame in frames:
            for row in frame.itertuples(index=False):
                nth = -math.inf if pd.isna(row.nth) else row.nth
                if row.only in held and len(held[row.only]) >= n:
                    nth = max(nth, float(held[row.only]["score"].iloc[n - 1]))
                if row.best < nth:
                    continue
                if row.file != uri:
                    if file is not None:
                        file.close()
                    uri, file = row.file, _opened(row.file)
                x = leading(file.read_row_group(int(row.k), columns=columns).to_pandas(integer_object_nulls=True)[columns])
                if not pd.isna(row.only):
                    both = pd.concat([held[row.only], x], ignore_index=True) if row.only in held else x
                    held[row.only] = leading(both.sort_values(["score", *ties, "item"], ascending=[False] + [True] * (len(ties) + 1), kind="stable", na_position="last"))
                if len(x):
                    yield x
        if file is not None:
            file.close()

    return run


def _placed(kept: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n items of each group, each item in its first place alone, however many row groups or files it came from."""
    once = kept.repartition("g").withColumn("_own", F.row_number().over(W.partitionBy("g", "item").orderBy(*order))).where("_own = 1").drop("_own")
    return once.withColumn("place", F.row_number().over(W.partitionBy("g").orderBy(*order))).where(F.col("place") <= n)


def rounds(x: DataFrame, order: list[Column], ties: list[str], n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what the first round leaves, the row groups, those of the second round) of rows with the columns g, score, the ties and item."""
    spark = x.sparkSession
    files = clustered(x, order, scratch(spark, "topn"))
    groups = materialised(files.mapInPandas(_footers, "file string, k int, only string, best double"), "rowgroups")
    falling = W.partitionBy("only").orderBy(F.desc("best"), "file", "k")
    groups = groups.withColumn("turn", F.when(F.col("only").isNull(), 1).otherwise(F.row_number().over(falling)))
    schema = ", ".join(f"{c} {t}" for c, t in x.dtypes)
    cores = spark.sparkContext.defaultParallelism
    read = lambda of: of.repartition(4 * cores, "file").sortWithinPartitions("file", F.desc("best"), "k").mapInPandas(_reader(x.columns, ties, n), schema)
    first = materialised(read(groups.where("turn = 1").select("file", "k", "only", "best", F.lit(None).cast("double").alias("nth"))), "leaders")
    more = groups.where("turn > 1")
    known = first.join(more.select(F.col("only").alias("_only")).distinct(), F.col("g") == F.col("_only"), "left_semi")
    nth = _placed(known, order, n).where(F.col("place") == n).select(F.col("g").alias("_g"), F.col("score").alias("nth"))
    second = more.join(nth, F.col("only") == F.col("_g"), "left").where("nth is null or best >= nth").select("file", "k", "only", "best", "nth")
    return first.unionByName(read(second)), groups, second


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], item: str, n: int, place: str = "place") -> DataFrame:
    """(groups, place, item): the first n items of every group, fewer if there are fewer: highest score first, then the ties rising, then the item.

    Rows with a null group or item, or a null or non-finite score, are no items. Repeated items (same group and item) count once, in their first place.
    A null tie comes after all others. Equal scores are never skipped, so the order is one and the same however the rows arrive. Times among the ties are
    compared in microseconds. Other columns are not read; an empty table gives no rows.
    """
    kinds = dict(df.dtypes)
    tie_columns = [(F.unix_micros(F.col(t)) if kinds[t] == "timestamp" else F.col(t)).alias(f"tie{k}") for k, t in enumerate(ties)]
    gs, ts = [f"g{k}" for k in range(len(groups))], [f"tie{k}" for k in range(len(ties))]
    x = df.select(*[F.col(g).alias(a) for g, a in zip(groups, gs, strict=True)], F.col(score).cast("double").alias("score"), *tie_columns, F.col(item).alias("item"))
    x = x.where(" and ".join(f"{g} is not null" for g in gs) + " and item is not null and score is not null and not isnan(score) and abs(score) < double('inf')")
    x = x.withColumn("score", F.col("score") + 0.0)  # one zero
    # one text for the group, its parts told apart by their lengths, whose least and greatest a footer gives
    x = x.withColumn("g", F.concat_ws("", *[part for g in gs for part in (F.length(F.col(g).cast("string")).cast("string"), F.lit(":"), F.col(g).cast("string"))]))
    order = [F.desc("score"), *[F.asc_nulls_last(t) for t in ts], F.asc("item")]
    kept, _, _ = rounds(x, order, ts, n)
    ranked = _placed(kept, order, n)
    return ranked.select(*[F.col(a).alias(g) for a, g in zip(gs, groups, strict=True)], F.col("place").alias(place), F.col("item").alias(item))
