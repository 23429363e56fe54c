"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it a job of one machine (a local master,
    as in tests) gets a folder of its own; on a cluster there is none that all could see."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def written(df: DataFrame, *, compression: str = "zstd") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmark-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hands memory that is free within this process back to the system, as far as the C library does so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of a batch's texts that are worked on together.
AT_ONCE = 8 << 20


def pieces_of(texts: pa.Array, size: int | None = None) -> Iterator[pa.Array]:
    """Slices of the texts of about `size` bytes each; a longer text is alone. Memory for them is given back after each."""
    size = AT_ONCE if size is None else size
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(at, to - at)
        pa.default_memory_pool().release_unused()
        at = to


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole groups of a partition that is sorted by keys, with their `starts` and `ends`; a group that
    runs on into the next batch is carried over, so memory holds a batch and a group."""
    held: pa.Table | None = None

    def out(table: pa.Table, starts: np.ndarray, n: int) -> dict[str, np.ndarray]:
        columns = {c: table[c].to_numpy()[:n] for c in table.column_names}
        return columns | {"starts": starts, "ends": np.append(starts[1:], n)}

    def parts() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * AT_ONCE // max(1, batch.nbytes))
            yield from (batch.slice(i, step) for i in range(0, batch.num_rows, step))

    for batch in parts():
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for key in keys:
            column = table[key].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        last = int(starts[-1])
        if len(starts) > 1:
            yield out(table, starts[:-1], last)
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield out(held, np.zeros(1, np.int64), held.num_rows)


#: Rows of a key that stay together in a spread join at least, and bound on the keys that are dealt out.
SPREAD = 256
HOT_KEYS = 2000


def spread_join(rows: DataFrame, key: str, groups: DataFrame, size: str, total: int | None = None) -> DataFrame:
    """Inner join of rows with the one row that each key has in groups, which says in `size` how many rows have the key.
    Keys of more than a 2000th of all rows, of which there can't be more than HOT_KEYS, are broadcast and dealt out to
    parts; their row in groups is repeated for each part. The column `size` is dropped. total: all rows, if known."""
    total = groups.agg(F.sum(size)).first()[0] or 0 if total is None else total
    limit = max(SPREAD, -(-total // HOT_KEYS))
    parts = F.when(F.col(size) > limit, F.ceil(F.col(size) / limit)).otherwise(F.lit(1).cast("long"))
    hot = groups.where(F.col(size) > limit).select(F.col(key), parts.alias("parts_"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("part_", F.pmod(F.xxhash64(*rows.columns), F.coalesce("parts_", F.lit(1)))).drop("parts_")
    return dealt.join(groups.withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(size), [key, "part_"]).drop("part_")


def edges_to_components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    edges: two long columns a, b (a <> b). Returns node, component: for each node of an edge the smallest
    reachable node. Every step is a partial minimum and an equi join that deals out the neighbours of a hub, so a hub
    with very many neighbours is never gathered in one task; each round is written to the shared folder.
    """

    def pairs(df: DataFrame) -> DataFrame:
        """Directed both ways."""
        return df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(directed: DataFrame, rows: int, keep_larger: bool) -> DataFrame:
        """Neighbours a of hub b; each is linked to the smallest of the hub and its neighbours."""
        least = directed.groupBy("b").agg(F.least(F.min("a"), F.col("b")).alias("least"), F.count("*").alias("n"))
        joined = spread_join(directed, "b", least, "n", rows)
        if keep_larger:
            linked = joined.where("a > b").select("a", F.col("least").alias("b"))
        else:
            linked = joined.select("a", F.col("least").alias("b")).union(least.select("b", "least"))
        return linked.where("a <> b").distinct()

    def measured(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The rows, written, and what tells two sets of them apart, which is counted while they are written."""
        seen = Observation()
        rows = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hash")))
        return rows, (seen.get["n"], seen.get["hash"])

    # A star reads its links several times, so both are written: a plan of two stars would hold the first one three times
    # over, and what the driver keeps of plans and their tasks adds up over the rounds.
    current, before = measured(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        rows = 2 * before[0]  # a star has at most as many links as it was made of
        large = written(star(pairs(current), rows, keep_larger=True))
        down = large.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        nxt, now = measured(star(down, rows, keep_larger=False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        if now == before:
            break
        before, current = now, nxt
    roots = nxt.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nxt.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
