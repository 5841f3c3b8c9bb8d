"""Splits and rebalancing (R1–R5) with seeded, plan-independent draws.

Every draw is ``md5(seed|key)`` (see ``seeded_hash``), so a row's fate does
not depend on partitioning. The smallest hashes are found by a cut in their
histogram, so a split or an undersample is a filter: nothing is sorted."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.functions.expressions import seeded_hash, seeded_uniform
from wearline.operators.knn import knn_join
from wearline.operators.selection import class_counts, flag_smallest
from wearline.schema import UNIT
from wearline.session import ensure_checkpoint_dir, stored


def distinct_units(df: DataFrame, unit_col: str = UNIT) -> DataFrame:
    """Sorted."""
    return df.select(unit_col).distinct().orderBy(unit_col)


def validation_units(df: DataFrame, val_size: float = 0.2, seed: int = 42,
                     unit_col: str = UNIT) -> DataFrame:
    """``max(1, int(n_units * val_size))`` whole units, chosen by the
    smallest seeded hashes (ties by unit; a null unit has hash 0)."""
    units = df.select(unit_col).distinct()
    take = lambda counts: {None: max(1, int(counts.get(None, 0) * val_size))}
    marked = flag_smallest(units, F.coalesce(seeded_hash(seed, unit_col), F.lit(0)), [unit_col], take, None, "_val")
    return marked.filter("_val").select(unit_col)


def unit_split(df: DataFrame, val_size: float = 0.2, seed: int = 42, unit_col: str = UNIT):
    """(train, val): a semi join and an anti join on the chosen units;
    disjoint and exhaustive."""
    val_units = validation_units(df, val_size, seed, unit_col)
    return (df.join(val_units, unit_col, "left_anti"), df.join(val_units, unit_col, "left_semi"))


def row_split(df: DataFrame, keys: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """R2: ``ceil(n * test_size)`` rows with the smallest seeded hashes are
    'test', the rest 'train' (adds ``split``). The cut comes from a histogram
    of the hashes; no row moves."""
    take = lambda counts: {None: int(math.ceil(counts.get(None, 0) * test_size))}
    r = flag_smallest(df, F.coalesce(seeded_hash(seed, *keys), F.lit(0)), keys, take, None, "_test")
    return r.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with a number of its own for every row, by the order of ``keys``:
    an id for rows whose key has several columns. Rows are sorted by ranges and
    numbered where they lie, after those of the ranges before."""
    ensure_checkpoint_dir(df.sparkSession)
    base = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(2 ** 33 - 1)))   # the row in its partition
            .checkpoint(eager=True))
    rows = dict(base.groupBy("_pid").count().collect())
    before, last = [0], max(rows, default=0)
    for i in range(last):
        before.append(before[-1] + rows.get(i, 0))
    start = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in before]), F.col("_pid") + 1)
    return base.select(*df.columns, (start + F.col("_at") + 1).alias(name))


def undersample(df: DataFrame, label: str, keys: list[str], seed: int = 42) -> DataFrame:
    """Every class down to the minority count, without replacement: the
    rows of each class with the smallest seeded hashes, by a cut per class."""
    take = lambda counts: dict.fromkeys(counts, min(counts.values(), default=0))
    r = flag_smallest(df, F.coalesce(seeded_hash(seed, *keys), F.lit(0)), keys, take, label, "_kept")
    return r.filter("_kept").drop("_kept")


def smote(df: DataFrame, label: str, id_col: str, vec_col: str, k: int = 5, seed: int = 42,
          minority=None) -> DataFrame:
    """Adds ``n_maj - n_min`` synthetic minority rows. Synthetic row j
    takes base row ``#(hash(j) mod n_min)`` of the minority (ordered by
    id), one of the base's k nearest minority neighbours
    (``hash'(j) mod k``) and a gap ``u(j)`` in [0, 1):
    ``base + gap * (neighbour - base)``. Returns the synthetic rows
    ``(syn_id, base_id, neighbor_id, gap, <vec_col>, <label>)``."""
    spark = df.sparkSession
    counts = class_counts(df, label)
    if len(counts) < 2:
        return spark.createDataFrame([], f"syn_id bigint, base_id bigint, neighbor_id bigint, gap double, "
                                         f"{vec_col} array<double>, {label} bigint")
    if minority is None:
        minority = min(counts, key=lambda c: (counts[c], c))
    n_min = counts[minority]
    n_maj = max(v for c, v in counts.items() if c != minority)
    n_syn = n_maj - n_min
    kk = min(k, n_min - 1)
    if kk < 1:
        raise ValueError(f"SMOTE needs two rows of class {minority} at least; there is {n_min}")
    mino = df.filter(F.col(label) == minority).select(F.col(id_col).cast("bigint").alias(id_col), vec_col)
    idx = numbered(mino.select(id_col), [id_col], "_b").withColumnRenamed(id_col, "base_id")
    nn = knn_join(mino, mino, kk, id_col, vec_col, exclude_self=True)
    syn = spark.range(n_syn).select(
        F.col("id").alias("syn_id"),
        (F.pmod(seeded_hash(seed, F.lit("b"), "id"), F.lit(n_min)) + 1).alias("_b"),
        (F.pmod(seeded_hash(seed, F.lit("n"), "id"), F.lit(kk)) + 1).alias("_r"),
        seeded_uniform(seed, F.lit("g"), "id").alias("gap"))
    base_vec = mino.select(F.col(id_col).alias("base_id"), F.col(vec_col).alias("_bv"))
    nb_vec = mino.select(F.col(id_col).alias("neighbor_id"), F.col(vec_col).alias("_nv"))
    j = (syn.join(idx, "_b")
         .join(nn.select(F.col("q_id").alias("base_id"), F.col("rank").alias("_r"), F.col("s_id").alias("neighbor_id")),
               ["base_id", "_r"])
         .join(base_vec, "base_id").join(nb_vec, "neighbor_id"))
    new = F.zip_with("_bv", "_nv", lambda b, n: b + F.col("gap") * (n - b))
    return j.select("syn_id", "base_id", "neighbor_id", "gap", new.alias(vec_col),
                    F.lit(minority).cast("bigint").alias(label))


def rebalance_counts(df: DataFrame, label: str, id_col: str, vec_col: str, keys: list[str],
                     seed: int = 42) -> DataFrame:
    """Class counts (and weight sums) after each method:
    none | undersample | smote | cost_sensitive."""
    from wearline.operators.metrics import class_weights
    spark = df.sparkSession
    # every method reads the rows several times; numbering them costs a sort of all
    df = stored(df.select(*dict.fromkeys([label, id_col, vec_col, *keys])), "rebalance")
    rows = []
    for c, n in class_counts(df, label).items():
        rows.append(("none", int(c), int(n), float(n)))
    for c, n in class_counts(undersample(df, label, keys, seed), label).items():
        rows.append(("undersample", int(c), int(n), float(n)))
    syn = smote(df, label, id_col, vec_col, seed=seed)
    sm = df.select(label).unionByName(syn.select(label))
    for c, n in class_counts(sm, label).items():
        rows.append(("smote", int(c), int(n), float(n)))
    for r in class_weights(df, label).collect():
        rows.append(("cost_sensitive", int(r[label]), int(r["count"]), float(r["weight"] * r["count"])))
    return spark.createDataFrame(rows, f"method string, {label} bigint, count bigint, weight_sum double")
