"""Loading: snapshots in, snapshots out. Nothing is changed in place, so a lost run is run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """Rows of ``current`` replaced by those of ``incoming`` with equal keys (nulls equal), others kept;
    of several incoming rows of a key the one with the largest ``newest`` wins."""
    marked = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("__new")] + ([F.desc_nulls_last(newest)] if newest else [])
    return marked.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n", "__new")


def upsert_coalesce(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """As an upsert, but a null of the incoming row never erases a value."""
    columns = [c for c in current.columns if c not in keys]
    a, b = current.alias("a"), incoming.alias("b")
    condition = None
    for k in keys:
        test = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        condition = test if condition is None else condition & test
    joined = a.join(b, condition, "full_outer")
    return joined.select(*(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in [*keys, *columns]))


def insert_ignore(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``incoming`` rows whose keys (nulls equal) are new, once each, behind ``current``."""
    fresh = incoming.dropDuplicates(keys).alias("b")
    condition = None
    for k in keys:
        test = F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}"))
        condition = test if condition is None else condition & test
    return current.unionByName(fresh.join(current.select(*keys).distinct().alias("a"), condition, "left_anti").select(*current.columns))


def replace_edges(current: DataFrame, incoming: DataFrame, owner: str) -> DataFrame:
    """All edges of the owners in ``incoming`` replaced by theirs."""
    return current.join(incoming.select(owner).distinct(), owner, "left_anti").select(*current.columns).unionByName(incoming.select(*current.columns))


def cascade_delete(parents: DataFrame, children: list[tuple[DataFrame, str]], key: str, doomed: Column) -> tuple[DataFrame, list[DataFrame]]:
    """The parents that stay, and the rows of each child table whose reference stays."""
    gone = parents.where(doomed).select(key)
    kept = parents.where(~F.coalesce(doomed, F.lit(False)))
    return kept, [child.join(gone.withColumnRenamed(key, reference), reference, "left_anti").select(*child.columns) for child, reference in children]


def soft_delete(rows: DataFrame, doomed: Column, now: Column) -> DataFrame:
    """Rows with ``deleted_at`` set where they are doomed and not deleted yet."""
    return rows.withColumn("deleted_at", F.when(doomed & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at")))


def quarantine(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows carry ``reasons``, the names of all checks they fail (null fails)."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items())))
    judged = rows.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def full_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, columns): rows that are missing, added or changed, and which columns differ."""
    columns = [c for c in old.columns if c != key]
    a, b = old.withColumn("__old", F.lit(True)).alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    differing = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)))
    change = F.when(F.col("b.__new").isNull(), "missing").when(F.col("a.__old").isNull(), "added").when(F.size(differing) > 0, "changed")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"), F.when(change == "changed", F.array_join(differing, ",")).otherwise("").alias("columns")).where(F.col("change").isNotNull())


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose ``key`` stands in ``keys``; a null key is never deleted."""
    return rows.join(keys.select(key).distinct(), key, "left_anti").select(*rows.columns)


def resolve_status(rows: DataFrame, statuses: DataFrame | None, key: str, default: str | None = None) -> DataFrame:
    """``rows`` with the ``status`` of their ``key`` in ``statuses`` (key, status), and whether it was
    ``assumed``: the default where there is none. Without statuses and default nothing is known: an error."""
    if statuses is None and default is None:
        raise ValueError("a status source or a default status is needed")
    bare = rows.drop("status", "assumed")
    known = bare.withColumn("__s", F.lit(None).cast("string")) if statuses is None else bare.join(statuses.groupBy(key).agg(F.min("status").alias("__s")), key, "left")
    return known.select(*bare.columns, F.coalesce("__s", F.lit(default)).alias("status"), F.col("__s").isNull().alias("assumed"))


def pending_migrations(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """(version, name, digest, state) of migrations: ``pending`` where the ledger lacks the version,
    ``changed`` where it holds another digest, and ``unknown`` where only the ledger has it."""
    a, b = wanted.alias("a"), ledger.alias("b")
    joined = a.join(b, F.col("a.version") == F.col("b.version"), "full_outer")
    state = F.when(F.col("b.version").isNull(), "pending").when(F.col("a.version").isNull(), "unknown").when(F.col("a.digest") != F.col("b.digest"), "changed")
    return joined.select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("version", "name", "digest")), state.alias("state")).where(F.col("state").isNotNull())
