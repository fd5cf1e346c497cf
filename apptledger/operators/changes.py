"""Upsert, append and de-duplication primitives for state transforms."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptledger.functions.times import local_literal
from apptledger.operators.joins import fits_broadcast, spread_join
from apptledger.session import materialized


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``.

    An aggregate rather than a window: each task reduces its copies of a key to
    one row before the shuffle, so a key with very many copies costs no more.
    """
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def one_per_key(requests: DataFrame, key: str, newest_by: list[str] | None = None) -> DataFrame:
    """The last request of each key; requests without a key are left out.

    The last is the greatest by ``newest_by``, by default by ``requested_at`` if
    requests carry it. Requests that this leaves tied are ordered by their values,
    so a request sent twice counts once and the outcome never depends on the
    order in which rows are read.
    """
    others = [c for c in requests.columns if c != key]
    first = newest_by or [c for c in ("requested_at",) if c in others]
    known = requests.where(F.col(key).isNotNull())
    return latest_per_key(known, [key], [*first, *[c for c in others if c not in first]]) if others else known.distinct()


def conflicting_requests(requests: DataFrame, key: str, newest_by: list[str] | None = None) -> DataFrame:
    """Requests that ``one_per_key`` could only decide by their values: of one key, as late as each other, and different.

    What is left of ``requests`` without their keys can be applied without a choice of its own. Copies of a request
    are one row here. Rows are counted per key and time first, so a key with very many copies costs no more than others.
    """
    order = newest_by or [c for c in ("requested_at",) if c in requests.columns]
    distinct = requests.where(F.col(key).isNotNull()).distinct()
    known = distinct.groupBy(key, *order).agg(F.count(F.lit(1)).alias("_different"))
    if order:
        known = known.groupBy(key).agg(
            F.max(F.struct(*order)).alias("_last"), F.max_by("_different", F.struct(*order)).alias("_different"))
    torn = known.where(F.col("_different") > 1)
    rows = distinct.join(torn, key)
    if order:
        rows = rows.where(F.struct(*order).eqNullSafe(F.col("_last")))
    return rows.select(*requests.columns)


def apply_changes(
    base: DataFrame,
    delta: DataFrame,
    key: str,
    *,
    as_of: dt.datetime | None = None,
    keep_when_null: list[str] | None = None,
    insert: bool = False,
    newest_by: list[str] | None = None,
) -> DataFrame:
    """Overwrite ``base`` with the columns of ``delta`` where ``key`` matches.

    Of several ``delta`` rows with one key the last counts, see ``one_per_key``;
    ``requested_at`` in it orders them and is not written. A NULL in it is written as NULL, except in the
    ``keep_when_null`` columns. Matched rows get ``updated_at = as_of`` when the
    table has that column. With ``insert`` unmatched delta rows are added.

    A delta whose size is not known to be small is stored first. It then joins by
    broadcast if it turns out small, and the base table is not shuffled for it.
    """
    keep = set(keep_when_null or [])
    delta = one_per_key(delta, key, newest_by)
    changed = [c for c in delta.columns if c != key and c in base.columns]
    renamed = delta.select(key, F.lit(1).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    if not insert and not fits_broadcast(renamed):
        renamed = materialized(renamed, "changes")
    if insert:
        joined = base.join(renamed, key, "full")
    elif fits_broadcast(renamed):
        joined = base.join(F.broadcast(renamed), key, "left")
    else:
        joined = spread_join(base, renamed, [key], "left", spread_by=[base.columns[0]])
    hit = F.col("_hit").isNotNull()

    def value(name: str) -> Column:
        if name in changed:
            new = F.col(f"_new_{name}")
            if name in keep:
                return F.coalesce(new, F.col(name))
            return F.when(hit, new).otherwise(F.col(name))
        if name == "updated_at" and as_of is not None:
            return F.when(hit, local_literal(as_of)).otherwise(F.col(name))
        return F.col(name)

    return joined.select(*[
        (value(f.name).cast(f.dataType) if f.name != key else F.col(key)).alias(f.name)
        for f in base.schema.fields
    ])


def insert_or_ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append the rows whose keys are not there yet, one per key.

    A NULL equals no key, so rows with a NULL among ``keys`` are all appended.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    fresh = latest_per_key(new.where(known), keys, [c for c in new.columns if c not in keys]).join(
        target.select(*keys), keys, "left_anti"
    )
    return target.unionByName(fresh, allowMissingColumns=True).unionByName(new.where(~known), allowMissingColumns=True)
