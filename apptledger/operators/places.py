"""The address cache: lookup, admission and merging."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptledger.functions import naming, times
from apptledger.model import Tables, conform
from apptledger.operators.changes import apply_changes, latest_per_key, one_per_key
from apptledger.operators.chains import followed
from apptledger.operators.joins import lookup_join
from apptledger.operators.numbering import assign_ids
from apptledger.session import materialized


def match_places(requests: DataFrame, places: DataFrame) -> DataFrame:
    """Requests with the cached place of their address; NULL place on a miss.

    ``requests`` has a unique ``request_id`` and ``address, city, state, zip``.
    A hit with a location id needs no new geocode.
    """
    keyed = requests.withColumn("normalized_address", naming.normalized_address())
    cached = places.select("normalized_address", "place_id", "location_ext_id")
    return lookup_join(keyed, cached, "normalized_address", "left", spread_by=["request_id"]).withColumn(
        "needs_location", naming.needs("location_ext_id")
    )


def resolve_places(requests: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits and misses."""
    matched = match_places(requests, places)
    return matched.where(F.col("place_id").isNotNull()), matched.where(F.col("place_id").isNull())


def new_places(requests: DataFrame, tables: Tables, as_of: dt.datetime) -> DataFrame:
    """One row per address not cached yet, described by its first request."""
    _, misses = resolve_places(requests, tables.places)
    first = materialized(
        latest_per_key(
            misses.withColumn("_first", -F.col("request_id")), ["normalized_address"], ["_first"]
        ).drop("place_id", "location_ext_id", "needs_location", "_first"), "new-places")
    last = tables.places.agg(F.max("place_id")).scalar()
    numbered = assign_ids(first, "normalized_address", "place_id", last)
    return conform(numbered.withColumns({
        "is_repeat_site": F.coalesce(F.col("is_repeat_site"), F.lit(0)),
        "place_label": naming.place_label(),
        "created_at": times.local_literal(as_of),
        "updated_at": times.local_literal(as_of),
    }), "places")


def admit_places(tables: Tables, requests: DataFrame, as_of: dt.datetime) -> tuple[Tables, DataFrame]:
    """Cache unknown addresses; also returns every request with its place.

    ``requests`` has ``request_id, address, city, state, zip, client_name,
    is_repeat_site``. Places already cached keep their location id.
    """
    grown = conform(tables.places, "places").unionByName(new_places(requests, tables, as_of))
    return tables.replace(places=grown), match_places(requests, grown)


def link_locations(tables: Tables, links: DataFrame, as_of: dt.datetime) -> Tables:
    """Store location ids by ``place_id``."""
    delta = links.select("place_id", "location_ext_id")
    return tables.replace(places=apply_changes(tables.places, delta, "place_id", as_of=as_of))


def merge_places(tables: Tables, merges: DataFrame, as_of: dt.datetime) -> Tables:
    """Fold duplicates into survivors (``place_id, survivor_id``).

    Appointments move to the survivor. The survivor keeps its location id and
    takes a duplicate's only when it has none, which moves its ``updated_at``.
    Survivors that are merged themselves are followed to the last one; merges
    that run in a circle, or of a place into itself, are left out.
    """
    wanted = one_per_key(merges.select("place_id", "survivor_id"), "place_id")
    ends = followed(wanted.select(F.col("place_id").alias("node"), F.col("survivor_id").alias("up")).where("node <> up"))
    plan = materialized(
        ends.where(F.col("root").isNotNull()).select(F.col("node").alias("place_id"), F.col("root").alias("survivor_id")), "merges")
    moved = lookup_join(
        tables.appointments, plan, "place_id", "left", spread_by=["appointment_id"], bound=tables.places
    )
    hit = F.col("survivor_id").isNotNull()
    appointments = moved.withColumns({
        "updated_at": F.when(hit, times.local_literal(as_of)).otherwise(F.col("updated_at")),
        "place_id": F.coalesce("survivor_id", "place_id"),
    }).select(*tables.appointments.columns)

    inherited = (
        tables.places.join(plan, "place_id")
        .groupBy(F.col("survivor_id").alias("place_id"))
        .agg(F.min("location_ext_id").alias("_inherited"))
    )
    kept = tables.places.join(plan.select("place_id"), "place_id", "left_anti").join(inherited, "place_id", "left")
    gained = F.col("location_ext_id").isNull() & F.col("_inherited").isNotNull()
    places = kept.withColumns({
        "updated_at": F.when(gained, times.local_literal(as_of)).otherwise(F.col("updated_at")),
        "location_ext_id": F.coalesce("location_ext_id", "_inherited"),
    }).select(*tables.places.columns)
    return tables.replace(appointments=appointments, places=places)
