"""The station of a case: candidates near it, the named one first, and the first with enough hours wins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def kilometres(lat1, lon1, lat2, lon2):
    """Great-circle distance."""
    h = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _cells(km: float):
    """(band of a latitude, cells around a band, cell of a longitude in a band): what lies within ``km`` is in the same or the next ones."""
    degree = EARTH_KM * math.pi / 180
    width = km / degree * 1.001

    def band(lat):
        return F.floor((lat + 90) / width).cast("int")

    def around(b):
        edge = F.least(F.lit(89.9), F.greatest(F.abs(b * width - 90), F.abs((b + 1) * width - 90)))
        return F.greatest(F.lit(1), F.floor(360.0 / (width / F.cos(F.radians(edge)))).cast("int"))

    def cell(lon, b):
        return F.pmod(F.floor((lon + 180) / (F.lit(360.0) / around(b))).cast("int"), around(b))

    return band, around, cell


def _told_apart(stations: DataFrame, k: int, *alike: str) -> DataFrame:
    """The ``k`` first by name of the stations that are equal in ``alike``: nothing but the name ranks these, so no others are among a case's ``k``."""
    place = F.row_number().over(Window.partitionBy(*alike).orderBy("station"))
    return stations.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def nearest_stations(sites: DataFrame, stations: DataFrame, most_km: float = 60.0, k: int = 3, most_lon: float = 3.0) -> DataFrame:
    """(site, station, km, rn): of every site the first ``k`` stations within ``most_km`` and ``most_lon`` degrees of longitude that were open in its year, known ones (``wban``) first, then the nearer, ties by name.

    ``sites`` (site, lat, lon, yr), ``stations`` (station, lat, lon, begin_year, end_year, wban).
    Distances are taken once for each place and year, however many sites are there, to
    the stations in the cells next to it.  ``most_km`` is at most 66, the height of a cell.
    """
    high, wide = 0.6, most_lon * 1.001
    next_to = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cell = lambda c, size: F.floor(F.col(c) / size)
    posts = _told_apart(stations.withColumn("wban", F.coalesce("wban", F.lit(False))), k, "lat", "lon", "begin_year", "end_year", "wban")
    posts = posts.select("station", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "begin_year", "end_year", "wban", cell("lat", high).alias("_b"), cell("lon", wide).alias("_c"))
    posts = posts.withColumn("_b", F.explode(F.transform(next_to, lambda o: F.col("_b") + o))).withColumn("_c", F.explode(F.transform(next_to, lambda o: F.col("_c") + o)))
    places = sites.select("lat", "lon", "yr").distinct().withColumn("_b", cell("lat", high)).withColumn("_c", cell("lon", wide))
    met = places.join(posts, ["_b", "_c"]).filter(F.col("yr").between(F.col("begin_year"), F.col("end_year")) & (F.abs(F.col("lon") - F.col("_lon")) <= most_lon))
    met = met.withColumn("km", kilometres(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).filter(F.col("km") <= most_km)
    order = [F.when(F.col("wban"), 0).otherwise(1), "km", "station"]
    first = met.withColumn("rn", F.row_number().over(Window.partitionBy("lat", "lon", "yr").orderBy(*order))).filter(F.col("rn") <= k).select("lat", "lon", "yr", "station", "km", "wban")
    ranked = sites.select("site", "lat", "lon", "yr").join(first, ["lat", "lon", "yr"]).withColumn("rn", F.row_number().over(Window.partitionBy("site").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rn") <= k).select("site", "station", F.round("km", 3).alias("km"), "rn")


def _contenders(stations: DataFrame, k: int) -> DataFrame:
    return _told_apart(stations.withColumn("known", F.coalesce("known", F.lit(False))), k, "lat", "lon", "begin_year", "end_year", "known", "code")


def candidates(cases: DataFrame, stations: DataFrame, most_km: float = 60.0, k: int = 3, prefix: str = "K") -> DataFrame:
    """(case_id, place, station, km): of every case the first ``k`` stations within ``most_km`` that its year covers.

    ``cases`` (case_id, lat, lon, year, facility), ``stations`` (station, code, lat, lon, begin_year,
    end_year, known).  The station whose code is ``prefix`` and the facility comes first,
    then known ones, then the nearer, ties by name.  Cases without a place have none.
    Stations are listed in the bands and cells next to theirs, so the join is by equal cells;
    a list holds the stations within ``most_km`` only and is made once for all cases of
    one place, year and facility.
    """
    band, around, cell = _cells(most_km)
    near = _contenders(stations, k).withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: band(F.col("lat")) + o)))
    near = near.withColumn("_cell", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.pmod(cell(F.col("lon"), F.col("_band")) + o, around(F.col("_band")))))))
    near = near.select("station", "code", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "begin_year", "end_year", "known", "_band", "_cell")
    own = cases.filter("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon", "year", "facility").distinct().withColumn("_band", band(F.col("lat"))).withColumn("_cell", cell(F.col("lon"), F.col("_band")))
    met = own.join(near, ["_band", "_cell"]).filter((F.col("begin_year") <= F.col("year")) & (F.col("end_year") >= F.col("year")))
    met = met.withColumn("km", kilometres(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).filter(F.col("km") <= most_km)
    named = F.coalesce(F.col("code") == F.concat(F.lit(prefix), F.upper("facility")), F.lit(False)) & (F.coalesce("facility", F.lit("")) != "")
    order = F.struct((~named).alias("other"), (~F.coalesce("known", F.lit(False))).alias("unknown"), "km", "station")
    place = [F.col(c).alias(f"_{c}") for c in ("lat", "lon", "year", "facility")]
    there = met.select("lat", "lon", "year", "facility", order.alias("o")).groupBy("lat", "lon", "year", "facility").agg(F.slice(F.sort_array(F.collect_list("o")), 1, k).alias("there")).select(*place, "there")
    same = [F.col(c) == F.col(f"_{c}") for c in ("lat", "lon", "year")] + [F.col("facility").eqNullSafe(F.col("_facility"))]
    first = cases.select("case_id", "lat", "lon", "year", "facility").join(there, same).groupBy("case_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("there"))), 1, k).alias("found"))
    return first.select("case_id", F.posexplode("found").alias("place", "f")).select("case_id", (F.col("place") + 1).alias("place"), "f.station", "f.km")


def resolve_stations(cases: DataFrame, stations: DataFrame, hours: DataFrame, least: int = 100, most_km: float = 60.0, k: int = 3, prefix: str = "K") -> DataFrame:
    """(case_id, station, place, km, n_hours): of every case the first of its candidates with ``least`` hours in its year and month; null without one.

    ``hours`` (station, year, month, n_hours) has a row a station and month; ``cases`` have a
    month besides what :func:`candidates` needs, and ids of their own.  Hours of
    stations that no case can have are left out before the join.
    """
    wanted = candidates(cases, stations, most_km, k, prefix).join(cases.select("case_id", "year", "month"), "case_id")
    theirs = hours.join(_contenders(stations, k).select("station").distinct(), "station", "left_semi")
    enough = wanted.join(theirs.filter(F.col("n_hours") >= least), ["station", "year", "month"])
    won = enough.groupBy("case_id").agg(F.min(F.struct("place", "station", "km", "n_hours")).alias("w"))
    return cases.select("case_id").join(won, "case_id", "left").select("case_id", "w.station", "w.place", "w.km", "w.n_hours")
