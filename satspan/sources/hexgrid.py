"""Hexagonal cells of the globe: an icosahedron, a lattice on each face, aperture 7.

Each face's plane (gnomonic projection) carries a lattice of hexagons that has the
face's centre and its three corners among its points; from level to level the
lattice is finer by the square root of seven and turned by 19.1 degrees, one way
and back.  A point's cell is the nearest lattice point in the plane of its face.
Where that point lies beyond an edge it belongs to the neighbour, whose plane is
unfolded along the edge; on an edge the lower face has it, at a corner (twelve
cells with five neighbours) the lowest of the five.  So every cell has one name.

A cell's parent is the nearest point of the coarser lattice, and its digit says in
which direction from the parent it lies, in the parent's plane.  A name is the
number of the level-0 cell (122 of them) and one digit a level: the parent's name
is the name with the last digit cut off, whatever points are asked for.

All of it are column expressions; the tables are of 20 faces and 60 edges.  The
icosahedron's place is that of the published hexagonal grid, so the centres are
the same; the names are not.
"""

from __future__ import annotations

import cmath
import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The centre of one face (latitude, longitude) and the azimuth of
#: one of its corners, in radians.
FACE_LAT, FACE_LON, CORNER_AZIMUTH = 0.803582649718989942, 1.248397419617396099, 5.619958268523939882
ROOT3, ROOT7 = math.sqrt(3), math.sqrt(7)
#: The lattice of level 1 in that of level 0: 5/2 + i sqrt(3)/2, of length sqrt(7).
TURN = cmath.phase(complex(2.5, ROOT3 / 2))
EPS = 1e-7


def _dot(a, b) -> float:
    return sum(x * y for x, y in zip(a, b))


def _cross(a, b) -> tuple[float, float, float]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _unit(a) -> tuple[float, ...]:
    n = math.sqrt(_dot(a, a))
    return tuple(x / n for x in a)


@cache
def faces() -> list[dict]:
    """Per face: ``f`` (centre), ``u`` (towards the first corner) and ``v`` axes,
    ``scale`` of the plane (corners at distance 2) and ``corners``, anticlockwise."""
    lat, lon = FACE_LAT, FACE_LON
    up = (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))
    north, east = (-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat)), (-math.sin(lon), math.cos(lon), 0.0)
    # The angle between a face's centre and its corners.
    angle = math.acos(math.sqrt((5 + 2 * math.sqrt(5)) / 15))
    found = []
    for k in range(3):
        az = CORNER_AZIMUTH - k * 2 * math.pi / 3
        found.append(tuple(math.cos(angle) * u + math.sin(angle) * (math.cos(az) * n + math.sin(az) * e) for u, n, e in zip(up, north, east)))

    def near(p) -> int | None:
        return next((i for i, q in enumerate(found) if _dot(p, q) > 0.999), None)

    todo = [(0, 1, 2)]
    while todo:  # mirror the third corner at the plane of each edge
        tri = todo.pop(0)
        for k in range(3):
            a, b, c = tri[k - 2], tri[k - 1], tri[k]
            n = _unit(_cross(found[a], found[b]))
            p = tuple(x - 2 * _dot(found[c], n) * y for x, y in zip(found[c], n))
            if near(p) is None:
                found.append(p)
                todo.append((b, a, len(found) - 1))
    close = lambda i, j: abs(_dot(found[i], found[j]) - 1 / math.sqrt(5)) < 1e-6
    out = []
    for i in range(12):
        for j in range(i + 1, 12):
            for k in range(j + 1, 12):
                if close(i, j) and close(j, k) and close(i, k):
                    f = _unit([sum(x) for x in zip(found[i], found[j], found[k])])
                    right = _dot(_cross(found[i], found[j]), found[k]) > 0
                    corners = (i, j, k) if right else (i, k, j)
                    first = found[i]
                    u = _unit([x - _dot(first, f) * y for x, y in zip(first, f)])
                    out.append({"f": f, "u": u, "v": _cross(f, u), "corners": corners, "scale": math.tan(angle) / 2})
    return out


@cache
def edges() -> list[tuple]:
    """For face and corner k, at place 3 * face + k: the neighbour over the edge
    that faces the corner, and the turn and shift (complex) into its plane."""
    spots = [2 * cmath.exp(2j * math.pi * k / 3) for k in range(3)]
    table = []
    for i, face in enumerate(faces()):
        for k in range(3):
            a, b = face["corners"][(k + 1) % 3], face["corners"][(k + 2) % 3]
            j, other = next((j, g) for j, g in enumerate(faces()) if j != i and a in g["corners"] and b in g["corners"])
            here = spots[(k + 1) % 3], spots[(k + 2) % 3]
            there = spots[other["corners"].index(a)], spots[other["corners"].index(b)]
            turn = (there[1] - there[0]) / (here[1] - here[0])
            table.append((j, turn, there[0] - turn * here[0]))
    return table


@cache
def corners() -> list[tuple]:
    """For face and corner: the lowest face that has the corner, the corner's place
    there, and the turn into that plane, going round the corner clockwise."""
    spots = [2 * cmath.exp(2j * math.pi * k / 3) for k in range(3)]
    table = []
    for i, face in enumerate(faces()):
        for k in range(3):
            corner = face["corners"][k]
            home = min(j for j, g in enumerate(faces()) if corner in g["corners"])
            at, turn = i, 1 + 0j
            while at != home:
                # the edge on the clockwise side of this face at the corner
                m = faces()[at]["corners"].index(corner)
                to, t, _ = edges()[3 * at + (m + 2) % 3]
                at, turn = to, turn * t
            table.append((home, spots[faces()[home]["corners"].index(corner)], turn))
    return table


def _pick(values: list[float], place: Column) -> Column:
    table = F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")
    return F.element_at(table, place.cast("int") + 1)


def lattice_scale(level: int) -> complex:
    """What a place in a face's plane is multiplied by for lattice units."""
    return ROOT7**level * cmath.exp(-1j * TURN * (level % 2))


def _times(x: Column, y: Column, c: complex) -> tuple[Column, Column]:
    return x * c.real - y * c.imag, x * c.imag + y * c.real


def _nearest(x: Column, y: Column) -> tuple[Column, Column]:
    """The lattice point (q, r) nearest to a place in lattice units."""
    r = y * (2 / ROOT3)
    q = x - r / 2
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return (
        F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"),
        F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr).cast("long"),
    )


def _fixed(df: DataFrame) -> DataFrame:
    """A row number that later steps look at: Catalyst moves no filter below it and
    puts nothing above it in place of what stands below, which would work every
    step out once for each of its uses."""
    return df.withColumn("_row", F.monotonically_increasing_id())


def _named(df: DataFrame, level: int) -> DataFrame:
    """``_face, _q, _r`` (perhaps outside the face) to those of the cell's own face;
    ``_px, _py`` is the place in that plane, ``_tc, _ts`` the turn into it."""
    df = _fixed(df)
    inverse = 1 / lattice_scale(level)
    px, py = _times(F.col("_q") + F.col("_r") / 2, F.col("_r") * (ROOT3 / 2), inverse)
    df = df.withColumns({"_px": px, "_py": py, "_tc": F.lit(1.0), "_ts": F.lit(0.0)})
    df = _over_edge(df, lambda side, best: best > 1 + EPS)
    at_corner = F.col("_px") * F.col("_px") + F.col("_py") * F.col("_py") > (2 - EPS) ** 2
    # The corner that is near: the first axis with a positive part of the place.
    spots = [2 * cmath.exp(2j * math.pi * k / 3) for k in range(3)]
    along = [F.col("_px") * s.real + F.col("_py") * s.imag for s in spots]
    k = F.when(along[0] > 3, 0).when(along[1] > 3, 1).otherwise(2)
    df = df.withColumns({"_at": at_corner, "_k": F.col("_face") * 3 + k})
    t = corners()
    turn = _pick([x[2].real for x in t], F.col("_k")), _pick([x[2].imag for x in t], F.col("_k"))
    df = df.withColumns({
        "_nf": F.when(F.col("_at"), _pick([x[0] for x in t], F.col("_k")).cast("int")).otherwise(F.col("_face")),
        "_nx": F.when(F.col("_at"), _pick([x[1].real for x in t], F.col("_k"))).otherwise(F.col("_px")),
        "_ny": F.when(F.col("_at"), _pick([x[1].imag for x in t], F.col("_k"))).otherwise(F.col("_py")),
        "_nc": F.when(F.col("_at"), F.col("_tc") * turn[0] - F.col("_ts") * turn[1]).otherwise(F.col("_tc")),
        "_ns": F.when(F.col("_at"), F.col("_tc") * turn[1] + F.col("_ts") * turn[0]).otherwise(F.col("_ts")),
    })
    df = df.withColumns({"_face": F.col("_nf"), "_px": F.col("_nx"), "_py": F.col("_ny"), "_tc": F.col("_nc"), "_ts": F.col("_ns")})
    # On an edge the lower face has the cell.
    df = _over_edge(df, lambda side, best: (best > 1 - EPS) & (side < F.col("_face")) & ~F.col("_at"))
    q, r = _nearest(*_times(F.col("_px"), F.col("_py"), lattice_scale(level)))
    return df.withColumns({"_q": q, "_r": r}).drop("_at", "_k", "_nf", "_nx", "_ny", "_nc", "_ns")


def _over_edge(df: DataFrame, when) -> DataFrame:
    """Into the plane over the nearest edge where ``when(neighbour, distance)``."""
    # Distance from the centre in the direction of each edge; the edge is at 1.
    out = [-cmath.exp(2j * math.pi * k / 3) for k in range(3)]
    far = [F.col("_px") * c.real + F.col("_py") * c.imag for c in out]
    df = df.withColumns({"_d0": far[0], "_d1": far[1], "_d2": far[2]})
    k = F.when((F.col("_d0") >= F.col("_d1")) & (F.col("_d0") >= F.col("_d2")), 0).when(F.col("_d1") >= F.col("_d2"), 1).otherwise(2)
    df = df.withColumns({"_e": F.col("_face") * 3 + k, "_best": F.greatest("_d0", "_d1", "_d2")})
    t = edges()
    df = df.withColumns({
        "_to": _pick([x[0] for x in t], F.col("_e")).cast("int"),
        "_rc": _pick([x[1].real for x in t], F.col("_e")), "_rs": _pick([x[1].imag for x in t], F.col("_e")),
        "_ox": _pick([x[2].real for x in t], F.col("_e")), "_oy": _pick([x[2].imag for x in t], F.col("_e")),
    })
    df = df.withColumn("_go", when(F.col("_to"), F.col("_best")))
    new = {
        "_face": F.col("_to"),
        "_px": F.col("_px") * F.col("_rc") - F.col("_py") * F.col("_rs") + F.col("_ox"),
        "_py": F.col("_px") * F.col("_rs") + F.col("_py") * F.col("_rc") + F.col("_oy"),
        "_tc": F.col("_tc") * F.col("_rc") - F.col("_ts") * F.col("_rs"),
        "_ts": F.col("_tc") * F.col("_rs") + F.col("_ts") * F.col("_rc"),
    }
    df = df.withColumns({c: F.when(F.col("_go"), x).otherwise(F.col(c)) for c, x in new.items()})
    return df.drop("_d0", "_d1", "_d2", "_e", "_best", "_to", "_rc", "_rs", "_ox", "_oy", "_go")


def _place_on_globe(face: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of a place in a face's plane."""
    scale = faces()[0]["scale"]
    part = lambda axis, i: _pick([f[axis][i] for f in faces()], face)
    x, y, z = (part("f", i) + (px * part("u", i) + py * part("v", i)) * scale for i in range(3))
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


@cache
def base_cells() -> list[tuple[int, int, int]]:
    """The cells of level 0 by rule: the lattice points of each face that no lower
    face has."""
    spots = [2 * cmath.exp(2j * math.pi * k / 3) for k in range(3)]
    out = []
    for i in range(20):
        for q in range(-2, 3):
            for r in range(-2, 3):
                p = complex(q + r / 2, r * ROOT3 / 2)
                far = [-(p * cmath.exp(-2j * math.pi * k / 3)).real for k in range(3)]
                corner = next((k for k in range(3) if abs(p - spots[k]) < EPS), None)
                owned = corners()[3 * i + corner][0] == i if corner is not None else all(d < 1 - EPS or edges()[3 * i + k][0] > i for k, d in enumerate(far))
                if max(far) < 1 + EPS and owned:
                    out.append((i, q, r))
    return out


def _code(face, q, r):
    return face * 100 + (q + 4) * 10 + (r + 4)


def hex_cells(points: DataFrame, level: int, lat: str = "lat_deg", lon: str = "lon_deg") -> DataFrame:
    """``points`` with ``hex_id`` and the cell's centre, ``hex_lat_deg`` and
    ``hex_lon_deg``; a null place has no cell."""
    la, lo = F.radians(lat), F.radians(lon)
    df = points.withColumns({"_x": F.cos(la) * F.cos(lo), "_y": F.cos(la) * F.sin(lo), "_z": F.sin(la)})
    dots = ", ".join("_x * {!r}D + _y * {!r}D + _z * {!r}D".format(*f["f"]) for f in faces())
    df = df.withColumn("_dots", F.expr(f"array({dots})"))
    df = df.withColumn("_face", (F.array_position("_dots", F.array_max("_dots")) - 1).cast("int"))
    axis = lambda name: sum((F.col(c) * _pick([f[name][i] for f in faces()], F.col("_face")) for i, c in enumerate(("_y", "_z"), 1)), F.col("_x") * _pick([f[name][0] for f in faces()], F.col("_face")))
    depth = axis("f") * faces()[0]["scale"]
    df = df.withColumns({"_px": axis("u") / depth, "_py": axis("v") / depth})
    q, r = _nearest(*_times(F.col("_px"), F.col("_py"), lattice_scale(level)))
    df = _named(df.withColumns({"_q": q, "_r": r}), level)
    at = _place_on_globe(F.col("_face"), F.col("_px"), F.col("_py"))
    df = df.withColumns({"_lat": at[0], "_lon": at[1], "_digits": F.lit("")})
    for n in range(level, 0, -1):
        w = complex(2.5, ROOT3 / 2 if n % 2 == 0 else -ROOT3 / 2)
        x, y = F.col("_q") + F.col("_r") / 2, F.col("_r") * (ROOT3 / 2)
        pq, pr = _nearest(*_times(x, y, 1 / w))
        df = df.withColumns({"_cx": x, "_cy": y, "_pq": pq, "_pr": pr})
        wx, wy = _times(F.col("_pq") + F.col("_pr") / 2, F.col("_pr") * (ROOT3 / 2), w)
        df = df.withColumns({"_cx": F.col("_cx") - wx, "_cy": F.col("_cy") - wy, "_q": F.col("_pq"), "_r": F.col("_pr")})
        df = _named(df, n - 1)
        dx, dy = F.col("_cx") * F.col("_tc") - F.col("_cy") * F.col("_ts"), F.col("_cx") * F.col("_ts") + F.col("_cy") * F.col("_tc")
        direction = F.pmod(F.rint(F.degrees(F.atan2(dy, dx)) / 60), F.lit(6.0)).cast("int") + 1
        digit = F.when(F.col("_cx") * F.col("_cx") + F.col("_cy") * F.col("_cy") < 0.25, 0).otherwise(direction)
        df = df.withColumn("_digits", F.concat(digit.cast("string"), F.col("_digits"))).drop("_cx", "_cy", "_pq", "_pr")
    codes = F.expr("array(" + ", ".join(str(_code(*c)) for c in base_cells()) + ")")
    number = F.array_position(codes, _code(F.col("_face"), F.col("_q"), F.col("_r")).cast("int")) - 1
    name = F.concat(F.lpad(number.cast("string"), 3, "0"), F.col("_digits"))
    made = {"hex_id": name, "hex_lat_deg": F.col("_lat"), "hex_lon_deg": F.col("_lon")}
    held = _fixed(df.withColumns({f"_{k}": F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), c) for k, c in made.items()}))
    return held.select(*points.columns, *[F.when(F.col("_row") >= 0, F.col(f"_{k}")).alias(k) for k in made])


def hex_level(name: Column) -> Column:
    return F.length(name) - 3


def hex_parent(name: Column, level: int) -> Column:
    """The cell of a coarser level that holds a cell; an error where it is finer."""
    fine = F.length(name) < 3 + level
    return F.when(fine, F.raise_error(F.lit("a parent may not be finer than the cell")).cast("string")).otherwise(F.substring(name, 1, 3 + level))


def hex_shards(cells: DataFrame, level: int, name: str = "hex_id") -> DataFrame:
    """Cells with ``shard_id``, the single parent that owns each."""
    return cells.withColumn("shard_id", hex_parent(F.col(name), level))


def average_edge_km(level: int, radius_km: float = 6371.0071809184745) -> float:
    """Edge of a hexagon of the level's mean area (2 + 120 * 7**level cells)."""
    area = 4 * math.pi * radius_km**2 / (2 + 120 * 7**level)
    return math.sqrt(2 * area / (3 * ROOT3))


def hex_fill(spark, box: tuple[float, float, float, float], level: int) -> DataFrame:
    """The cells whose centre lies in a box (south, north, west, east; west above
    east crosses the date line): ``hex_id, lat_deg, lon_deg``.

    Points closer than a cell is wide are laid out row by row, each gives its cell,
    and repeats go; so the work is a constant number of points a cell, in rows
    that Spark deals out.
    """
    south, north, west, east = box
    inner = average_edge_km(level) * ROOT3 / 2 / 111.195
    step, pad = 0.55 * inner, 2 * inner  # cells differ from the mean: the least is 0.6 of it in area
    wide = (east - west) % 360 or (360.0 if east != west else 0.0)
    rows = int(math.ceil((north - south + 2 * pad) / step)) + 1
    lat = F.greatest(F.least(F.lit(south - pad) + F.col("id") * step, F.lit(90.0)), F.lit(-90.0))
    lines = spark.range(rows).select(lat.alias("lat_deg"))
    # A degree of longitude is shorter away from the equator.
    across = F.lit(step) / F.greatest(F.cos(F.radians("lat_deg")), F.lit(0.02))
    margin = F.lit(pad) / F.greatest(F.cos(F.radians("lat_deg")), F.lit(0.02))
    count = F.least(F.ceil((F.lit(wide) + 2 * margin) / across), F.ceil(F.lit(360.0) / across)).cast("int")
    points = lines.withColumns({"_across": across, "_first": F.lit(west) - margin, "_n": count}).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    lon = F.pmod(F.col("_first") + F.col("_k") * F.col("_across") + 180, F.lit(360.0)) - 180
    cells = hex_cells(points.select("lat_deg", lon.alias("lon_deg")), level)
    once = cells.groupBy("hex_id").agg(F.first("hex_lat_deg").alias("lat_deg"), F.first("hex_lon_deg").alias("lon_deg"))
    inside = F.col("lon_deg").between(west, east) if west <= east else (F.col("lon_deg") >= west) | (F.col("lon_deg") <= east)
    return once.where(F.col("lat_deg").between(south, north) & inside)
