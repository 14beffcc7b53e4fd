"""Models of a whole network from the template of one satellite and one terminal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satspan.operators.network import family
from satspan.sources.constellation import plane_groups, slot_numbers
from satspan.sources.shared import written

CIR_BPS = 2_000_000
#: Fixed value: the name space of URLs in name-based identifiers (version 5).
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Name-based identifier of a string in the URL space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(name, "utf-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def satellite_model(template: DataFrame, satellites: DataFrame) -> DataFrame:
    """``template(body, id)`` of satellite 1, once per satellite: names and grid
    places are replaced, and the platform's row gets the elements to patch in.
    The template is a few blocks."""
    planes = slot_numbers(plane_groups(satellites, "plane_uid") if "plane_uid" in satellites.columns else plane_groups(satellites, "raan_rad"))
    number, grid = F.col("sat_idx") + 1, F.concat(F.lit("1200."), F.col("plane_uid") + 1, F.lit("."), F.col("slot_id") + 1)
    named = lambda c: F.regexp_replace(F.replace(F.col(c), F.lit("satellite-1-"), F.concat(F.lit("satellite-"), number, F.lit("-"))), F.lit(r"1200\.1\.1(?!\d)"), grid)
    mine = template.where(family(F.col("id")) == "sat").select(F.col("body").alias("_body"), F.col("id").alias("_id"))
    rows = planes.crossJoin(F.broadcast(mine))
    kepler = F.struct(
        (F.col("a_km") * 1000).alias("semimajor_axis_m"), F.col("ecc").alias("eccentricity"), F.degrees("inc_rad").alias("inclination_deg"),
        F.pmod(F.degrees("raan_rad"), F.lit(360.0)).alias("raan_deg"), F.pmod(F.degrees("argp_rad"), F.lit(360.0)).alias("argument_of_periapsis_deg"),
        F.pmod(F.degrees("m_rad"), F.lit(360.0)).alias("true_anomaly_deg"),
    )
    out = rows.select("sat_idx", named("_body").alias("body"), named("_id").alias("id"), "plane_uid", "slot_id", kepler.alias("_k"))
    platform = F.col("id").endswith("-platform")
    name = F.concat(F.lit("SAT-"), number, F.lit(" ("), F.col("plane_uid") + 1, F.lit("."), F.col("slot_id") + 1, F.lit(")"))
    return out.select("id", "body", F.when(platform, name).alias("name"), F.when(platform, F.col("_k")).alias("keplerian_elements"))


def subtree(relationships: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, id``: all that a root contains, itself included, over any number of
    steps (rows a contains z; cycles end).  A round joins only what the round
    before found new, and rounds are as many as the tree is deep."""
    holds = relationships.select(F.col("a").alias("id"), F.col("z").alias("inner"))
    found = written(roots.select(F.col("id").alias("root"), "id").distinct(), "subtree")
    front = found
    while True:
        next_ = front.join(holds, "id").select("root", F.col("inner").alias("id")).distinct()
        front = written(next_.join(found, ["root", "id"], "left_anti"), "subtree")
        if front.isEmpty():
            return found
        found = found.unionByName(front)


SATELLITE, TERMINAL = "satellite-1-", "user-terminal-1-"


def network_model(
    entities: DataFrame, relationships: DataFrame, satellites: DataFrame, ref_epoch_s: int, terminals: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """A whole network from a template of one satellite and one terminal:
    (entities ``id, body, name, keplerian_elements, place``, relationships ``a, z, body``).

    ``entities(id, body)``, ``relationships(kind, a, z, body)``, ``satellites`` with
    elements and a plane, ``terminals(n, lat_deg, lon_deg)``.

    * What is neither a satellite's nor a terminal's passes as it is, and so do the
      relationships between two such.
    * The template satellite's subtree is what its platform contains, over any number of
      steps, and what its name says; it is cloned for every satellite, ids and
      bodies rewritten, the platform given its name, elements and epoch.  A
      relationship is cloned where both ends are in the subtree; one that leaves
      it goes, and so do links between satellites and other satellites' parts.
    * The template terminal's likewise.

    The template is a few blocks and is broadcast; satellites and terminals are
    tables of any size.
    """
    contains = relationships.where(F.col("kind") == 4)
    roots = entities.where(F.col("id").isin(f"{SATELLITE}platform", f"{TERMINAL}platform")).select("id")
    trees = subtree(contains, roots)
    inside = trees.groupBy("id").agg(F.min("root").alias("root"))
    kind = family(F.col("id"))
    part = (
        F.when(kind == "drop", "drop")
        .when((F.col("root") == f"{SATELLITE}platform") | F.col("id").startswith(SATELLITE), "sat")
        .when((F.col("root") == f"{TERMINAL}platform") | F.col("id").startswith(TERMINAL), "ut")
        .when(kind == "global", "global").otherwise("drop")
    )
    parts = written(entities.join(inside, "id", "left").withColumn("part", part).drop("root"), "template")
    of = parts.select("id", "part")
    ends = relationships.join(of.select(F.col("id").alias("a"), F.col("part").alias("pa")), "a").join(of.select(F.col("id").alias("z"), F.col("part").alias("pz")), "z")
    links = written(ends.where("pa = pz AND pa <> 'drop'").select("a", "z", "body", F.col("pa").alias("part")), "template-links")

    def cloned(rows: DataFrame, things: DataFrame, which: str, own: str, mine, ids: list[str]) -> DataFrame:
        """``rows`` of the template once per thing; parts without the prefix get it."""
        names = F.array_sort(F.collect_list(F.when(~F.col("id").startswith(own), F.col("id"))))
        others = parts.where(F.col("part") == which).agg(names.alias("_others"))  # one row of the template's ids
        each = things.crossJoin(F.broadcast(rows.where(F.col("part") == which).drop("part"))).crossJoin(F.broadcast(others))
        new = lambda x: F.when(x.startswith(own), F.concat(mine, F.substring(x, len(own) + 1, 1 << 20))).otherwise(F.concat(mine, x))
        quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
        body = F.aggregate("_others", F.replace(F.col("body"), F.lit(own), mine), lambda b, x: F.replace(b, quoted(x), quoted(F.concat(mine, x))))
        return each.withColumns({"body": body, **{c: new(F.col(c)) for c in ids}}).drop("_others")

    planes = slot_numbers(plane_groups(satellites, "plane_uid" if "plane_uid" in satellites.columns else "raan_rad"))
    number = F.col("sat_idx") + 1
    grid = F.concat(F.lit("1200."), F.col("plane_uid") + 1, F.lit("."), F.col("slot_id") + 1)
    regrid = F.regexp_replace("body", F.lit(r"1200\.1\.1(?!\d)"), grid)
    mine = F.concat(F.lit("satellite-"), number, F.lit("-"))
    sats = cloned(parts, planes, "sat", SATELLITE, mine, ["id"]).withColumn("body", regrid)
    platform = F.col("id") == F.concat(mine, F.lit("platform"))
    kepler = F.struct(
        (F.col("a_km") * 1000).alias("semimajor_axis_m"), F.col("ecc").alias("eccentricity"), F.degrees("inc_rad").alias("inclination_deg"),
        F.pmod(F.degrees("raan_rad"), F.lit(360.0)).alias("raan_deg"), F.pmod(F.degrees("argp_rad"), F.lit(360.0)).alias("argument_of_periapsis_deg"),
        F.pmod(F.degrees("m_rad"), F.lit(360.0)).alias("true_anomaly_deg"), F.struct(F.lit(ref_epoch_s).cast("long").alias("seconds")).alias("epoch"),
    )
    name = F.concat(F.lit("SAT-"), number, F.lit(" ("), F.col("plane_uid") + 1, F.lit("."), F.col("slot_id") + 1, F.lit(")"))
    place = "struct<lat_deg:double,lon_deg:double>"
    out = sats.select("id", "body", F.when(platform, name).alias("name"), F.when(platform, kepler).alias("keplerian_elements"), F.lit(None).cast(place).alias("place"))
    fixed = parts.where("part = 'global'").select("id", "body", F.lit(None).cast("string").alias("name"))
    out = out.unionByName(fixed, allowMissingColumns=True)
    out_links = cloned(links, planes, "sat", SATELLITE, mine, ["a", "z"]).withColumn("body", regrid).select("a", "z", "body")
    out_links = out_links.unionByName(links.where("part = 'global'").select("a", "z", "body"))
    if terminals is not None:
        its = F.concat(F.lit("user-terminal-"), F.col("n"), F.lit("-"))
        label = F.replace(F.col("body"), F.lit('"UT 1"'), F.concat(F.lit('"UT '), F.col("n"), F.lit('"')))
        users = cloned(parts, terminals, "ut", TERMINAL, its, ["id"]).withColumn("body", label)
        here = F.col("id") == F.concat(its, F.lit("platform"))
        at = F.struct(F.col("lat_deg").cast("double").alias("lat_deg"), F.col("lon_deg").cast("double").alias("lon_deg"))
        out = out.unionByName(
            users.select("id", "body", F.when(here, F.concat(F.lit("UT-"), F.col("n"))).alias("name"), F.when(here, at).alias("place")), allowMissingColumns=True
        )
        out_links = out_links.unionByName(cloned(links, terminals, "ut", TERMINAL, its, ["a", "z"]).withColumn("body", label).select("a", "z", "body"))
    return out, out_links


def terminal_model(template: DataFrame, terminals: DataFrame) -> DataFrame:
    """The template of terminal 1, once per ``terminals(n, lat_deg, lon_deg)``."""
    mine = template.where(family(F.col("id")) == "ut").select(F.col("body").alias("_body"), F.col("id").alias("_id"))
    n = F.col("n")
    named = lambda c: F.replace(
        F.replace(F.col(c), F.lit("user-terminal-1-"), F.concat(F.lit("user-terminal-"), n, F.lit("-"))), F.lit('"UT 1"'), F.concat(F.lit('"UT '), n, F.lit('"'))
    )
    rows = terminals.crossJoin(F.broadcast(mine)).select("n", "lat_deg", "lon_deg", named("_body").alias("body"), named("_id").alias("id"))
    platform = F.col("id").endswith("-platform")
    return rows.select("id", "body", F.when(platform, F.concat(F.lit("UT-"), n)).alias("name"), F.when(platform, F.struct("lat_deg", "lon_deg")).alias("place"))


def demands(terminals: DataFrame, gateway: str) -> DataFrame:
    """Two requests a terminal, to the gateway and back, with name-based ids."""
    end = F.concat(F.lit("user-terminal-"), F.col("n"), F.lit("-route-fn"))
    ways = F.array(F.struct(F.lit(gateway).alias("headend"), end.alias("endpoint")), F.struct(end.alias("headend"), F.lit(gateway).alias("endpoint")))
    rows = terminals.select("n", F.explode(ways).alias("w")).select("n", "w.*")
    symbol = F.concat("headend", F.lit("--1--"), "endpoint")
    return rows.select(F.concat(F.lit("p2pSrTePolicies/"), uuid5(symbol)).alias("id"), "headend", "endpoint", symbol.alias("symbolic_name"), F.lit(CIR_BPS).alias("cir_bps"))


def patched(rows: DataFrame, patches: dict[str, Column]) -> DataFrame:
    """Rows with some (nested, dotted) fields replaced by column expressions."""
    for path, value in patches.items():
        top, _, rest = path.partition(".")
        rows = rows.withColumn(top, F.col(top).withField(rest, value) if rest else value)
    return rows
