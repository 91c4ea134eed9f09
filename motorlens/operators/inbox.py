"""Inquiries, vehicle look-ups and cards that move: results that depend on the order in which things came."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.domain import VIEWS
from ..plans.registry import frame
from ..plans.shared import dropped, stored

# ---------------------------------------------------------------- contacts


def _keys(people: DataFrame) -> DataFrame:
    """(tenant, first, kind, value): a row for each mail address and telephone number that is not empty."""
    both = F.array(F.struct(F.lit("mail").alias("kind"), F.col("mail").alias("value")), F.struct(F.lit("phone").alias("kind"), F.col("phone").alias("value")))
    return people.select("tenant", "first", F.inline(F.filter(both, lambda k: k["value"] != "")))


def founders(rows: DataFrame) -> DataFrame:
    """(tenant, first, mail, phone) of the inquiries that make a contact, of (id, tenant, mail, phone) in order of id.

    An inquiry makes one if none that came before it, and made one, has its address or its number. So of what isn't decided yet whoever comes first
    for all of its own keys makes a contact, and that decides all others that share a key with it. Rounds go on until all is decided: as many
    as the longest chain in which each depends on the one before. Inquiries of one address and number are one row: only the
    first of them can make a contact."""
    spark = rows.sparkSession
    open_ = stored(rows.where("mail <> '' OR phone <> ''").groupBy("tenant", "mail", "phone").agg(F.min("id").alias("first")), "people")
    made = []
    while True:
        keys = _keys(open_)
        least = keys.groupBy("tenant", "kind", "value").agg(F.min("first").alias("least"))
        first = keys.join(least, ["tenant", "kind", "value"]).groupBy("first").agg(F.every(F.col("first") == F.col("least")).alias("all")).where("all").select("first")
        new = stored(open_.join(first, "first", "left_semi").select("tenant", "first", "mail", "phone"), "founders")
        if new.isEmpty():
            break
        made.append(new)
        taken = _keys(new).select("tenant", "kind", "value")
        left = open_
        for kind in ("mail", "phone"):
            own = taken.where(F.col("kind") == kind).select("tenant", F.col("value").alias(kind))
            left = left.join(own, ["tenant", kind], "left_anti")
        left = stored(left.select("tenant", "mail", "phone", "first"), "people")
        dropped(open_)
        open_ = left
    out = spark.createDataFrame([], new.schema)
    for part in made:
        out = out.unionByName(part)
    return out


def contacts(rows: DataFrame) -> DataFrame:
    """(id, contact_id) of inquiries (id, tenant, email, phone), in order of id: the contact that has the address by then, or else that which has the
    number, or else a new one, named by the inquiry. A contact keeps the address and number that it was made with; null and
    empty ones find nothing."""
    own = rows.select("id", "tenant", F.coalesce("email", F.lit("")).alias("mail"), F.coalesce("phone", F.lit("")).alias("phone"))
    made = stored(founders(own), "contacts")
    for kind in ("mail", "phone"):
        known = made.where(F.col(kind) != "").select(F.col("tenant").alias("_t"), F.col(kind).alias("_" + kind), F.col("first").alias("by_" + kind))
        own = own.join(known, F.col("tenant").eqNullSafe(F.col("_t")) & (F.col(kind) == F.col("_" + kind)) & (F.col("by_" + kind) <= F.col("id")), "left").drop("_t", "_" + kind)
    return own.select("id", F.coalesce("by_mail", "by_phone", "id").alias("contact_id"))


def inquiries(rows: DataFrame) -> DataFrame:
    """What becomes of each inquiry (id, tenant, email, phone, platform, external_id, vehicle_id, state), in order of id.

    ``contact_id`` as by ``contacts``. ``conversation_id``: that of the first one of a platform's external id (without one: its own); a later one
    only adds a message, so it has no ``deal_id``. A deal is that of contact and vehicle; an inquiry without a vehicle joins the contact's latest
    deal. ``moves``: the vehicle is listed and this is the first conversation about it."""
    own = rows.join(contacts(rows), "id")
    named = F.coalesce("external_id", F.lit("")) != ""
    firsts = own.where(named).groupBy("tenant", "platform", "external_id").agg(F.min("id").alias("_conversation"))
    firsts = firsts.select(F.col("tenant").alias("_t"), F.col("platform").alias("_p"), F.col("external_id").alias("_x"), "_conversation")
    own = own.join(firsts, F.col("tenant").eqNullSafe(F.col("_t")) & F.col("platform").eqNullSafe(F.col("_p")) & (F.col("external_id") == F.col("_x")), "left").drop("_t", "_p", "_x")
    own = stored(own.withColumn("conversation_id", F.coalesce("_conversation", "id")).withColumn("fresh", F.col("conversation_id") == F.col("id")), "inquiries")
    opens = own.where("fresh")
    deals = opens.where("vehicle_id is not null").groupBy("contact_id", "vehicle_id").agg(F.min("id").alias("_deal"))
    # Deals of a contact in order of their making: the first of each vehicle, and the contact's very first, whatever it is about.
    made = deals.select("contact_id", F.col("_deal").alias("at")).union(opens.groupBy("contact_id").agg(F.min("id"))).distinct()
    latest = Window.partitionBy("contact_id").orderBy("id", "made").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    loose = opens.where("vehicle_id is null").select("contact_id", "id", F.lit(1).alias("made"))
    loose = loose.unionByName(made.select("contact_id", F.col("at").alias("id"), F.lit(0).alias("made"))).withColumn("_loose", F.max(F.when(F.col("made") == 0, F.col("id"))).over(latest)).where("made = 1").select("id", "_loose")
    moved = opens.where("state = 'listed' AND vehicle_id is not null").groupBy("tenant", "vehicle_id").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("_moves"))
    out = own.join(deals, ["contact_id", "vehicle_id"], "left").join(loose, "id", "left").join(moved, "id", "left")
    deal = F.when(F.col("fresh"), F.coalesce("_deal", "_loose"))
    return out.select("id", "contact_id", "conversation_id", "fresh", deal.alias("deal_id"), F.coalesce("_moves", F.lit(False)).alias("moves"))


VIEWS["inquiry"] = lambda d: """SELECT event_id AS id, event_id % 40 AS tenant, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 31 = 5 THEN NULL ELSE concat('user', CAST(listing_id * 13 % 71 AS STRING), '@x.example') END AS email,
 CASE WHEN event_id % 5 = 1 THEN '' ELSE concat('+49', CAST((listing_id * 7 + event_id % 3) % 53 AS STRING)) END AS phone, CASE event_id % 3 WHEN 0 THEN 'mobile' ELSE 'scout' END AS platform, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('c', CAST(listing_id % 60 AS STRING)) END AS external_id,
 CASE WHEN event_id % 6 = 2 THEN NULL ELSE listing_id % 25 END AS vehicle_id, CASE WHEN listing_id % 25 < 12 THEN 'listed' ELSE 'sold' END AS state FROM event"""
frame("sco13_inquiry_dedup", ["inquiry"], lambda d: """WITH RECURSIVE n AS (SELECT id, tenant, coalesce(email, '') AS mail, coalesce(phone, '') AS phone, row_number() OVER (PARTITION BY tenant ORDER BY id) AS r FROM inquiry),
l AS (SELECT tenant, 0 AS r, 0::BIGINT AS id, 0::BIGINT AS contact, []::VARCHAR[] AS mails, []::VARCHAR[] AS phones, []::BIGINT[] AS ids FROM (SELECT DISTINCT tenant FROM inquiry) t
 UNION ALL SELECT tenant, r, id, contact, CASE WHEN contact = id THEN list_append(mails, mail) ELSE mails END, CASE WHEN contact = id THEN list_append(phones, phone) ELSE phones END, CASE WHEN contact = id THEN list_append(ids, id) ELSE ids END
 FROM (SELECT n.*, l.mails, l.phones, l.ids, CASE WHEN n.mail <> '' AND list_contains(l.mails, n.mail) THEN l.ids[list_position(l.mails, n.mail)] WHEN n.phone <> '' AND list_contains(l.phones, n.phone) THEN l.ids[list_position(l.phones, n.phone)] ELSE n.id END AS contact FROM l JOIN n ON n.tenant = l.tenant AND n.r = l.r + 1) s),
o AS (SELECT i.*, l.contact, CASE WHEN external_id <> '' THEN min(i.id) OVER (PARTITION BY i.tenant, platform, external_id) ELSE i.id END AS conv FROM inquiry i JOIN l ON l.id = i.id AND l.r > 0),
f AS (SELECT * FROM o WHERE conv = id),
m AS (SELECT id, contact, id = min(id) OVER (PARTITION BY contact) OR vehicle_id IS NOT NULL AND id = min(id) OVER (PARTITION BY contact, vehicle_id) AS makes FROM f),
d AS (SELECT f.id, CASE WHEN vehicle_id IS NOT NULL THEN min(f.id) OVER (PARTITION BY f.contact, vehicle_id) ELSE (SELECT max(m.id) FROM m WHERE m.makes AND m.contact = f.contact AND m.id <= f.id) END AS deal, state = 'listed' AND vehicle_id IS NOT NULL AND f.id = min(f.id) OVER (PARTITION BY tenant, vehicle_id) AS moves FROM f)
SELECT o.id, o.contact AS contact_id, o.conv AS conversation_id, o.conv = o.id AS fresh, coalesce(d.deal, -1) AS deal_id, coalesce(d.moves, false) AS moves FROM o LEFT JOIN d ON d.id = o.id""")(lambda i: inquiries(i).withColumn("deal_id", F.coalesce("deal_id", F.lit(-1).cast("long"))))

# ---------------------------------------------------------------- vehicles by reference


def found_vehicles(refs: DataFrame, vehicles: DataFrame) -> DataFrame:
    """(ref_id, tier, vehicle_id): of each reference (ref_id, ref) the vehicle (vehicle_id, external_id, vin, make, model, year) with that external
    id (tier 1), or else with that VIN (2), or else the newest one of the make that the first word names whose model holds the
    second word (3), whatever their case. References that find nothing are left out; the smallest id wins a tie.

    The third tier compares different (make, word) pairs with different (make, model) pairs, never references with vehicles."""
    asked = refs.where("ref <> ''").select("ref_id", "ref")
    vehicles = stored(vehicles.select("vehicle_id", "external_id", "vin", "make", "model", "year"), "vehicles")  # read for three aggregations
    one = lambda key: vehicles.where(F.col(key) != "").groupBy(F.col(key).alias("ref")).agg(F.min("vehicle_id").alias(key))
    met = asked.join(one("external_id"), "ref", "left").join(one("vin"), "ref", "left")
    words = F.split(F.trim(F.regexp_replace("ref", r"\s+", " ")), " ")
    met = stored(met.withColumn("make", F.lower(F.get(words, F.lit(0)))).withColumn("part", F.lower(F.get(words, F.lit(1)))), "references")
    pairs = met.where("external_id is null AND vin is null AND part is not null").select("make", "part").distinct()
    # Of each make and model the newest year's, one pass over the vehicles: the rest is as small as the number of models and years.
    years = vehicles.where("year is not null").groupBy("make", "model", "year").agg(F.min("vehicle_id").alias("third")).groupBy(F.lower("make").alias("make"), F.lower("model").alias("model"), "year").agg(F.min("third").alias("third"))
    models = years.groupBy("make", "model").agg(F.min_by("third", F.struct((-F.col("year")).alias("y"))).alias("third"), F.max("year").alias("year"))
    best = pairs.join(models, "make").where(F.contains("model", "part")).groupBy("make", "part").agg(F.min_by("third", F.struct((-F.col("year")).alias("y"), "third")).alias("third"))
    out = met.join(best, ["make", "part"], "left")
    tier = F.when(F.col("external_id").isNotNull(), 1).when(F.col("vin").isNotNull(), 2).otherwise(3)
    return out.select("ref_id", tier.alias("tier"), F.coalesce("external_id", "vin", "third").alias("vehicle_id")).where("vehicle_id is not null")


VIEWS["vehicle_ref"] = lambda d: """SELECT e.event_id AS ref_id, CASE e.event_id % 6 WHEN 0 THEN CAST(e.listing_id AS STRING) WHEN 1 THEN coalesce(v.vin, 'no such VIN') WHEN 2 THEN concat(upper(coalesce(v.make, 'bmw')), '  ', lower(coalesce(v.model, 'm1')), ' 2019') WHEN 3 THEN concat(coalesce(v.make, 'Audi'), ' m') WHEN 4 THEN coalesce(v.make, 'Audi') ELSE CASE WHEN e.event_id % 4 = 1 THEN '' ELSE 'Lada 4x4' END END AS ref
 FROM event e LEFT JOIN (SELECT lot, min(vin) AS vin, min(make) AS make, min(model) AS model FROM vehicle GROUP BY lot) v ON v.lot = e.listing_id"""
VIEWS["held_vehicle"] = lambda d: "SELECT vehicle_id, CAST(lot AS STRING) AS external_id, vin, make, model, year FROM vehicle"
frame("jon19_priority_fallback", ["vehicle_ref", "held_vehicle"], lambda d: """WITH a AS (SELECT external_id AS k, min(vehicle_id) AS v FROM held_vehicle GROUP BY 1), b AS (SELECT vin AS k, min(vehicle_id) AS v FROM held_vehicle GROUP BY 1),
w AS (SELECT ref_id, ref, string_split(regexp_replace(trim(ref), ' +', ' ', 'g'), ' ') AS words FROM vehicle_ref WHERE ref <> ''),
u AS (SELECT DISTINCT lower(words[1]) AS make, lower(words[2]) AS part FROM w WHERE len(words) >= 2),
c AS (SELECT u.make, u.part, h.vehicle_id, row_number() OVER (PARTITION BY u.make, u.part ORDER BY h.year DESC, h.vehicle_id) AS r FROM u JOIN held_vehicle h ON lower(h.make) = u.make AND lower(h.model) LIKE '%' || u.part || '%')
SELECT ref_id, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 ELSE 3 END AS tier, coalesce(a.v, b.v, c.vehicle_id) AS vehicle_id
FROM w LEFT JOIN a ON a.k = w.ref LEFT JOIN b ON b.k = w.ref LEFT JOIN c ON c.make = lower(words[1]) AND c.part = lower(words[2]) AND c.r = 1 WHERE coalesce(a.v, b.v, c.vehicle_id) IS NOT NULL""")(found_vehicles)

# ---------------------------------------------------------------- cards

# Where a vehicle may go from each state.
MOVES = {
    "sourcing": ("acquired",), "acquired": ("reconditioning", "listed"), "reconditioning": ("photography", "listed"), "photography": ("listed",), "listed": ("inquiry", "reserved", "sold"), "inquiry": ("negotiation", "listed"),
    "negotiation": ("reserved", "inquiry"), "reserved": ("sold", "negotiation"), "sold": ("in_transit",), "in_transit": ("delivered",), "delivered": (),
}


def moved(moves: DataFrame, limits: dict[str, int], start: str = "sourcing") -> DataFrame:
    """What becomes of each move (id, tenant, card, target), a tenant's in order of id: ``source`` (where the card lay), and ``outcome``:
    moved, not allowed (from there one can't go to the target), or full (the target holds as many cards as ``limits`` lets; without one: any number).
    A move that is refused changes nothing, which later ones see. A card that wasn't seen yet lies in ``start``; a move to where it lies is
    allowed where the column isn't full.

    A tenant's moves depend on each other, so they pass through one task, in order; it holds the cards' places, not the moves."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, places, held = None, {}, {}
        for batch in batches:
            source, outcome = [], []
            for own, card, target in zip(batch["tenant"].tolist(), batch["card"].tolist(), batch["target"].tolist()):
                if own != tenant:
                    tenant, places, held = own, {}, {}
                now = places.get(card, start)
                if card not in places:
                    places[card] = start
                    held[start] = held.get(start, 0) + 1
                source.append(now)
                if now != target and target not in MOVES.get(now, ()):
                    outcome.append("not allowed")
                elif target in limits and held.get(target, 0) >= limits[target]:
                    outcome.append("full")
                else:
                    outcome.append("moved")
                    held[now] -= 1
                    held[target] = held.get(target, 0) + 1
                    places[card] = target
            yield pd.DataFrame({"id": batch["id"], "source": source, "outcome": outcome})

    dealt = moves.select("id", "tenant", "card", "target").repartition("tenant").sortWithinPartitions("tenant", "id")
    return dealt.mapInPandas(read, "id long, source string, outcome string")


LIMITS = {"reconditioning": 3, "listed": 5, "inquiry": 2, "reserved": 1, "sold": 4}
_STEPS = ("acquired", "reconditioning", "photography", "listed", "inquiry", "negotiation", "reserved", "sold", "in_transit", "delivered", "listed", "acquired")
VIEWS["card_move"] = lambda d: f"SELECT event_id AS id, event_id % 40 AS tenant, listing_id % 19 AS card, CASE (event_id {d.div} 40 + listing_id) % {len(_STEPS)} {' '.join(f'WHEN {i} THEN {s!r}' for i, s in enumerate(_STEPS))} END AS target FROM event"


def _moves_sql(d) -> str:
    allowed = " OR ".join(f"now = '{a}' AND target IN ({', '.join(map(repr, b))})" for a, b in MOVES.items() if b)
    limit = "CASE target " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in LIMITS.items()) + " END"
    return f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY id) AS r FROM card_move),
l AS (SELECT tenant, 0 AS r, 0::BIGINT AS id, '' AS now, '' AS outcome, list_transform(range(19), lambda i: CASE WHEN i < 0 THEN 'sourcing' END) AS places FROM (SELECT DISTINCT tenant FROM card_move) t
 UNION ALL SELECT tenant, r, id, now, outcome, list_transform(range(19), lambda i: CASE WHEN i <> card THEN places[i + 1] WHEN outcome = 'moved' THEN target ELSE now END) FROM (
 SELECT *, CASE WHEN now <> target AND NOT ({allowed}) THEN 'not allowed' WHEN held >= {limit} THEN 'full' ELSE 'moved' END AS outcome FROM (
 SELECT n.tenant, n.r, n.id, n.card, n.target, l.places, coalesce(l.places[CAST(n.card AS INT) + 1], 'sourcing') AS now, len(list_filter(l.places, lambda p: p = n.target)) AS held FROM l JOIN n ON n.tenant = l.tenant AND n.r = l.r + 1) a) b)
SELECT id, now AS source, outcome FROM l WHERE r > 0"""


frame("sco11_transitions", ["card_move"], _moves_sql)(lambda m: moved(m, LIMITS))

# ---------------------------------------------------------------- clusters of hosts


def clustered_hosts(presences: DataFrame, least: int = 2) -> DataFrame:
    """Presences (host, dealer_id, country, domain, provider) of hosts that at least ``least`` dealers share: ``members``, the number of
    dealers of the host; ``filled``, the provider: its own, or else the first known one (by dealer and domain) of the host's presences
    in the same country, if there are two of these at least."""
    own = presences.withColumn("provider", F.nullif(F.col("provider"), F.lit("")))
    hosts = own.where("host <> ''").groupBy("host").agg(F.count_distinct("dealer_id").alias("members")).where(F.col("members") >= least)
    known = own.groupBy("host", "country").agg(F.count("*").alias("_n"), F.min_by("provider", F.when(F.col("provider").isNotNull(), F.struct("dealer_id", "domain"))).alias("_known"))
    out = own.join(hosts, "host").join(known, ["host", "country"])
    return out.select("host", "dealer_id", "domain", "members", F.coalesce("provider", F.when(F.col("_n") >= 2, F.col("_known"))).alias("filled"))


VIEWS["presence"] = lambda d: f"SELECT DISTINCT concat('10.0.', CAST(listing_id % 60 AS STRING), '.', CAST(event_id % 3 AS STRING)) AS host, listing_id AS dealer_id, CASE listing_id % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' ELSE 'ES' END AS country, concat('d', CAST(listing_id AS STRING), '-', event_type, '.example') AS domain, CASE WHEN event_type = 'purchase' THEN concat('dms', CAST(listing_id % 4 AS STRING)) WHEN event_type = 'error' THEN '' END AS provider FROM event"
frame("agg19_host_clusters", ["presence"], lambda d: """WITH c AS (SELECT host, count(DISTINCT dealer_id) AS members FROM presence GROUP BY host HAVING count(DISTINCT dealer_id) >= 2),
f AS (SELECT host, country, provider, row_number() OVER (PARTITION BY host, country ORDER BY dealer_id, domain) AS r FROM presence WHERE provider <> ''), s AS (SELECT host, country, count(*) AS n FROM presence GROUP BY 1, 2)
SELECT p.host, p.dealer_id, p.domain, c.members, CASE WHEN p.provider <> '' THEN p.provider WHEN s.n >= 2 THEN f.provider END AS filled FROM presence p JOIN c USING (host) JOIN s ON s.host = p.host AND s.country = p.country LEFT JOIN f ON f.host = p.host AND f.country = p.country AND f.r = 1""")(clustered_hosts)
