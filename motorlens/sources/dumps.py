"""Saved answers of dealer sources, families A to O, as one table of dealers.

A source is a specification: where the entries of an answer lie, and which paths give each field. One function reads all of
them, so an answer is a row and its entries are exploded where they are read. Fetching is left to others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

FIELDS = ("name", "identifier", "street", "postal_code", "city", "country", "lat", "lng", "phone", "email", "website")
SCHEMA = ("family", "source", "id_type", *FIELDS)


@dataclass(frozen=True)
class Source:
    """``items``: paths of the array of entries ('$' is the answer itself), the first that is there counts; ``fields``: paths within an
    entry, the first that is there counts; paths in a tuple within the list are joined by blanks. ``keep``: path and value that an
    entry must have. ``inside``: a pattern whose first group is the JSON within a page."""

    family: str
    items: tuple[str, ...]
    fields: dict[str, tuple]
    id_type: str = "ID"
    country: str | None = None
    keep: tuple[str, str] | None = None
    inside: str | None = None


_MAKER = {
    "identifier": ("$.id", "$.dealerId", "$.code", "$.dealershipId", "$.dealerCode", "$.siteId"), "name": ("$.name",), "street": ("$.address.street",), "postal_code": ("$.address.postalCode", "$.address.zipCode"), "city": ("$.address.city",),
    "country": ("$.address.countryCode", "$.address.country"), "phone": ("$.phone",), "website": ("$.website", "$.url"),
}
_NEXT = r'(?s)<script id="__NEXT_DATA__"[^>]*>\s*(.*?)\s*</script>'
SOURCES = {
    "sirene": Source("A", ("$.etablissements",), {"identifier": ("$.siret",), "name": ("$.uniteLegale.denominationUniteLegale", ("$.uniteLegale.prenomUsuelUniteLegale", "$.uniteLegale.nomUniteLegale")), "street": (("$.adresseEtablissement.numeroVoieEtablissement", "$.adresseEtablissement.typeVoieEtablissement", "$.adresseEtablissement.libelleVoieEtablissement"),), "postal_code": ("$.adresseEtablissement.codePostalEtablissement",), "city": ("$.adresseEtablissement.libelleCommuneEtablissement",)}, "SIRET", "FR", ("$.uniteLegale.etatAdministratifUniteLegale", "A")),
    "kvk": Source("A", ("$.resultaten",), {"identifier": ("$.kvkNummer",), "name": ("$.naam",), "street": (("$.adres.binnenlandsAdres.straatnaam", "$.adres.binnenlandsAdres.huisnummer"),), "postal_code": ("$.adres.binnenlandsAdres.postcode",), "city": ("$.adres.binnenlandsAdres.plaats",)}, "KVK", "NL"),
    "overpass": Source("B", ("$.elements",), {"identifier": (("$.type", "$.id"),), "name": ("$.tags.name",), "street": (("$.tags['addr:street']", "$.tags['addr:housenumber']"),), "postal_code": ("$.tags['addr:postcode']",), "city": ("$.tags['addr:city']",), "country": ("$.tags['addr:country']",), "lat": ("$.lat", "$.center.lat"), "lng": ("$.lon", "$.center.lon"), "phone": ("$.tags.phone", "$.tags['contact:phone']"), "email": ("$.tags.email",), "website": ("$.tags.website", "$.tags['contact:website']")}, "OSM"),
    "wikidata": Source("B", ("$.results.bindings",), {"identifier": ("$.dealer.value",), "name": ("$.dealerLabel.value",), "website": ("$.website.value",), "lat": ("$.coords.value",), "lng": ("$.coords.value",)}, "WIKIDATA"),
    "certificates": Source("C", ("$",), {"identifier": ("$.id",), "name": ("$.common_name",), "website": ("$.name_value",)}, "CERT"),
    "archive": Source("C", ("$.archived_snapshots",), {"identifier": ("$.timestamp",), "website": ("$.url",)}, "SNAPSHOT"),
    "autoscout": Source("F", ("$.props.pageProps.dealerInfoPage",), {"identifier": ("$.id",), "name": ("$.name",), "street": ("$.address.street",), "postal_code": ("$.address.zip",), "city": ("$.address.city",), "country": ("$.address.countryCode",), "phone": ("$.contact.phone",), "email": ("$.contact.email",), "website": ("$.contact.website",)}, inside=_NEXT),
    "bovag": Source("G", ("$.props.pageProps.page",), {"identifier": ("$.kvkNumber", "$.memberId"), "name": ("$.name",), "street": (("$.address.street", "$.address.housenumber"),), "postal_code": ("$.address.postalCode",), "city": ("$.address.city",), "phone": ("$.phoneNumber",), "email": ("$.email",), "website": ("$.website",)}, "KVK", "NL", inside=_NEXT),
    "mobilians": Source("G", ("$.hits", "$.members"), {"identifier": ("$.id",), "name": ("$.title", "$.name"), "street": ("$.street",), "postal_code": ("$.zip",), "city": ("$.city",), "phone": ("$.phone",), "email": ("$.email",), "website": ("$.url",)}, "MEMBER", "FR"),
    "makers": Source("H", ("$.dealers", "$.dealerships", "$.result.dealers"), _MAKER, "MAKER"),
    "rdw": Source("I", ("$",), {"identifier": ("$.volgnummer",), "name": ("$.handelsnaam",), "street": (("$.straat", "$.huisnummer"),), "postal_code": ("$.postcode",), "city": ("$.plaatsnaam",)}, "RDW", "NL"),
    "utac": Source("I", ("$.results",), {"identifier": ("$.no_agrement",), "name": ("$.nom_centre",), "street": ("$.adresse",), "postal_code": ("$.code_postal",), "city": ("$.commune",), "phone": ("$.telephone",)}, "UTAC", "FR"),
    "pappers": Source("J", ("$.resultats",), {"identifier": ("$.siret", "$.siren"), "name": ("$.nom_entreprise",), "street": ("$.siege.adresse_ligne_1",), "postal_code": ("$.siege.code_postal",), "city": ("$.siege.ville",)}, "SIRET", "FR"),
    "searxng": Source("K", ("$.results",), {"name": ("$.title",), "website": ("$.url",)}, "RESULT"),
    "youtube": Source("L", ("$.items",), {"identifier": ("$.id.channelId", "$.snippet.channelId"), "name": ("$.snippet.title",), "country": ("$.snippet.country",)}, "CHANNEL"),
    "vies": Source("M", ("$",), {"identifier": ("$.vatNumber",), "name": ("$.name",), "street": ("$.address",), "country": ("$.countryCode",)}, "VAT", keep=("$.isValid", "true")),
    "censys": Source("N", ("$.result.hits",), {"identifier": ("$.ip",)}, "IP"),
    "shodan": Source("N", ("$.matches",), {"identifier": ("$.ip_str",), "website": ("$.hostnames[0]",)}, "IP"),
    "gdelt": Source("O", ("$.articles",), {"name": ("$.title",), "website": ("$.url",), "country": ("$.sourcecountry",)}, "ARTICLE"),
}


def _value(item, paths: tuple) -> Column:
    """The first path that gives something; an inner tuple's parts are joined by blanks."""
    one = lambda p: F.nullif(F.trim(F.get_json_object(item, p)), F.lit(""))
    return F.coalesce(*(F.nullif(F.concat_ws(" ", *map(one, p)), F.lit("")) if isinstance(p, tuple) else one(p) for p in paths), F.lit(None).cast("string"))


def _entries(body: Column, path: str) -> Column:
    """The entries at a path; a single object is one entry."""
    at = body if path == "$" else F.get_json_object(body, path)
    return F.when(F.startswith(F.ltrim(at), F.lit("[")), F.from_json(at, "array<string>")).when(F.startswith(F.ltrim(at), F.lit("{")), F.array(at))


def dealers(answers: DataFrame, name: str, body: str = "body") -> DataFrame:
    """Dealers in the answers of source ``name`` (a column of JSON texts or pages), one row each; what isn't of its form gives none."""
    source = SOURCES[name]
    read = F.regexp_extract(body, source.inside, 1) if source.inside else F.col(body)
    items = answers.select(F.explode(F.coalesce(*(_entries(read, p) for p in source.items))).alias("item")).where("item is not null")
    if source.keep:
        items = items.where(F.get_json_object("item", source.keep[0]) == source.keep[1])
    values = {f: _value("item", source.fields.get(f, ())) for f in FIELDS}
    if source.country:
        values["country"] = F.coalesce(values["country"], F.lit(source.country))
    if name == "wikidata":
        for i, f in enumerate(("lng", "lat")):
            values[f] = F.nullif(F.regexp_extract(values[f], r"Point\(([-0-9.]+) ([-0-9.]+)\)", i + 1), F.lit(""))
    out = items.select(F.lit(source.family).alias("family"), F.lit(name).alias("source"), F.lit(source.id_type).alias("id_type"), *(v.try_cast("double").alias(f) if f in ("lat", "lng") else v.alias(f) for f, v in values.items()))
    if name == "certificates":
        # A certificate names several hosts, one a line.
        out = out.withColumn("website", F.explode(F.split("website", "\n"))).where(~F.startswith("website", F.lit("*."))).dropDuplicates(["website"])
    return out.where(F.coalesce("name", "identifier", "website").isNotNull())


def registry_xml(pages: DataFrame, column: str = "xml") -> DataFrame:
    """Companies of a commercial register's daily summary (family A): id, name, act and province."""
    one = lambda tag: F.nullif(F.trim(F.regexp_extract("e", rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    found = pages.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<empresa .*?</empresa>"), 0)).alias("e"))
    return found.select(F.regexp_extract("e", r'<empresa id="([^"]*)"', 1).alias("identifier"), one("nombre_empresa").alias("name"), one("acto").alias("act"), one("provincia").alias("province"))


def directory_cards(pages: DataFrame, card: str, fields: dict[str, str], column: str = "html") -> DataFrame:
    """Cards of a directory page (families F and G): ``card`` matches one card, ``fields`` patterns take their first group from it."""
    found = pages.select(F.explode(F.regexp_extract_all(column, F.lit(card), 0)).alias("c"))
    bare = lambda x: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " ")), F.lit(""))
    return found.select(*(bare(F.regexp_extract("c", p, 1)).alias(n) for n, p in fields.items()))


CARDS = {
    "mobile": (r'(?s)<div class="dealerItem">.*?</div>', {"name": r"(?s)<h3>(.*?)</h3>", "address": r"(?s)</h3>(.*?)<a", "website": r'href="(https?://[^"]+)"'}),
    "lacentrale": (r'(?s)<article class="garageCard".*?</article>', {"identifier": r'data-garage-id="([^"]*)"', "name": r'(?s)class="garageName">(.*?)</h2>', "address": r'(?s)class="garageAddress">(.*?)</address>', "phone": r'class="garagePhone">([^<]*)<', "website": r'href="(https?://[^"]+)" class="garageWebsite"'}),
    "mobilians": (r'(?s)<article class="uk-article.*?</article>', {"name": r"(?s)<h2>(.*?)</h2>", "street": r"(?s)</h2>\s*<p>(.*?)</p>", "email": r'href="mailto:([^"]*)"', "website": r'href="(https?://[^"]+)"'}),
}

#: Signs of content systems in pages (family D), the first that is found counts.
SYSTEMS = (("wordpress", r'(?i)<meta[^>]+generator[^>]+wordpress|wp-content/|wp-includes/|/wp-json'), ("joomla", r'(?i)<meta[^>]+generator[^>]+joomla|/media/jui/|option=com_'), ("drupal", r'(?i)<meta[^>]+generator[^>]+drupal|drupal-settings-json|/sites/default/files'))


def content_system(html) -> Column:
    """(system, version) of the software that made a page; null if unknown."""
    name = F.coalesce(*(F.when(F.rlike(html, F.lit(p)), n) for n, p in SYSTEMS))
    version = F.nullif(F.regexp_extract(html, r"(?i)(?:wordpress|joomla!?|drupal)\s+([\d.]+)", 1), F.lit(""))
    return F.when(name.isNotNull(), F.struct(name.alias("system"), version.alias("version")))


def shared_hosts(hosts: DataFrame, least: int = 2) -> DataFrame:
    """Addresses (family E) that ``least`` dealers or more share: (host, dealers, provider), the provider that is known for any."""
    found = hosts.groupBy("host").agg(F.array_sort(F.collect_set("dealer_id")).alias("dealers"), F.min("provider").alias("provider"))
    return found.where(F.size("dealers") >= least)


def article_dealers(found: DataFrame, column: str = "name") -> DataFrame:
    """Dealers' names in titles or texts of the press (family O)."""
    return found.select("*", F.explode(text.dealer_names(column)).alias("d")).select(F.lit("O").alias("family"), "website", F.col("d.raw").alias("raw"), F.col("d.normal").alias("normal"))


def confirmed(tables: list[DataFrame], weights: dict[str, float]) -> DataFrame:
    """Confidence of each normal name: the weights of the families that found it, each once, at most 1."""
    rows = reduce(DataFrame.unionByName, [t.select("family", text.dealer_name("name").alias("normal")) for t in tables]).where("normal <> ''").distinct()
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("family")]
    return rows.groupBy("normal").agg(F.round(F.least(F.lit(1.0), F.sum(weight)), 4).alias("confidence"), F.count("*").alias("families"))
