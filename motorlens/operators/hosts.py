"""Hosts of dealers by their names: the words of a name looked up inside the names that certificates were issued for (QRY25)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import frame
from ..plans.shared import stored

# Legal forms and trade words that no name is told by, words to be looked for only where a name has no other, and the
# top-level domain of each country.
LEGAL = "sas sasu sa sarl eurl snc gmbh ag kg ohg ug co srl spa sc sl sll bv nv ltd gbr ek auto autos automobiles automobile".split()
GENERAL = "garage autohaus concessionnaire auto motor motors car cars voiture coche coches the".split()
TLD = {"FR": "fr", "DE": "de", "ES": "es", "NL": "nl", "BE": "be", "CH": "ch"}

#: Letters whose compatibility decomposition is plain ASCII once its marks are gone: Latin letters, ligatures, full-width forms.
FOLDED = [*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF10, 0xFF5B)]


def folded(text: Column) -> Column:
    """Lower case without accents. One translation for letters that stay one letter; the few that become several are replaced one by one."""
    plain = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in FOLDED}
    plain = {k: v for k, v in plain.items() if v != k and v.isascii() and v.isalnum()}
    single = {k: v for k, v in plain.items() if len(v) == 1}
    out = F.translate(F.lower(text), "".join(single), "".join(single.values()))
    for k, v in plain.items():
        if len(v) > 1 and k == k.lower():
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(out, r"\p{Mn}", "")


def anchors(name: Column) -> Column:
    """The two longest words of at least three letters that aren't a legal form, general ones only where there are no others; the
    earlier of equally long ones first."""
    words = F.filter(F.split(F.regexp_replace(folded(name), "[^a-z0-9-]+", " "), " "), lambda w: (F.length(w) >= 3) & ~w.isin(LEGAL))
    own = F.filter(words, lambda w: ~w.isin(GENERAL))
    chosen = F.when(F.size(own) > 0, own).otherwise(words)
    ranked = F.array_sort(F.transform(chosen, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, 2), lambda r: r["w"])


def apexes(issued: DataFrame) -> DataFrame:
    """Different registrable names (tld, label) under the countries' top-level domains; a leading wildcard goes, names with blanks too."""
    host = F.regexp_replace(F.lower(F.trim("name_value")), r"^\*\.", "")
    last = issued.select(host.alias("host")).where("instr(host, ' ') = 0 and instr(host, '.') > 0").select(F.substring_index("host", ".", -2).alias("apex"))
    return last.select(F.substring_index("apex", ".", -1).alias("tld"), F.substring_index("apex", ".", 1).alias("label")).where(F.col("tld").isin(list(TLD.values())) & (F.length("label") >= 3)).distinct()


def grams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def hosts_of(names: DataFrame, issued: DataFrame) -> DataFrame:
    """For each row of ``names`` (id, name, country) the shortest registrable name in ``issued`` (name_value) under its country's top-level domain
    that holds the name's anchors, the first in ASCII order of equally short ones; null without one.

    An index of the labels' trigrams stands for the search by pattern: names with equal anchors ask once, and each asks with the
    trigram of its anchors that the fewest labels hold, so labels are compared only with names that share a rare trigram; then the anchors
    themselves are looked for. A trigram that no label holds answers at once. Null or wordless names, names of other countries: null; repeated
    rows are answered each; empty tables give no rows, or nulls.
    """
    labels = stored(apexes(issued), "host-labels")
    index = labels.select("tld", "label", F.explode(grams(F.col("label"))).alias("gram"))
    tld = F.coalesce(*(F.when(F.col("country") == k, F.lit(v)) for k, v in TLD.items()))
    words = anchors(F.col("name"))
    asked = names.select("id", tld.alias("tld"), F.get(words, F.lit(0)).alias("first"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("second"))
    kinds = asked.where("tld is not null and first is not null").select("tld", "first", "second").distinct()
    both = F.array_union(grams(F.col("first")), F.when(F.col("second") != "", grams(F.col("second"))).otherwise(F.array().cast("array<string>")))
    held = index.groupBy("tld", "gram").agg(F.count("*").alias("held"))
    counted = kinds.withColumn("gram", F.explode(both)).join(held, ["tld", "gram"], "left")
    rarest = counted.groupBy("tld", "first", "second").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("r")).where("r.held > 0").select("tld", "first", "second", F.col("r.gram").alias("gram"))
    met = rarest.join(index, ["tld", "gram"]).where(F.contains("label", "first") & F.contains("label", "second"))
    found = met.groupBy("tld", "first", "second").agg(F.min(F.struct(F.length("label").alias("n"), "label")).alias("best"))
    return asked.join(found, ["tld", "first", "second"], "left").select("id", F.concat_ws(" ", "first", F.nullif("second", F.lit(""))).alias("anchors"), F.concat("best.label", F.lit("."), "tld").alias("host"))


def _sql(d) -> str:
    """By brute force: each name against each label of its country."""
    tlds = ", ".join(f"('{k}', '{v}')" for k, v in TLD.items())
    legal, general = (", ".join(f"'{w}'" for w in ws) for ws in (LEGAL, GENERAL))
    return f"""WITH tlds(country, tld) AS (VALUES {tlds}), w AS (SELECT id, country, list_filter(string_split_regex(strip_accents(lower(name)), '[^a-z0-9-]+'), lambda x: length(x) >= 3 AND NOT list_contains([{legal}], x)) AS words FROM trade_name),
o AS (SELECT id, country, words, list_filter(words, lambda x: NOT list_contains([{general}], x)) AS own FROM w), c AS (SELECT id, country, CASE WHEN len(own) > 0 THEN own ELSE words END AS words FROM o),
u AS (SELECT id, country, words[i] AS word, i FROM (SELECT id, country, words, unnest(range(1, len(words) + 1)) AS i FROM c) x), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(word) DESC, i) AS nth FROM u),
a AS (SELECT n.id, t.tld, max(CASE WHEN nth = 1 THEN word END) AS w1, coalesce(max(CASE WHEN nth = 2 THEN word END), '') AS w2 FROM trade_name n LEFT JOIN tlds t ON t.country = n.country LEFT JOIN r ON r.id = n.id GROUP BY 1, 2),
h AS (SELECT regexp_replace(lower(trim(name_value)), '^\\*\\.', '') AS host FROM certificate_name), p AS (SELECT DISTINCT string_split(host, '.')[-1] AS tld, string_split(host, '.')[-2] AS label FROM h WHERE NOT contains(host, ' ') AND contains(host, '.')),
m AS (SELECT a.id, arg_min(label, (length(label), label)) AS label FROM a JOIN p ON p.tld = a.tld AND contains(label, w1) AND contains(label, w2) GROUP BY 1)
SELECT a.id, concat_ws(' ', w1, nullif(w2, '')) AS anchors, label || '.' || tld AS host FROM a LEFT JOIN m ON m.id = a.id"""


frame("qry25_hosts", ["trade_name", "certificate_name"], _sql)(hosts_of)
