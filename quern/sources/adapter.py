"""The synthetic customers as linkage records, by one expression for Spark and DuckDB.

Seven customers in a row share an entity: the first is its S1 record, the next three its copies in S2, the rest those in S3.
In every fourth entity the last copy of each source, and in every eighteenth all copies, are entities of their own that
match nothing. An entity has words, a legal form and an address by arithmetic on its number; a copy spells them with a
kind of noise by its own key: case, digits for letters, aliases, web domains, accents, native script, other legal
spellings, abbreviations, missing parts, postcodes. Names repeat across entities. Fields are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import spread, stage, table

FIRST = "Summit Harbor Cedar Meridian Orchard Lantern Granite Willow Falcon Prairie Copper Juniper Atlas Beacon Clover Drake Ember Foster Garnet Heron Indigo Jasper Keystone Laurel Monarch Nimbus Opal Pioneer Quarry Raven Sable Timber".split()
SECOND = "Foods Textiles Logistics Chemicals Motors Pharmacy Bakery Optics Ceramics Plastics Dairy Printing Hardware Fisheries Tannery Vineyards Foundry Builders".split()
THIRD = "Group Services Partners Works Trading Supply".split()
#: Per country the legal form and another spelling of it.
LEGAL = {"us": ("Inc", "Incorporated"), "in": ("Pvt Ltd", "Private Limited"), "fr": ("SARL", "Sarl")}
NATIVE_NAMES = "सिटी प्राइवेट,हरि मार्केटिंग,गंगा फूड्स,राम टेक्सटाइल,शिव मोटर्स".split(",")
STREETS = "Hackberry,Barren River,McDonald Hill,Victoria,Lotus,Station,Mill,Temple,Market,Chapel,Garden,Bridge,Canal,Forest,Quarry,Sunset,College,Lake,Orchard".split(",")
#: Per country kinds of streets, cities with another name of theirs, and states as name, code and native name.
KINDS = {"us": ("Street", "Avenue", "Boulevard", "Drive", "Parkway"), "in": ("Road", "Marg", "Nagar", "Sector", "Colony"), "fr": ("Rue", "Chemin", "Impasse", "Route", "Cours")}
CITIES = {
    "us": ("Tilden", "Erlanger", "Chillicothe", "Fort Wayne", "Mount Airy"), "in": ("Mumbai", "Kolkata", "Bangalore", "Chennai", "Pune"),
    "fr": ("Lille", "Rennes", "Tours", "Caen", "Nantes"),
}
RENAMED = {"us": ("Tilden", "Erlanger", "Chillicothe", "Ft Wayne", "Mt Airy"), "in": ("Bombay", "Calcutta", "Bengaluru", "Madras", "Poona"), "fr": ("Lille", "Rennes", "Tours", "Caen", "Nantes")}
STATES = {
    "us": ("Texas", "Kentucky", "Ohio", "Indiana", "North Carolina"), "in": ("Maharashtra", "West Bengal", "Karnataka", "Tamil Nadu", "Gujarat"),
    "fr": ("Nord", "Bretagne", "Centre-Val de Loire", "Normandie", "Pays de la Loire"),
}
CODES = {"us": ("TX", "KY", "OH", "IN", "NC"), "in": ("MH", "WB", "KA", "TN", "GJ"), "fr": ("Hauts-de-France", "Bretagne", "Centre Val de Loire", "Normandie", "Pays de la Loire")}
NATIVE_STATES = {"in": ("महाराष्ट्र", "पश्चिम बंगाल", "कर्नाटक", "तमिलनाडु", "गुजरात")}


#: Which of its country's places an entity has.
PLACE = "ent % 11 * 3 + ent % 7"


def _list(values, index: str, duck: bool) -> str:
    """The value at ``index`` modulo the number of values."""
    joined, i = ",".join(values), f"CAST(({index}) % {len(values)} + 1 AS INT)"
    return f"string_split('{joined}', ',')[{i}]" if duck else f"element_at(split('{joined}', ','), {i})"


def _by_country(tables: dict, index: str, duck: bool, rest: str | None = None) -> str:
    cases = " ".join(f"WHEN '{c}' THEN {_list(values, index, duck)}" for c, values in tables.items())
    return f"CASE country {cases}{f' ELSE {rest}' if rest else ''} END"


def expressions(duck: bool) -> list[dict[str, str]]:
    """Layers of columns over c_custkey; each layer may use the columns of those before."""
    pick = lambda t, i: _list(t, i, duck)
    land = lambda t, i, rest=None: _by_country(t, i, duck, rest)
    return [
        {"pos": "c_custkey % 7", "base": "c_custkey - c_custkey % 7"},
        {"lone": "pos > 0 AND (base % 18 = 7 OR (base % 4 = 0 AND pos % 3 = 0))"},
        {"ent": "CASE WHEN lone THEN c_custkey + 1000003 ELSE base END", "country": "CASE base % 5 WHEN 0 THEN 'in' WHEN 1 THEN 'in' WHEN 2 THEN 'fr' ELSE 'us' END",
         "src": "CASE WHEN pos = 0 THEN 'S1' WHEN pos < 4 THEN 'S2' ELSE 'S3' END", "nv": "CASE WHEN pos = 0 THEN 0 ELSE c_custkey % 97 % 16 END", "av": "CASE WHEN pos = 0 THEN 0 ELSE c_custkey % 89 % 15 END"},
        {"w1": pick(FIRST, "ent * 13 + ent % 101 + ent % 37"), "w2": pick(SECOND, "ent * 5 + ent % 23"), "w3": f"CASE WHEN ent % 3 = 0 THEN concat(' ', {pick(THIRD, 'ent')}) ELSE '' END",
         "legal": land({k: (v[0],) for k, v in LEGAL.items()}, "0"), "legal2": land({k: (v[1],) for k, v in LEGAL.items()}, "0"), "other": pick(FIRST, "ent * 13 + 5"),
         "native": pick(NATIVE_NAMES, "ent"), "num": "CAST(ent * 37 % 8900 + 3 AS VARCHAR(12))" if duck else "CAST(ent * 37 % 8900 + 3 AS STRING)",
         "street": pick(STREETS, "ent * 7 + ent % 11"), "kind": land(KINDS, "ent"), "city": land(CITIES, PLACE), "city2": land(RENAMED, PLACE),
         "state": land(STATES, PLACE), "code": land(CODES, PLACE), "native_state": land(NATIVE_STATES, PLACE, "''"),
         "post": "CAST(CASE country WHEN 'in' THEN 400000 ELSE 50000 END + ent % 9000 AS VARCHAR(12))" if duck else "CAST(CASE country WHEN 'in' THEN 400000 ELSE 50000 END + ent % 9000 AS STRING)"},
        {"plain": "concat(w1, ' ', w2, w3)", "way": "CASE country WHEN 'fr' THEN concat(num, ' ', kind, ' ', street) ELSE concat(num, ' ', street, ' ', kind) END"},
        {"business_name": "CASE nv WHEN 1 THEN upper(concat(plain, ' ', legal)) WHEN 2 THEN concat(plain, ' ', legal2) WHEN 3 THEN concat(replace(w1, 'e', '3'), ' ', w2, w3) "
         "WHEN 4 THEN concat(other, ' Holdings dba ', plain) WHEN 5 THEN lower(concat(w1, w2, '.com')) WHEN 6 THEN lower(concat(w1, w2, 'com')) WHEN 7 THEN replace(replace(plain, 'e', 'é'), 'a', 'à') "
         "WHEN 8 THEN CASE country WHEN 'in' THEN native ELSE concat(w1, ' & ', w2) END WHEN 9 THEN CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE plain END WHEN 10 THEN concat(substr(w1, 1, 2), substr(w1, 4), ' ', w2, w3) "
         "WHEN 11 THEN concat('The ', w2, ' of ', w1, ', ', legal) WHEN 12 THEN concat(lower(w1), '-', lower(w2), '.net ', legal2) WHEN 13 THEN concat(plain, ' formerly ', other, '  ', w2) WHEN 14 THEN concat(plain, ' | ', legal) WHEN 15 THEN concat(w1, ' ** ', w2, w3) ELSE concat(plain, ' ', legal) END",
         "business_address": "CASE av WHEN 1 THEN upper(concat(way, ', ', city, ', ', state)) WHEN 2 THEN concat('00', way, ', # UNIT 2, ', city, ', ', code) WHEN 3 THEN concat(way, ', ', city, ', ', code) "
         "WHEN 4 THEN CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '--' ELSE 'NULL' END WHEN 5 THEN concat(way, ', ', city2, ', ', state) WHEN 6 THEN concat(way, ', ', city) "
         "WHEN 7 THEN concat(way, ', ', city, ', ', CASE country WHEN 'in' THEN native_state ELSE state END) WHEN 8 THEN concat(way, ', ', post, ' ', city, ', ', state) WHEN 9 THEN concat(way, ', ', city, ' CDP, ', state) "
         "WHEN 10 THEN concat(way, ', null, ', state) WHEN 11 THEN concat(num, 'A ', street, ', ', city, ', ', code) WHEN 12 THEN concat('No ', num, ' Shop 4, ', street, ' Saint, ', city2, ' ', post) "
         "WHEN 13 THEN concat(state, ', ', city, ', ', way) WHEN 14 THEN replace(concat(street, ', ', city, ', ', state), 'e', 'é') ELSE concat(way, ', ', city, ' ', post, ', ', state) END"},
    ]


KEPT = ("entity_id", "business_name", "business_address", "country", "src")
IDENT = "concat(src, '-', CAST(c_custkey AS {}))"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records and ``ent``, the entity that each is of; written once, so that plans on them start from a scan."""
    df = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    for layer in expressions(False):
        df = df.withColumns({k: F.expr(v) for k, v in layer.items()})
    return stage(df.select(F.expr(IDENT.format("STRING")).alias("entity_id"), *KEPT[1:], "ent"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, business_name, business_address, country, src)."""
    return entities(spark, sf_dir).drop("ent")


def true_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1, m, country) of records of one entity."""
    rec = entities(spark, sf_dir)
    a = rec.filter("src = 'S1'").select(F.col("entity_id").alias("s1"), "country", "ent")
    b = rec.filter("src <> 'S1'").select(F.col("entity_id").alias("m"), "ent")
    return a.join(b, "ent").select("s1", "m", "country")


def _sql() -> str:
    out, last = [], "customer"
    for i, layer in enumerate(expressions(True)):
        out.append(f"rec{i} AS (SELECT {'c_custkey' if last == 'customer' else '*'}, {', '.join(f'{v} AS {k}' for k, v in layer.items())} FROM {last})")
        last = f"rec{i}"
    out.append(f"recs AS (SELECT {IDENT.format('VARCHAR')} AS entity_id, {', '.join(KEPT[1:])}, ent FROM {last})")
    out.append("rec AS (SELECT * EXCLUDE (ent) FROM recs)")
    out.append("truth AS (SELECT a.entity_id AS s1, b.entity_id AS m, a.country FROM recs a JOIN recs b ON a.ent = b.ent AND a.src = 'S1' AND b.src <> 'S1')")
    return ",\n".join(out)


#: CTEs rec (entity_id, business_name, business_address, country, src) and truth (s1, m, country).
SQL = _sql()
