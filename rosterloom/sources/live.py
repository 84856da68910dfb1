"""The tables of a roster read from its services: what ``factory.build`` asks for by name, with the filters of a run in the scan.

A table that is used more than once is read once and written to the shared folder: services are slow, and two reads may differ.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import text
from rosterloom.operators.lineage import written
from rosterloom.sources import http

Tables = Callable[[str], DataFrame]

#: Tables and columns of the federal service.
FEDERAL = {
    "members": ("MemberCouncil", "ID:number, Language, PersonNumber:number, Active:boolean, FirstName, LastName, Council:number, CouncilAbbreviation, CantonAbbreviation, ParlGroupAbbreviation, PartyAbbreviation, DateJoining, DateLeaving, DateOfBirth, BirthPlace_City, BirthPlace_Canton, Citizenship, NumberOfChildren:number"),
    "history": ("MemberCouncilHistory", "ID:number, Language, PersonNumber:number, CouncilAbbreviation, DateJoining, DateLeaving"),
    "periods": ("LegislativePeriod", "ID:number, Language, LegislativePeriodNumber:number, LegislativePeriodName, StartDate, EndDate"),
}
#: The records of a mandate index and a contact index.
MANDATE = (
    "Mitglied struct<_OBJ_GUID string, Dauer struct<Start string, End string, Text string>, Funktion array<string>, Gremium string, GremiumName string, "
    "Person struct<Kontakt struct<_OBJ_GUID string, Name string, Vorname string, Wahlkreis string, Partei string, Fraktion string>>>"
)
CONTACT = "Kontakt struct<_OBJ_GUID string, Name string, Vorname string, NameVorname string, Beruf array<string>, Homepageprivat string, Partei string, Fraktion string, Wahlkreis string, Jahrgang string>"


class Read:
    """Tables by name; each is made once and kept as a written table."""

    def __init__(self, tables: dict[str, Callable[[], DataFrame]]):
        self._tables, self._kept = tables, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = written(self._tables[name](), name)
        return self._kept[name]


def federal(spark: SparkSession, url: str, councils: Sequence[str], language: str = "DE", active: bool = True, size: int = 1000, delay: float = 1.0, agent: str = http.AGENT) -> Tables:
    """The federal tables of one language. Language, council and activity are filters of the scan, so the service sends no other row; it is
    asked for councils as they are written, and the source's own looser comparison still follows."""
    http.register(spark)

    def table(name: str) -> DataFrame:
        path, columns = FEDERAL[name]
        df = spark.read.format("odata").options(url=f"{url}/{path}", columns=columns, size=str(size), delay=str(delay), agent=agent).load().filter(F.col("Language") == language)
        if name != "periods":
            df = df.filter(F.col("CouncilAbbreviation").isin(*councils))
        return df.filter(F.col("Active") == "true") if name == "members" and active else df

    return Read({name: (lambda name=name: table(name)) for name in FEDERAL})


def _blank(x):
    """Text, or null where an element is empty, nil or missing."""
    return text.blank_to_null(x)


def records(spark: SparkSession, url: str, schema: str, tag: str = "Hit", size: int = 500, delay: float = 1.0, agent: str = http.AGENT) -> DataFrame:
    """The records of a paged index under an explicit schema: nested elements are structs, repeated ones arrays, nil ones null."""
    http.register(spark)
    pages = spark.read.format("paged_xml").options(url=url, record=tag, size=str(size), delay=str(delay), agent=agent).load()
    return pages.select(F.from_xml("value", schema, {"ignoreNamespace": "true", "rowTag": tag, "nullValue": "", "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def mandates(spark: SparkSession, mandate_url: str, contact_url: str, size: int = 500, delay: float = 1.0, agent: str = http.AGENT) -> Tables:
    """The mandates and contacts of a council's records system as flat tables. Addresses have ``{start}`` and ``{size}``."""

    def own() -> DataFrame:
        m, k = F.col("Mitglied"), F.col("Mitglied.Person.Kontakt")
        return records(spark, mandate_url, MANDATE, size=size, delay=delay, agent=agent).select(
            _blank(k["_OBJ_GUID"]).alias("kontaktguid"), _blank(F.coalesce(_blank(m["Gremium"]), m["GremiumName"])).alias("gremium"), _blank(F.array_join(m["Funktion"], "; ")).alias("funktion"),
            _blank(m["Dauer"]["Start"]).alias("dauer_start"), _blank(m["Dauer"]["End"]).alias("dauer_end"), *[_blank(k[c]).alias(c.lower()) for c in ("Name", "Vorname", "Wahlkreis", "Partei")],
        )

    def people() -> DataFrame:
        k = F.col("Kontakt")
        found = records(spark, contact_url, CONTACT, size=size, delay=delay, agent=agent).filter(k.isNotNull())
        plain = [_blank(k[c]).alias(c.lower()) for c in ("Name", "Vorname", "NameVorname", "Partei", "Fraktion", "Wahlkreis", "Jahrgang")]
        return found.select(_blank(k["_OBJ_GUID"]).alias("obj_guid"), *plain, _blank(F.array_join(k["Beruf"], "; ")).alias("beruf"), _blank(k["Homepageprivat"]).alias("homepageprivat"))

    return Read({"mandates": own, "persons": people})
