"""Tables behind addresses (JSON pages, XML indexes, OData, query endpoints), read on the executors with pacing and retries.

Registered as data source ``paged_json``; a page is a partition, so pages are read in parallel by as many
tasks as the service's pacing allows. Rows are the JSON text of each record: their schema is applied
afterwards, explicitly.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: Statuses worth another try, how often, and the first pause between tries (it doubles).
RETRIED = (429, 500, 502, 503, 504)
ATTEMPTS = 4
FIRST_PAUSE = 2.0
#: A run should name itself; this stands where nothing is configured.
AGENT = "rosterloom"


def get_json(url: str, fetch: Callable[[str], bytes] | None = None, least_delay: float = 1.0, timeout: float = 60.0, sleep: Callable[[float], None] = time.sleep, parse: Callable = json.loads, agent: str = AGENT):
    """The document at ``url``, parsed (as JSON, if nothing else is given); a broken answer counts as a failed try."""

    def plain(address: str) -> bytes:
        with urllib.request.urlopen(urllib.request.Request(address, headers={"Accept": "*/*", "User-Agent": agent}), timeout=timeout) as answer:
            return answer.read()

    last: Exception | None = None
    for attempt in range(ATTEMPTS):
        sleep(least_delay if not attempt else FIRST_PAUSE * 2 ** (attempt - 1))
        try:
            return parse((fetch or plain)(url))
        except urllib.error.HTTPError as error:
            if error.code not in RETRIED:
                raise
            last = error
        except (OSError, ValueError, ET.ParseError) as error:
            last = error
    raise ConnectionError(f"{url}: no answer in {ATTEMPTS} tries") from last


class Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.template, self.field = options["url"], options.get("field", "")
        self.pages, self.delay, self.agent = int(options.get("pages", "1")), float(options.get("delay", "1.0")), options.get("agent", AGENT)

    def partitions(self) -> list[Page]:
        return [Page(self.template.replace("{page}", str(k))) for k in range(self.pages)]

    def read(self, partition: Page) -> Iterator[tuple[str]]:
        found = get_json(partition.url, least_delay=self.delay, agent=self.agent)
        for name in filter(None, self.field.split(".")):
            found = found[name]
        for record in found if isinstance(found, list) else [found]:
            yield (json.dumps(record, ensure_ascii=False),)


class PagedJson(DataSource):
    """Options: url (with ``{page}``), pages, field (dotted path to the records), delay in seconds."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _XmlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.template, self.tag, self.total = options["url"], options.get("record", "Hit"), options.get("total", "numHits")
        self.size, self.delay, self.agent = int(options.get("size", "500")), float(options.get("delay", "1.0")), options.get("agent", AGENT)

    def _page(self, start: int) -> ET.Element:
        return get_json(self.template.replace("{start}", str(start)).replace("{size}", str(self.size)), least_delay=self.delay, agent=self.agent, parse=ET.fromstring)

    def partitions(self) -> list[Page]:
        return [Page(str(k)) for k in range(0, int(self._page(0).get(self.total, "0")), self.size)]

    def read(self, partition: Page) -> Iterator[tuple[str]]:
        for record in self._page(int(partition.url)).iter():
            if record.tag.rsplit("}", 1)[-1] == self.tag:
                yield (ET.tostring(record, encoding="unicode"),)


class PagedXml(DataSource):
    """An XML index whose root says how many records there are. Options: url (with ``{start}`` and ``{size}``), record (tag),
    total (attribute), size, delay. Rows are the XML text of each record."""

    @classmethod
    def name(cls) -> str:
        return "paged_xml"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _XmlReader(self.options)


def _literal(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


class _ODataReader(DataSourceReader):
    """Counts the rows that the pushed filters leave, then reads a page a task."""

    def __init__(self, options: dict, columns: dict[str, str]):
        self.url, self.size, self.delay, self.columns, self.kinds = options["url"], int(options.get("size", "1000")), float(options.get("delay", "1.0")), list(columns), columns
        self.first = int(options["first"]) if "first" in options else None
        self.where: list[str] = []
        self.agent = options.get("agent", AGENT)

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.value is not None:
                self.where.append(self._equal(f.attribute[0], f.value))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.value and None not in f.value:
                self.where.append("(" + " or ".join(self._equal(f.attribute[0], v) for v in f.value) + ")")
            yield f  # Spark checks every filter again, so a service that ignores one changes nothing

    def _equal(self, column: str, value) -> str:
        """A column that the service holds as a number or a truth value is compared with a bare literal."""
        return f"{column} eq {value if self.kinds.get(column) in ('number', 'boolean') else _literal(value)}"

    def _address(self, path: str = "", **more: int) -> str:
        query = {"$filter": " and ".join(self.where)} if self.where else {}
        query |= {f"${k}": str(v) for k, v in more.items()}
        return self.url + path + ("?" + urllib.parse.urlencode(query) if query else "")

    def partitions(self) -> list[Page]:
        total = int(get_json(self._address("/$count"), least_delay=self.delay, agent=self.agent, parse=lambda x: int(x.decode("utf-8-sig"))))
        total = total if self.first is None else min(total, self.first)
        return [Page(self._address(skip=k, top=min(self.size, total - k), select=",".join(self.columns))) for k in range(0, total, self.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        found = get_json(partition.url, least_delay=self.delay, agent=self.agent)
        found = found.get("d", found) if isinstance(found, dict) else found
        rows = found if isinstance(found, list) else found.get("results", found.get("value", []))
        for record in rows:
            yield tuple(None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in (record.get(c) for c in self.columns))


class ODataTable(DataSource):
    """A table of an OData service. Options: url, columns (by commas; all are text), size of a page, first (rows to read at most, asked
    of the service), delay. Only the named columns are asked for; filters for one value or one of several go to the service. A column that
it doesn't hold as text is named with its kind, as in ``Active:boolean`` or ``ID:number``; here it is text all the same."""

    @classmethod
    def name(cls) -> str:
        return "odata"

    def _columns(self) -> dict[str, str]:
        own = (c.strip().partition(":") for c in self.options["columns"].split(","))
        return {name: kind or "text" for name, _, kind in own}

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return _ODataReader(self.options, self._columns())


def register(spark: SparkSession) -> None:
    """All sources of this module; filters reach them where the session allows it."""
    for source in (PagedJson, PagedXml, ODataTable):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def bindings(answers: DataFrame, names: list[str], column: str = "value") -> DataFrame:
    """The bindings of query answers (JSON texts) as rows: a column for each name, null where it is unbound, and its language."""
    value = "struct<value:string,`xml:lang`:string>"
    schema = f"results struct<bindings:array<struct<{','.join(f'`{n}`:{value}' for n in names)}>>>"
    rows = answers.select(F.from_json(column, schema).alias("a")).select(F.explode("a.results.bindings").alias("b"))
    return rows.select(*[F.col("b").getField(n).getField("value").alias(n) for n in names], *[F.col("b").getField(n).getField("xml:lang").alias(f"{n}_lang") for n in names])


def answers(spark: SparkSession, endpoint: str, query: str, delay: float = 1.0) -> DataFrame:
    """The answer of a query endpoint as one JSON text."""
    register(spark)
    address = endpoint + "?" + urllib.parse.urlencode({"query": query, "format": "json"})
    return spark.read.format("paged_json").option("url", address.replace("{", "%7B").replace("}", "%7D")).option("delay", str(delay)).load()


def entities(spark: SparkSession, endpoint: str, term: str, language: str, limit: int = 10, delay: float = 1.0) -> DataFrame:
    """Items that a search finds for a term: qid, label and description, in the order of the service."""
    register(spark)
    query = {"action": "wbsearchentities", "search": term, "language": language, "uselang": language, "limit": limit, "format": "json"}
    rows = spark.read.format("paged_json").option("url", endpoint + "?" + urllib.parse.urlencode(query)).option("field", "search").option("delay", str(delay)).load()
    return rows.select(F.from_json("value", "id string, label string, description string").alias("r")).select(F.col("r.id").alias("qid"), "r.label", "r.description")


def search_fields(spark: SparkSession, path: str) -> DataFrame:
    """The searchable fields that schema files declare: each name once, with its place."""
    own = spark.read.format("xml").option("rowTag", "searchfield").option("ignoreNamespace", "true").schema("_Name string, _type string").load(path)
    return own.filter("_Name IS NOT NULL").withColumn("ord", F.monotonically_increasing_id()).groupBy(F.col("_Name").alias("name")).agg(F.min("ord").alias("ord"))
