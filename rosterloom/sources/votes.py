"""Roll calls of periods: discovery, a dependent lookup for each period, and ballots, a scan for each vote."""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rosterloom.functions import text
from rosterloom.sources.http import AGENT, _literal, get_json

#: Tables of the service and the columns of a vote's number, the best first.
VOTE_TABLE, BALLOT_TABLE = "Vote", "Voting"
VOTE_COLUMNS = ("IdVote", "ID", "Id")


def records(answer) -> tuple[list[dict], str | None]:
    """The rows of an OData answer of either version, and the address of the next page if the service names one."""
    own = answer.get("d", answer) if isinstance(answer, dict) else answer
    if isinstance(own, list):
        return own, None
    rows = own.get("results", own.get("value", []))
    return rows, own.get("__next") or own.get("@odata.nextLink") or (answer.get("@odata.nextLink") if isinstance(answer, dict) else None)


def address(url: str, table: str, equal: dict, **more) -> str:
    query = {"$filter": " and ".join(f"{k} eq {_literal(v)}" for k, v in equal.items())} if equal else {}
    return f"{url}/{table}?" + urllib.parse.urlencode(query | {f"${k}": str(v) for k, v in more.items()})


class FirstVote:
    """For a period's row id the first vote that the service lists, as text of its row; nothing if there is none or it fails."""

    def eval(self, url: str, language: str, period: int, delay: float):
        if period is None:
            return
        try:
            rows, _ = records(get_json(address(url, VOTE_TABLE, {"Language": language, "IdLegislativePeriod": period}, top=1), least_delay=delay))
        except Exception:  # a gap of the check, not a failure of the run
            return
        for row in rows[:1]:
            yield (json.dumps(row, ensure_ascii=False),)


def find_votes(spark: SparkSession, periods: DataFrame, url: str, language: str = "DE", delay: float = 1.0) -> DataFrame:
    """(number, period_id, vote_id) for each period (number, id) whose first vote has a number: the service is asked from the
    tasks, laterally for each row; a period without a vote, or whose answer fails, has no row."""
    ask = F.udtf(FirstVote, returnType="vote string")
    found = periods.select("number", F.col("id").cast("int").alias("period_id")).lateralJoin(ask(F.lit(url), F.lit(language), F.col("period_id").outer(), F.lit(float(delay))))
    ids = text.first_number(*[F.get_json_object("vote", f"$.{c}") for c in VOTE_COLUMNS])
    return found.select("number", "period_id", ids.alias("vote_id")).filter("vote_id IS NOT NULL")


class KeyPartition(InputPartition):
    def __init__(self, key: str):
        self.key = key


class _KeyedReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.url, self.table, self.key = options["url"], options["table"], options["key"]
        self.keys, self.equal = json.loads(options["keys"]), json.loads(options.get("equal", "{}"))
        self.size, self.delay, self.count = int(options.get("size", "1000")), float(options.get("delay", "1.0")), options.get("count", "false") == "true"
        self.columns, self.agent = columns, options.get("agent", AGENT)

    def partitions(self) -> list[KeyPartition]:
        return [KeyPartition(k) for k in self.keys]

    def read(self, partition: KeyPartition) -> Iterator[tuple]:
        """A key's rows, then nothing; or what was read before a failure, then a row with the error."""
        equal = self.equal | {self.key: partition.key}
        try:
            if self.count:
                n = get_json(address(self.url, f"{self.table}/$count", equal), least_delay=self.delay, agent=self.agent, parse=lambda x: int(x.decode("utf-8-sig")))
                yield (str(partition.key), None, n)
                return
            at, following = 0, address(self.url, self.table, equal, skip=0, top=self.size)
            while following:
                rows, named = records(get_json(following, least_delay=self.delay, agent=self.agent))
                for row in rows:
                    yield (str(partition.key), None, *[None if row.get(c) is None else str(row[c]) for c in self.columns])
                at += len(rows)
                following = named or (address(self.url, self.table, equal, skip=at, top=self.size) if len(rows) == self.size else None)
        except Exception as error:  # one key's failure is a row, and no other key's
            yield (str(partition.key), f"{type(error).__name__}: {error}", *[None] * (1 if self.count else len(self.columns)))


class KeyedTable(DataSource):
    """A table of an OData service read for given keys, a partition for each. Options: url, table, key (column), keys (a JSON list), equal (a
    JSON object of further equalities), columns (by commas; all are text), size of a page, delay, count. Rows are (_key, _error,
    columns); a key that fails gives a row with its error. With ``count`` true the service counts: (_key, _error, n), and no row is read."""

    @classmethod
    def name(cls) -> str:
        return "keyed_odata"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]

    def schema(self) -> str:
        own = "n bigint" if self.options.get("count", "false") == "true" else ", ".join(f"`{c}` string" for c in self._columns())
        return "_key string, _error string, " + own

    def reader(self, schema) -> DataSourceReader:
        return _KeyedReader(self.options, self._columns())


def keyed(spark: SparkSession, url: str, table: str, key: str, keys: Sequence, columns: Sequence[str] = (), count: bool = False, size: int = 1000, delay: float = 1.0, **equal) -> DataFrame:
    """``KeyedTable`` for a list of keys, which is bounded: it stands in the plan."""
    spark.dataSource.register(KeyedTable)
    options = dict(url=url, table=table, key=key, keys=json.dumps(list(keys)), equal=json.dumps(equal), columns=",".join(columns), count=str(count).lower(), size=str(size), delay=str(delay))
    return spark.read.format("keyed_odata").options(**options).load()


def ballots(spark: SparkSession, votes: Sequence[int], url: str, language: str = "DE", delay: float = 1.0, size: int = 1000) -> DataFrame:
    """(vote, error, period_id, person_key) of some votes; a vote whose ballots can't be read is a row with its error."""
    rows = keyed(spark, url, BALLOT_TABLE, "IdVote", votes, ("IdLegislativePeriod", "PersonNumber"), size=size, delay=delay, Language=language)
    period, person = text.as_int(F.col("IdLegislativePeriod")), text.as_int(F.col("PersonNumber"))
    own = rows.select(F.col("_key").alias("vote"), F.col("_error").alias("error"), period.alias("period_id"), person.cast("string").alias("person_key"))
    return own.filter("error IS NOT NULL OR (period_id IS NOT NULL AND person_key IS NOT NULL)")


def attendance(found: DataFrame, periods: DataFrame) -> DataFrame:
    """(number, person_key), each once: the service's row ids of periods become numbers; an id that no period has stays as it is."""
    own = periods.select(F.col("id").alias("_id"), F.col("number").alias("_n")).dropDuplicates(["_id"])
    met = found.filter("error IS NULL").join(F.broadcast(own), F.col("period_id") == F.col("_id"), "left")
    return met.select(F.coalesce("_n", "period_id").cast("int").alias("number"), "person_key").distinct()
