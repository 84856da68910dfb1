"""What a run is configured with, and what makes a configuration unusable."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.functions import text

TENURE, PERIOD = "tenure", "period"
_ITEM, _PROPERTY = re.compile(r"Q\d+"), re.compile(r"P\d+")


@dataclass(frozen=True)
class Check:
    """A property that an item should have, and the member's column with the source's value."""

    property_id: str
    label: str
    column: str


@dataclass(frozen=True)
class Body:
    """A chamber: its short name, its label, the item of its seat, and what its source calls it."""

    council: str
    position_qid: str
    label: str = ""
    group_name: str = ""
    group_id: int | None = None

    def __post_init__(self):
        if not self.council.strip():
            raise ValueError("a body needs a council")
        if not _ITEM.fullmatch(self.position_qid):
            raise ValueError(f"the position of {self.council} is {self.position_qid!r}, which is no item id")
        if self.group_id is not None and (isinstance(self.group_id, bool) or not isinstance(self.group_id, int)):
            raise ValueError(f"the group_id of {self.council} is {self.group_id!r}, which is no number")

    @property
    def row(self) -> dict:
        return {"council": self.council, "label": self.label or self.council, "position_qid": self.position_qid}


@dataclass(frozen=True)
class Enrich:
    """A second source: its kind, its body, and the group of each council there."""

    source: str
    body_key: str = ""
    groups: dict[str, int] = field(default_factory=dict)


GROUPINGS = ("constituency", "group")
#: Kinds of sources, and those whose own person ids are values of an identifier on the graph.
SOURCES = ("federal", "directory", "register", "mandates")
WITH_IDENTIFIER = ("federal", "register")
#: Agents that name nobody.
PLACEHOLDERS = ("example", "your-name", "changeme", "todo")


@dataclass(frozen=True)
class Config:
    source: str = "federal"
    language: str = "de"
    group_by: str = "constituency"
    bodies: tuple[Body, ...] = ()
    roles: tuple[str, ...] = ()
    identifier_property: str = "P1307"
    identifier_verified: bool = True
    identifier_from_source: bool = True
    statement_model: str = TENURE
    biography_url: str = ""
    other_identifiers: tuple[str, ...] = ()
    constituencies: dict[str, str] = field(default_factory=dict)
    parties: dict[str, str] = field(default_factory=dict)
    parl_groups: dict[str, str] = field(default_factory=dict)
    terms: dict[int, str] = field(default_factory=dict)
    person_data: tuple[Check, ...] = ()
    body_key: str = ""
    user_agent: str = ""
    enrich: Enrich | None = None

    def __post_init__(self):
        wrong = [p for p in (self.identifier_property, *self.other_identifiers, *(c.property_id for c in self.person_data)) if not _PROPERTY.fullmatch(p)]
        wrong += [q for m in (self.constituencies, self.parties, self.parl_groups, self.terms) for q in m.values() if not _ITEM.fullmatch(q)]
        if wrong:
            raise ValueError(f"not a property or item id: {', '.join(map(repr, wrong))}")
        if self.statement_model not in (TENURE, PERIOD):
            raise ValueError(f"statement_model is {self.statement_model!r}; it can be {TENURE} or {PERIOD}")
        if self.group_by not in GROUPINGS:
            raise ValueError(f"group_by is {self.group_by!r}; it can be {' or '.join(GROUPINGS)}")
        councils = [b.council.strip().upper() for b in self.bodies]
        if twice := sorted({c for c in councils if councils.count(c) > 1}):
            raise ValueError(f"councils that stand twice: {', '.join(twice)}")
        if self.identifier_property in self.other_identifiers:
            raise ValueError(f"{self.identifier_property} is the identifier and can't be another one too")
        checked = [c.property_id for c in self.person_data]
        if twice := sorted({p for p in checked if checked.count(p) > 1}):
            raise ValueError(f"checks that stand twice: {', '.join(twice)}")
        if self.biography_url and "{id}" not in self.biography_url:
            raise ValueError("biography_url needs {id} where the person's id goes")
        for name in ("constituencies", "parties", "parl_groups"):
            if blank := [k for k in getattr(self, name) if not str(k).strip()]:
                raise ValueError(f"{name} has {len(blank)} blank keys")
        if any(isinstance(n, bool) or not isinstance(n, int) for n in self.terms):
            raise ValueError("terms are keyed by period numbers")

    def problems(self) -> list[str]:
        """What keeps a run from its services, a sentence each; none means that it can be run."""
        found = []
        if not self.bodies:
            found.append("bodies names no chamber")
        if self.source not in SOURCES:
            found.append(f"source is {self.source!r}; it can be {', '.join(SOURCES)}")
        if self.source == "mandates" and (bare := [b.council for b in self.bodies if not (b.group_name or b.label)]):
            found.append(f"mandates are told apart by the exact name of their body, which {', '.join(bare)} has not")
        if self.source == "directory" and not self.body_key:
            found.append("source directory needs a body_key, the parliament that its groups belong to")
        if self.identifier_from_source and self.source in SOURCES and self.source not in WITH_IDENTIFIER:
            found.append(f"identifier_from_source: source {self.source} gives no value of {self.identifier_property}")
        if self.identifier_verified and not self.identifier_from_source:
            found.append("identifier_verified says that the source's ids are the identifier's values, and identifier_from_source that it gives none")
        if not self.user_agent.strip():
            found.append("user_agent has to name who asks, with an address")
        elif any(p in self.user_agent.lower() for p in PLACEHOLDERS):
            found.append(f"user_agent {self.user_agent!r} is a placeholder")
        elif not re.search(r"https?://|@", self.user_agent):
            found.append("user_agent has no address to write to")
        return found + (self._enrich_problems() if self.enrich else [])

    def _enrich_problems(self) -> list[str]:
        found = []
        if self.enrich.source != "directory":
            found.append(f"enrich.source is {self.enrich.source!r}; only a directory can be the second source")
        if not self.enrich.groups:
            found.append("enrich.groups names no council's group")
        if stray := sorted(set(self.enrich.groups) - {b.council for b in self.bodies}):
            found.append(f"enrich.groups has councils that bodies hasn't: {', '.join(stray)}")
        if self.enrich.source == self.source and self.enrich.body_key == self.body_key:
            found.append("enrich is the source itself, which would always agree")
        return found

    @classmethod
    def of(cls, raw: dict) -> Config:
        """From a parsed configuration file; unknown keys are an error, not a silence."""
        known = set(cls.__dataclass_fields__)
        if unknown := sorted(set(raw) - known):
            raise ValueError(f"unknown configuration keys: {', '.join(unknown)}")
        own = dict(raw)
        for kind, said, names in ((list | tuple, "list", ("bodies", "person_data", "roles", "other_identifiers")), (dict, "mapping", ("constituencies", "parties", "parl_groups", "terms"))):
            if wrong := [n for n in names if n in own and not isinstance(own[n], kind)]:
                raise ValueError(f"{wrong[0]} has to be a {said}")
        if own.get("enrich") is not None and not isinstance(own["enrich"], Enrich):
            if not isinstance(own["enrich"], dict):
                raise ValueError("enrich has to be a mapping")
            own["enrich"] = Enrich(**own["enrich"]) if own["enrich"] else None
        if "person_data" in own:
            own["person_data"] = tuple(c if isinstance(c, Check) else Check(**c) for c in own["person_data"])
        if "bodies" in own:
            own["bodies"] = tuple(b if isinstance(b, Body) else Body(**b) for b in own["bodies"])
        if "roles" in own:
            own["roles"] = tuple(own["roles"])
        if "other_identifiers" in own:
            own["other_identifiers"] = tuple(own["other_identifiers"])
        return cls(**own)

    def constituency(self, x: Column) -> Column:
        """By name, case and white space aside."""
        return lookup({re.sub(r"\s+", " ", k).strip().casefold(): v for k, v in reversed(self.constituencies.items())}, text.folded(x))

    def party(self, x: Column) -> Column:
        return lookup(self.parties, F.trim(x))

    def parl_group(self, x: Column) -> Column:
        return lookup(self.parl_groups, F.trim(x))

    def term(self, number: Column) -> Column:
        return lookup({str(k): v for k, v in self.terms.items()}, number.cast("string"))

    def biography(self, person: Column) -> Column:
        """The record's address; null where the source gives no usable id."""
        if not self.biography_url:
            return F.lit(None).cast("string")
        return F.when(text.blank_to_null(person).isNotNull(), F.replace(F.lit(self.biography_url), F.lit("{id}"), person))


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for a key, or null; an unmapped key is never guessed."""
    if not table:
        return F.lit(None).cast("string")
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(known, key)


def load(path: str) -> Config:
    """A configuration file in YAML."""
    import yaml

    with open(path, encoding="utf-8") as file:
        raw = yaml.safe_load(file)
    if not isinstance(raw, dict):
        raise ValueError(f"{path} has no mapping of keys")
    return Config.of(raw)
