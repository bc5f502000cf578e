"""The season-and-week endpoints of a statistics service as a Spark data source, in batch and as a stream.

``spark.read.format("season_weeks").option("endpoint", "games").option("base", url).option("seasons", "2023,2024").option("weeks", "1-15").load()``

A slot is a season and a week (for yearly endpoints a season); every slot is a partition, pulled by the task that reads it, with retries. The base
is an HTTP address, asked as <base>/<endpoint>?year=..&week=.., or a folder with <endpoint>/<season>-<week>.json, as a cache or a test has it.
A payload is a JSON array; arrays inside it become rows, and each column is taken from the innermost object that has its key.

As a stream the offset is the number of slots loaded, in the order of the calendar, which is itself an endpoint (``calendar``: an array of season
and week, and only ever longer). A trigger pulls the slots that are new, so what is loaded is pulled once.

Edge cases: a slot without rows has an empty array; a key that is missing is null; a value of another type that cannot be cast fails its
task, which names the slot; a slot that still fails after the last attempt fails the read.
"""

from __future__ import annotations

import json
import random
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_SLOT = "slot_season int, slot_week int"


@dataclass(frozen=True)
class Endpoint:
    """columns: name and type, and the key where it is not the name in camel case. inside: the arrays that become rows, from the outside in."""

    path: str
    columns: str
    inside: tuple[str, ...] = ()
    weekly: bool = True


# fixed values: the service's endpoints and the fields that feature tables use
ENDPOINTS = {
    "games": Endpoint("games", "game_id long id, season int, week int, season_type string, start_date string, completed boolean, neutral_site boolean, conference_game boolean, venue_id long, home_id long, home_team string, home_conference string, home_points int, away_id long, away_team string, away_conference string, away_points int"),
    "lines": Endpoint("lines", "game_id long id, home_team string, away_team string, provider string, spread double, formatted_spread string, over_under double", ("lines",)),
    "team_stats": Endpoint("games/teams", "game_id long id, team string, conference string, home_away string, points int, category string, stat string", ("teams", "stats")),
    "plays": Endpoint("plays", "play_id string id, drive_id string, game_id long, offense string, defense string, period int, down int, distance int, yards_gained int, play_type string, ppa double"),
    "drives": Endpoint("drives", "drive_id string id, offense string, defense string, scoring boolean, drive_result string"),
    "talent": Endpoint("talent", "year int, team string, talent double", weekly=False),
    "coaches": Endpoint("coaches", "first_name string, last_name string, team string school, year int, games int, wins int", ("seasons",), False),
    "roster": Endpoint("roster", "athlete_id string id, team string, position string", weekly=False),
    "recruits": Endpoint("recruiting/players", "athlete_id string, recruit_year int year, stars int, rating double", weekly=False),
    "returning": Endpoint("player/returning", "season int, team string, total_ppa double totalPPA, total_passing_ppa double totalPassingPPA, total_receiving_ppa double totalReceivingPPA, total_rushing_ppa double totalRushingPPA, percent_ppa double percentPPA, percent_passing_ppa double percentPassingPPA, percent_receiving_ppa double percentReceivingPPA, percent_rushing_ppa double percentRushingPPA, usage double, passing_usage double, receiving_usage double, rushing_usage double", weekly=False),
}


def numbers(text: str) -> list[int]:
    """The numbers of a list like 1-3,7."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        out += range(int(low), int(high or low) + 1)
    return list(dict.fromkeys(out))


def fields(endpoint: Endpoint) -> list[tuple[str, str, str]]:
    """(column, type, key)."""
    out = []
    for part in endpoint.columns.split(","):
        name, kind, *key = part.split()
        out.append((name, kind, key[0] if key else re.sub(r"_(\w)", lambda m: m[1].upper(), name)))
    return out


def schema_of(endpoint: str) -> str:
    return ", ".join([_SLOT, *[f"{name} {kind}" for name, kind, _ in fields(ENDPOINTS[endpoint])]])


def cast(value: object, kind: str) -> object:
    if value is None or kind == "string" and isinstance(value, str):
        return value
    if kind == "boolean":
        return value if isinstance(value, bool) else {"true": True, "false": False}[str(value).lower()]
    return {"int": int, "long": int, "double": float, "string": str}[kind](value)


def rows_of(payload: list, endpoint: Endpoint, season: int, week: int | None) -> Iterator[tuple]:
    """An outer object whose array is missing or empty has no rows."""
    columns = fields(endpoint)

    def flat(item: dict, outer: list[dict], inside: tuple[str, ...]) -> Iterator[list[dict]]:
        levels = [item, *outer]
        if not inside:
            yield levels
        else:
            for x in item.get(inside[0]) or ():
                yield from flat(x, levels, inside[1:])

    for item in payload:
        for levels in flat(item, [], endpoint.inside):
            # an inner object's key goes before an outer one's, but an id is that of the outermost
            found = [next((x[key] for x in (reversed(levels) if key == "id" else levels) if key in x), None) for _, _, key in columns]
            yield (season, week, *[cast(v, kind) for v, (_, kind, _) in zip(found, columns, strict=True)])


@dataclass
class Slot(InputPartition):
    season: int
    week: int | None

    def __post_init__(self):
        super().__init__(self.season)


class _Service:
    def __init__(self, options: dict[str, str]):
        # options come without regard to case
        options = {k.lower(): v for k, v in options.items()}
        self.name = options.get("endpoint", "")
        if self.name not in ENDPOINTS or "base" not in options:
            raise ValueError(f"options endpoint (one of {', '.join(ENDPOINTS)}) and base are needed")
        self.endpoint, self.base = ENDPOINTS[self.name], options["base"].rstrip("/")
        self.seasons, self.weeks = numbers(options.get("seasons", "")), numbers(options.get("weeks", ""))
        self.attempts, self.wait = int(options.get("attempts", "4")), float(options.get("wait", "1"))
        self.token = options.get("token", "")

    def ask(self, path: str, file: str, **query: object) -> list:
        for attempt in range(1, self.attempts + 1):
            try:
                if not re.match(r"https?://", self.base):
                    with open(f"{self.base.removeprefix('file://')}/{path}/{file}.json", encoding="utf-8") as f:
                        return json.load(f)
                url = f"{self.base}/{path}?{urllib.parse.urlencode({k: v for k, v in query.items() if v is not None})}"
                headers = {"Authorization": f"Bearer {self.token}"} if self.token else {}
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
                    return json.load(answer)
            except (OSError, ValueError) as e:
                if attempt == self.attempts:
                    raise RuntimeError(f"{path} {query}: {attempt} attempts failed, the last with {e}") from e
                time.sleep(self.wait * 2 ** (attempt - 1) * (1 + random.random() / 10))
        return []

    def slots(self) -> list[Slot]:
        weeks = self.weeks if self.endpoint.weekly else [None]
        return [Slot(s, w) for s in self.seasons for w in weeks]

    def calendar(self) -> list[Slot]:
        """The slots that there are by now, in order, of the seasons and weeks asked for, or of all."""
        listed = [(x["season"], x["week"] if self.endpoint.weekly else None) for x in self.ask("calendar", "all")]
        wanted = [x for x in dict.fromkeys(listed) if (not self.seasons or x[0] in self.seasons) and (x[1] is None or not self.weeks or x[1] in self.weeks)]
        return [Slot(*x) for x in wanted]

    def pull(self, slot: Slot) -> Iterator[tuple]:
        file = str(slot.season) if slot.week is None else f"{slot.season}-{slot.week}"
        payload = self.ask(self.endpoint.path, file, year=slot.season, week=slot.week)
        try:
            yield from rows_of(payload, self.endpoint, slot.season, slot.week)
        except (KeyError, TypeError, ValueError) as e:
            raise RuntimeError(f"{self.name} of season {slot.season}, week {slot.week}: {e!r}") from e


class _Reader(DataSourceReader):
    def __init__(self, service: _Service):
        self.service = service

    def partitions(self) -> list[InputPartition]:
        return self.service.slots()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.service.pull(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, service: _Service):
        self.service = service

    def initialOffset(self) -> dict:
        return {"slots": 0}

    def latestOffset(self) -> dict:
        return {"slots": len(self.service.calendar())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.service.calendar()[start["slots"] : end["slots"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.service.pull(partition)

    def commit(self, end: dict) -> None:
        pass


class SeasonWeeks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "season_weeks"

    def schema(self) -> str:
        return schema_of(_Service(self.options).name)

    def reader(self, schema: StructType) -> DataSourceReader:
        service = _Service(self.options)
        if not service.slots():
            raise ValueError("options seasons and, for weekly endpoints, weeks are needed")
        return _Reader(service)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(_Service(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session. Workers import it from this package."""
    spark.dataSource.register(SeasonWeeks)
