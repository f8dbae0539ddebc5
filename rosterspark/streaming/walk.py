"""Stints and possessions over an open stream of events.

A game is a key with state. Its rows wait until the watermark has passed them, so that what
arrives out of order is put in order; then they are walked one by one, each held back until
the next one says whether a free throw ends its trip. A timer on the watermark lets waiting
rows go when a game falls silent, and closes it ``close_after`` later, when its last row has
no next one. The rows are those that the window operators of ``operators.sequence`` give
over the same log.

Late rows: a row that comes when a later one of its game has been walked is given with
``late`` set and no stint, and changes nothing. A row that comes after its game was closed
goes on from where the game stood. State is a game's position and its waiting rows, which
the watermark's delay bounds; a restart goes on from the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rosterspark.operators.sequence import Codes

#: What a stream of events must hold; ``key`` is what stays the same within a stint.
COLUMNS = ("n", "team", "home", "away", "code", "key")
OUT = "n long, stint_id long, trip_end boolean, ends boolean, credited string, late boolean"


def fresh() -> dict:
    """A game before its first row."""
    return {"held": [], "row": None, "last_n": None, "last_ts": None, "stint": None, "key": None, "holder": None, "seed": None}


def walked(game: dict, row: dict, following: dict | None, codes: Codes) -> dict:
    """What a row is, with the next one known; moves the game on."""
    code, team = row["code"], row["team"]
    if game["stint"] is None:
        game["stint"] = 0
    elif row["key"] != game["key"]:
        game["stint"] += 1
    game["key"] = row["key"]
    other = row["away"] if team == row["home"] else row["home"] if team == row["away"] else None
    trip = code in codes.free_throw_made and (following is None or following["code"] not in codes.free_throw)
    own, stolen, period = code in codes.made + codes.turnover or trip, code in codes.defensive_rebound, code in codes.period_end
    if team and code not in codes.neutral + codes.period_end and game["seed"] is None:
        game["seed"] = team
    after = other if own else team if stolen else None
    game["holder"] = after or game["holder"]
    credited = (game["holder"] or game["seed"]) if period else team if own else other if stolen else None
    if period:
        game["holder"] = game["seed"] = None
    return {"n": row["n"], "stint_id": game["stint"], "trip_end": trip, "ends": (own or stolen or period) and credited is not None, "credited": credited, "late": False}


def moved(game: dict, until: int, close: bool, codes: Codes) -> list[dict]:
    """Walks the waiting rows that the watermark has passed, and the last one if the game closes."""
    due = sorted((r for r in game["held"] if r["ts"] <= until), key=lambda r: r["n"])
    game["held"] = [r for r in game["held"] if r["ts"] > until]
    out = []
    for r in due:
        if game["last_n"] is not None and r["n"] <= game["last_n"]:
            out.append({"n": r["n"], "stint_id": None, "trip_end": None, "ends": None, "credited": None, "late": True})
            continue
        if game["row"] is not None:
            out.append(walked(game, game["row"], r, codes))
        game["row"], game["last_n"], game["last_ts"] = r, r["n"], max(r["ts"], game["last_ts"] or r["ts"])
    if close and game["row"] is not None and not game["held"]:
        out.append(walked(game, game["row"], None, codes))
        game["row"] = None
    return out


def walk_stream(events: DataFrame, game: str, time: str, codes: Codes, delay: str = "10 minutes", close_after: int = 3_600_000) -> DataFrame:
    """(game, n, stint_id, trip_end, ends, credited, late) of a stream with the columns
    ``COLUMNS``; ``close_after`` is in milliseconds of event time."""
    kind = events.schema[game].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else fresh()
        for b in batches:
            stamps = b[time].to_numpy("datetime64[ms]").astype("int64").tolist()
            rows = b[list(COLUMNS)].astype(object).where(b[list(COLUMNS)].notna(), None).to_dict("records")
            own["held"] += [r | {"n": int(r["n"]), "ts": t} for r, t in zip(rows, stamps, strict=True)]
        now = state.getCurrentWatermarkMs()
        ends = max([r["ts"] for r in own["held"]] + [own["last_ts"] or 0]) + close_after
        found = moved(own, now, now >= ends, codes)
        state.update((json.dumps(own),))
        if own["held"] or own["row"] is not None:
            due = min([r["ts"] for r in own["held"]] or [(own["last_ts"] or 0) + close_after])
            state.setTimeoutTimestamp(max(due, now) + 1)
        out = pd.DataFrame(found, columns=[c.split()[0] for c in OUT.split(", ")]).astype(object)
        out.insert(0, game, key[0])
        if len(out):
            yield out.astype({"n": "int64", "stint_id": "Int64", "late": bool})

    return events.withWatermark(time, delay).groupBy(game).applyInPandasWithState(step, f"`{game}` {kind}, {OUT}", "state string", "append", GroupStateTimeout.EventTimeTimeout)
