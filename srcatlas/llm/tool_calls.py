"""Tool calls of conversations: linked to their results, ordered, checked and written as canonical JSON.

Calls and results meet in a hash join on (conversation, identifier).  A call may wait for any number of calls of its
conversation; its level is the longest way back to a call that waits for none.  Conversations of at most CONVERSATION_ROWS calls
and waits are dealt to tasks, which peel each one off call by call.  A larger one is never gathered: stretches of calls that
wait for one call each are jumped over by pointer doubling on written tables (2^k steps after k rounds), and what is left, the
calls that wait for several, are settled in rounds, each as soon as all it waits for are.  Levels, then turns, then
identifiers give an order in which no call comes before one it waits for.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import numbered
from srcatlas.session import durable

_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int,
}


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value departs from a schema (type, enum, const, properties, required, additionalProperties, items, bounds, pattern)."""
    wanted = schema.get("type")
    if wanted:
        kinds = [wanted] if isinstance(wanted, str) else wanted
        fits = any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in kinds)
        if not fits:
            return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the listed values")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: length out of bounds")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern not found")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: value out of bounds")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not expected")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            out.append(f"{at}: number of items out of bounds")
        if "items" in schema:
            for i, x in enumerate(value):
                out += schema_errors(x, schema["items"], f"{at}[{i}]")
    return out


_HALF_PAIR = re.compile("[\ud800-\udfff]")


def _plain(text: str) -> str:
    """Halves of surrogate pairs, which UTF-8 cannot hold, as JSON escapes."""
    return _HALF_PAIR.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and characters as they are (halves of surrogate pairs as escapes)."""
    return _plain(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _finite(number: str) -> float:
    value = float(number)
    if math.isinf(value):
        raise OverflowError
    return value


def checked(name: str | None, arguments: str | None, schemas: dict) -> tuple[object, list[str]]:
    """The arguments as a value and what is wrong with them; arguments that are no usable JSON stay the text they are."""
    try:
        value = json.loads(arguments if arguments is not None else "{}", parse_constant=_no_constant, parse_float=_finite)
        canonical(value)
    except OverflowError:
        return arguments, ["$: number out of range"]
    except RecursionError:
        return arguments, ["$: nested too deep"]
    except ValueError:
        return arguments, ["$: not JSON"]
    if name not in schemas:
        return value, ["unknown tool"]
    return value, [_plain(e) for e in schema_errors(value, schemas[name])]


#: Calls and waits of a conversation that one task orders; a larger conversation is ordered by tables.
CONVERSATION_ROWS = 10_000
KEY = ["conv_id", "call_id"]
LEVEL = "conv_id long, call_id string, level long"


def peeled(calls: set[str], waits: list[tuple[str, str]]) -> dict[str, int | None]:
    """Call -> longest way back to a call that waits for none; None for calls in or behind a cycle."""
    left, later, level = dict.fromkeys(calls, 0), {}, {}
    for call, after in waits:
        left[call] += 1
        later.setdefault(after, []).append(call)
    ready = [c for c in calls if not left[c]]
    level.update(dict.fromkeys(ready, 0))
    highest: dict[str, int] = {}
    while ready:
        done = ready.pop()
        for call in later.get(done, ()):
            highest[call] = max(highest.get(call, 0), level[done] + 1)
            left[call] -= 1
            if not left[call]:
                level[call] = highest[call]
                ready.append(call)
    return {c: level.get(c) for c in calls}


def _peel(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``after`` (null: the call itself) -> levels; a task holds one conversation at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("level", pa.int64())])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def levels_of() -> pa.RecordBatch:
            found = peeled(calls, waits)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(found), pa.int64()), pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], schema=schema)

        now, calls, waits = None, set(), []
        for batch in batches:
            for conv, call, after in zip(*(batch[c].to_pylist() for c in ("conv_id", "call_id", "after"))):
                if conv != now:
                    if calls:
                        yield levels_of()
                    now, calls, waits = conv, set(), []
                if after is None:
                    calls.add(call)
                else:
                    waits.append((call, after))
        if calls:
            yield levels_of()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(order, LEVEL)


def _by_tables(calls: DataFrame, waits: DataFrame) -> DataFrame:
    """Levels of conversations of any size, from written tables of calls and of waits."""
    degree = durable(waits.groupBy(*KEY).count(), "degrees")
    single = waits.join(degree.where("count = 1").select(*KEY), KEY, "left_semi")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = degree.select("conv_id", F.col("call_id").alias("after"), (F.col("count") == 1).alias("on"))
    # where each call with one wait leads to, how far, and whether that one leads on
    now = durable(single.join(ends, ["conv_id", "after"], "left").select(*KEY, "after", one.alias("far"), F.coalesce("on", F.lit(False)).alias("on")), "chains")
    rounds = max(1, now.count()).bit_length() + 1
    while rounds and now.where("on").limit(1).count():
        up = now.select("conv_id", F.col("call_id").alias("after"), F.col("after").alias("next"), F.col("far").alias("more"), F.col("on").alias("further"))
        jumped = now.where("on").join(up, ["conv_id", "after"]).select(*KEY, F.col("next").alias("after"), (F.col("far") + F.col("more")).alias("far"), F.col("further").alias("on"))
        now, rounds = durable(now.where("not on").union(jumped), "chains"), rounds - 1
    chained = now.where("not on").select(*KEY, F.col("after").alias("anchor"), "far")  # the others run in circles
    known = durable(calls.join(degree, KEY, "left_anti").select(*KEY, zero.alias("level")), "levels")
    # waits of calls with several, each as a wait for an anchor some steps further
    many = waits.join(degree.where("count > 1").select(*KEY), KEY, "left_semi")
    place = chained.select("conv_id", F.col("call_id").alias("after"), "anchor", "far")
    circle = now.where("on").select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("lost"))
    long = many.join(place, ["conv_id", "after"], "left").join(circle, ["conv_id", "after"], "left").where("lost is null").select(
        *KEY, F.coalesce("anchor", "after").alias("anchor"), (F.coalesce("far", zero) + 1).alias("far")
    )
    long, wanted, fresh = durable(long, "anchors"), degree.where("count > 1"), known
    reached = None
    while fresh.limit(1).count():
        settled = fresh.select("conv_id", F.col("call_id").alias("anchor"), "level")
        more = long.join(settled, ["conv_id", "anchor"]).groupBy(*KEY).agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count("*").alias("n"))
        so_far = more if reached is None else reached.union(more).groupBy(*KEY).agg(F.max("level").alias("level"), F.sum("n").alias("n"))
        reached = durable(so_far, "reached")
        ready = reached.join(wanted, KEY).where("n = count").select(*KEY, "level")
        fresh = durable(ready.join(known, KEY, "left_anti"), "fresh")
        known = durable(known.union(fresh), "levels")
    ends = known.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("base"))
    along = chained.join(ends, ["conv_id", "anchor"]).select(*KEY, (F.col("base") + F.col("far")).alias("level"))
    return calls.join(known.union(along), KEY, "left").select(*KEY, "level")


def levels(calls: DataFrame, waits: DataFrame | None = None, most: int = CONVERSATION_ROWS) -> DataFrame:
    """Distinct (``conv_id``, ``call_id``) -> with ``level``; null in or behind a cycle.

    ``waits``: (``conv_id``, ``call_id``, ``after``), any number for a call; without it, the column ``after`` of ``calls``.  A
    wait for a call that does not exist does not count.
    """
    if waits is None:
        waits = calls.select(*KEY, "after")
    calls = calls.select(*KEY)
    known = calls.select("conv_id", F.col("call_id").alias("after"))
    waits = waits.where("after is not null").select(*KEY, "after").distinct().join(calls, KEY, "left_semi").join(known, ["conv_id", "after"], "left_semi")
    waits = durable(waits.select(*KEY, "after"), "waits")
    rows = calls.select(*KEY, F.lit(None).cast("string").alias("after")).union(waits)
    large = durable(rows.groupBy("conv_id").count().where(F.col("count") > most).select("conv_id"), "large")
    found = _peel(rows.join(large, "conv_id", "left_anti").select(*KEY, "after"))
    if not large.limit(1).count():
        return found
    return found.union(_by_tables(durable(calls.join(large, "conv_id", "left_semi").select(*KEY), "calls"), durable(waits.join(large, "conv_id", "left_semi").select(*KEY, "after"), "waits")))


OUT = (
    "conv_id long, call_id string, turn long, level long, position long, name string, status string, valid boolean, errors string, json string"
)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], waits: DataFrame | None = None) -> DataFrame:
    """One row per distinct call of (``conv_id``, ``call_id``), and per result without a call.

    ``calls``: ``conv_id``, ``call_id``, ``turn``, ``name``, ``arguments`` (JSON text; null counts as ``{}``), and ``after`` if a
    call waits for one at most; otherwise ``waits`` holds ``conv_id``, ``call_id``, ``after``.
    ``results``: ``conv_id``, ``call_id``, ``turn``, ``content``.  Of repeated identifiers the lowest turn counts (then the
    smallest other columns).  Rows without conversation or identifier cannot be linked and are left out.  ``status``:
    linked, unanswered, early (the result's turn is not later), cycle (in or behind one) or orphan (a result alone).  ``position`` counts
    from 0 in each conversation, cycles and orphans last.  ``schemas`` holds one schema per tool name.
    """
    key, told = KEY, ["turn", "name", "arguments", *(["after"] if waits is None else [])]
    asked = calls.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct(*told)).alias("c"))
    asked = durable(asked.select(*key, "c.*"), "calls")
    given = results.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("r"))
    given = given.select(*key, "r.*", F.lit(True).alias("answered"))
    linked = asked.withColumn("asked", F.lit(True)).hint("shuffle_hash").join(given, key, "full").join(levels(asked, waits), key, "left")
    status = (
        F.when(F.col("asked").isNull(), "orphan")
        .when(F.col("level").isNull(), "cycle")
        .when(F.col("answered").isNull(), "unanswered")
        .when(F.col("result_turn") <= F.col("turn"), "early")
        .otherwise("linked")
    )
    rows = linked.withColumn("status", status).withColumn("turn", F.coalesce("turn", "result_turn"))
    order = [F.col("conv_id"), F.col("level").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("call_id")]
    ranked = durable(numbered(rows, order, "__sa_rank"), "ranked")
    first = durable(ranked.groupBy("conv_id").agg(F.min("__sa_rank").alias("__sa_first")), "first")
    ready = ranked.join(first, "conv_id").withColumn("position", F.col("__sa_rank") - F.col("__sa_first"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            out = []
            for r in batch.itertuples(index=False):
                value, errors = (None, []) if r.status == "orphan" else checked(r.name, r.arguments, schemas)
                record = {"id": r.call_id, "name": r.name, "arguments": value, "result": r.content}
                valid = not errors and r.status == "linked"
                out.append((r.conv_id, r.call_id, r.turn, r.level, r.position, r.name, r.status, valid, "; ".join(errors), canonical(record)))
            names = [c.split()[0] for c in OUT.split(", ")]
            frame = pd.DataFrame(out, columns=names, dtype=object)
            yield frame.astype({"conv_id": "Int64", "turn": "Int64", "level": "Int64", "position": "Int64"})

    columns = ["conv_id", "call_id", "turn", "level", "position", "name", "status", "arguments", "content"]
    return ready.select(*columns).mapInPandas(write, OUT)
