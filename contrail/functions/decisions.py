"""Model decisions as column expressions: steps with holds, planner routing, units of a context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contrail.functions.control import CLIMB, HOLD, MAX_STEPS, MAX_TOTAL, SPEED, TURN, clamp
from contrail.functions import literals
from contrail.functions.text import fence_strip, strip

#: Fields of a command with their full scale, names of the two units, and side markers of a context.
FIELDS = (("turn_deg", TURN), ("up_m", CLIMB), ("dspeed_mps", SPEED))
UNITS = (("red_1", "red1"), ("red_2", "red2"))
RED, BLUE = "红方", "蓝方"
PARSE_FAILED = "JSON解析失败，原始数据: "


def _let(value: Column, body) -> Column:
    """``body(value)``, with value computed once."""
    return F.transform(F.array(value), body)[0]


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _has(v: Column, key: str) -> Column:
    """True if an object has the key, whatever its value: a JSON null is a variant, not null."""
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def _first(v: Column, keys: tuple[str, ...], kind: str) -> Column:
    """The value of the first key that is present, as a type; null if it is none of that type."""
    out = F.lit(None).cast(kind)
    for k in reversed(keys):
        out = F.when(_has(v, k), F.try_variant_get(v, f"$.{k}", kind)).otherwise(out)
    return out


def _object(text: Column) -> Column:
    """The object that the text is, else null. Spark's parser leaves what follows a value unread, so the text has to end
    as an object does."""
    return _let(text, lambda said: _let(F.try_parse_json(said), lambda v: F.when(_is_object(v) & strip(said).endswith("}"), v)))


def action(v: Column) -> Column:
    """Six numbers, three for each unit, scaled and clamped; zeros for a unit that is missing or no object. A field that
    is present but no number makes its number null."""

    def unit(names: tuple[str, ...]) -> Column:
        def numbers(u: Column) -> Column:
            value = lambda k, full: F.when(_has(u, k), _let(F.try_variant_get(u, f"$.{k}", "double") / full, lambda x: clamp(x))).otherwise(F.lit(0.0))
            return F.when(_is_object(u), F.array(*[value(k, full) for k, full in FIELDS])).otherwise(F.array(*[F.lit(0.0)] * 3))

        return _let(_first(v, names, "variant"), numbers)

    return F.concat(*[unit(n) for n in UNITS]).cast("array<float>")


def action_vector(six: Column, size: int = 640, width: int = 8) -> Column:
    """The full action: the first three numbers of each platform's eight are set for two platforms."""
    zero = F.lit(0.0).cast("float")
    slots = min(size, 2 * width)
    at = lambda six, i: F.get(six, F.lit(i // width * 3 + i % width)) if i % width < 3 else zero
    return _let(six, lambda once: F.concat(F.array(*[at(once, i) for i in range(slots)]), F.array_repeat(zero, size - slots)))


def decision_steps(text: Column, default_hold: float = HOLD, max_steps: int = MAX_STEPS, max_total: float = MAX_TOTAL) -> Column:
    """Array of ``hold, action``. The list is ``steps``, or ``sequence`` without that key; a step that is no object or whose
    hold is not positive is skipped, the first overrun of the time ends it. Without steps the object itself is one step."""
    kept = "array<struct<hold:double,action:array<float>>>"

    def of(v: Column) -> Column:
        listed = F.when(_has(v, "steps"), F.try_variant_get(v, "$.steps", "array<variant>")).otherwise(F.try_variant_get(v, "$.sequence", "array<variant>"))
        listed = F.coalesce(F.slice(listed, 1, max_steps) if max_steps > 0 else listed, F.array().cast("array<variant>"))
        steps = F.transform(F.filter(listed, _is_object), lambda s: F.struct(F.coalesce(_first(s, ("hold_s", "duration_s", "t"), "double"), F.lit(default_hold)).alias("hold"), action(s).alias("action")))
        start = F.struct(F.array().cast(kept).alias("out"), F.lit(0.0).alias("t"), F.lit(False).alias("done"))

        def fold(a: Column, s: Column) -> Column:
            taken = F.struct(F.concat(a["out"], F.array(s)).alias("out"), (a["t"] + s["hold"]).alias("t"), F.lit(False).alias("done"))
            return F.when(a["done"] | (s["hold"] <= 0), a).when(a["t"] + s["hold"] > max_total, F.struct(a["out"].alias("out"), a["t"].alias("t"), F.lit(True).alias("done"))).otherwise(taken)

        hold = F.coalesce(_first(v, ("hold_s", "duration_s"), "double"), F.lit(default_hold))
        single = F.array(F.struct(F.when(hold <= 0, F.lit(default_hold)).otherwise(hold).alias("hold"), action(v).alias("action"))).cast(kept)
        return _let(F.aggregate(steps, start, fold, lambda a: a["out"]), lambda out: F.when(F.size(out) > 0, out).otherwise(single))

    return _let(F.coalesce(_object(fence_strip(text, strict=True)), F.parse_json(F.lit("{}"))), of)


def first_action(text: Column) -> Column:
    """The whole action of a decision's first step."""
    return action_vector(F.get(decision_steps(text), F.lit(0))["action"])


def _said(v: Column, key: str) -> Column:
    """A value as text: strings as they are, others as JSON, null for a JSON null."""
    return F.try_variant_get(v, f"$.{key}", "string")


def planner_decision(raw: Column, mode: str = "route") -> Column:
    """``decision, plan, result`` of a planner's output.

    ``route``: execute with a plan, end with an answer, a plan without action is executed, else the output itself is the
    plan. ``default``: missing action is execute, missing plan intercept. ``plan``: always execute, with the plan, else the
    object as JSON, else the output itself.
    """
    none = F.lit(None).cast("string")
    out = lambda decision, plan=none, result=none: F.struct(decision.alias("decision"), plan.alias("plan"), result.alias("result"))
    execute = F.lit("execute")
    if mode == "default":
        given = lambda v, k, other: F.when(_has(v, k), _said(v, k)).otherwise(F.lit(other))
        return _let(_object(raw), lambda v: F.when(v.isNull(), out(execute, F.lit("intercept"))).otherwise(out(given(v, "action", "execute"), given(v, "plan", "intercept"))))
    v0 = _object(fence_strip(strip(raw)))
    if mode == "plan":
        return _let(v0, lambda v: out(execute, F.when(v.isNull(), raw).when(_has(v, "plan"), _said(v, "plan")).otherwise(F.to_json(v))))
    if mode != "route":
        raise ValueError(f"mode is route, default or plan, not {mode}")
    failed = out(execute, F.concat(F.lit(PARSE_FAILED), F.coalesce(raw, F.lit(""))))
    return _let(v0, lambda v: F.when(v.isNull(), failed).when(_said(v, "action") == "execute", out(execute, _said(v, "plan"))).when(_said(v, "action") == "end", out(F.lit("end"), none, _said(v, "answer"))).when(_has(v, "plan"), out(execute, _said(v, "plan"))).otherwise(failed))


def context_units(text: Column) -> Column:
    """Array of ``unit, side, heading, x, y, z, speed`` of a context: a marker line names the side of the lines after it.

    A line is a unit, with the next number of its side, if what stands from its first to its last brace is a dictionary as
    Python writes it (``literals.literal``); others are skipped and take no number. A unit's missing value is null.
    """
    unit = "struct<unit:string,side:string,heading:double,x:double,y:double,z:double,speed:double>"
    # the usual spelling, whose numbers one pattern takes whole; any other goes through the grammar
    number = r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    plain = rf"^\{{'state': *\{{'heading': *{number}, *'position': *\({number}, *{number}, *{number}\), *'speed': *{number}\}}\}}$"
    names = {"heading": "heading", "x": "position[0]", "y": "position[1]", "z": "position[2]", "speed": "speed"}

    def read(line: Column) -> Column:
        side = F.when(F.contains(line, F.lit(RED)), "red").when(F.contains(line, F.lit(BLUE)), "blue")
        of_literal = lambda v: F.when(_is_object(v), F.struct(*[F.try_variant_get(v, f"$.state.{at}", "double").alias(name) for name, at in names.items()]))
        of_plain = lambda said: F.struct(*[F.regexp_extract(said, plain, i).try_cast("double").alias(name) for i, name in enumerate(names, 1)])
        values = lambda said: F.when(said.rlike(plain), of_plain(said)).otherwise(_let(literals.literal(said), of_literal))
        return F.struct(side.alias("mark"), F.when(side.isNull(), _let(F.regexp_extract(line, r"(?s)\{.*\}", 0), values)).alias("values"))

    start = F.struct(F.lit(None).cast("string").alias("side"), F.lit(0).alias("red"), F.lit(0).alias("blue"), F.array().cast(f"array<{unit}>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        red = a["side"] == "red"
        n = F.when(red, a["red"]).otherwise(a["blue"]) + 1
        one = F.struct(F.concat(a["side"], n.cast("string")).alias("unit"), a["side"].alias("side"), *[line["values"][name].alias(name) for name in names])
        taken = F.struct(a["side"].alias("side"), F.when(red, n).otherwise(a["red"]).alias("red"), F.when(red, a["blue"]).otherwise(n).alias("blue"), F.concat(a["out"], F.array(one)).alias("out"))
        turned = F.struct(line["mark"].alias("side"), a["red"].alias("red"), a["blue"].alias("blue"), a["out"].alias("out"))
        return F.when(line["mark"].isNotNull(), turned).when(a["side"].isNotNull() & line["values"].isNotNull(), taken).otherwise(a)

    return F.aggregate(F.transform(F.split(strip(text), "\n"), read), start, step, lambda a: a["out"])
