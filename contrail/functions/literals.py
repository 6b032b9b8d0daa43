"""Python literals as JSON, by expressions: dictionaries, lists and tuples of strings, numbers, True, False and None.

A text is cut into tokens, and is no literal if anything but white space is left over. One pass over the tokens matches
brackets by kind, with what a tuple's parentheses need: those about one value without a comma only group it and go. Tokens
are then written as JSON: either quotes and Python's escapes, numbers as JSON has them, tuples as lists, a last comma left
out, keys that are numbers or names as text. What the brackets do not say (a missing comma, a lone colon) is
Spark's JSON parser's to reject, so ``literal`` is null for a text that is none.

Not taken, though Python would: sets, bytes, complex and hexadecimal numbers, prefixes of strings, strings side by side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens: strings in either quotes, numbers, names, punctuation.
_STRING = r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\""
_NUMBER = r"[-+]?(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][-+]?[0-9]+)?"
_TOKEN = rf"(?:{_STRING}|{_NUMBER}|(?:True|False|None)\b|[\[\](){{}},:])"
#: Units of a string: escapes with digits, other escapes, characters.
_UNIT = r"(?s)\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.|[^\\]"
#: Characters and escapes that JSON writes otherwise than Python.
_UNITS = {"'": "'", "\\'": "'", '"': '\\"', "\t": "\\t", "\r": "\\r", "\\a": "\\u0007", "\\v": "\\u000b"}
_SAME = ("\\\\", '\\"', "\\n", "\\t", "\\r", "\\b", "\\f")


def _string(token: Column) -> Column:
    """A string token as JSON; null with an escape that is not one."""

    def unit(u: Column) -> Column:
        code = F.lower(F.conv(F.substr(u, F.lit(2)), 8, 16))
        out = F.when(u.isin(*_SAME), u)
        for python, json in _UNITS.items():
            out = out.when(u == python, F.lit(json))
        out = out.when(u.rlike(r"^\\x[0-9a-fA-F]{2}$"), F.concat(F.lit("\\u00"), F.substr(u, F.lit(3)))).when(u.rlike(r"^\\u[0-9a-fA-F]{4}$"), u)
        out = out.when(u.rlike(r"^\\[0-7]"), F.concat(F.lit("\\u"), F.lpad(code, 4, "0")))
        out = out.when(u.rlike(r"^\\[xuUN]"), F.lit(None).cast("string")).when(F.length(u) == 2, F.concat(F.lit("\\"), u))
        return out.when(u.rlike(r"^[\x00-\x1F]$"), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(u))), 4, "0"))).otherwise(u)

    body = F.transform(F.regexp_extract_all(F.substr(token, F.lit(2), F.length(token) - 2), F.lit(_UNIT), F.lit(0)), unit)
    return F.when(F.exists(body, lambda u: u.isNull()), F.lit(None).cast("string")).otherwise(F.concat(F.lit('"'), F.array_join(body, ""), F.lit('"')))


def _number(token: Column) -> Column:
    """A number token as JSON: no plus, digits on both sides of a point; leading zeros of a float go."""
    x = F.regexp_replace(F.regexp_replace(token, "_", ""), r"^\+", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^(-?)\.", "$10."), r"\.(?=$|[eE])", ".0")
    return F.when(x.rlike(r"[.eE]"), F.regexp_replace(x, r"^(-?)0+(?=[0-9])", "$1")).otherwise(F.regexp_replace(x, r"^(-?)0+$", "$10"))


def json_text(text: Column) -> Column:
    """The literal as JSON text; null if its tokens or brackets are none of a literal."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    rest = F.regexp_replace(text, _TOKEN, "")
    open_ = "struct<kind:string,i:int,comma:boolean>"
    start = F.struct(F.lit(0).alias("i"), F.array().cast(f"array<{open_}>").alias("stack"), F.array().cast("array<int>").alias("dropped"), F.lit(0).alias("values"), F.lit(True).alias("ok"))

    def read(whole: Column) -> Column:
        at = lambda i: F.get(whole, i)

        def step(s: Column, t: Column) -> Column:
            top = F.element_at(s["stack"], -1)
            under = F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)
            state = lambda stack, dropped=s["dropped"], ok=s["ok"]: F.struct((s["i"] + 1).alias("i"), stack.alias("stack"), dropped.alias("dropped"), (s["values"] + F.when(none & ~t.isin(")", "]", "}"), 1).otherwise(0)).alias("values"), ok.alias("ok"))
            none = F.size(s["stack"]) == 0
            pushed = F.concat(s["stack"], F.array(F.struct(t.alias("kind"), s["i"].alias("i"), F.lit(False).alias("comma"))))
            fits = ((t == ")") & (top["kind"] == "(")) | ((t == "]") & (top["kind"] == "[")) | ((t == "}") & (top["kind"] == "{"))
            groups = (t == ")") & ~top["comma"] & (top["i"] < s["i"] - 1)
            closed = F.when(groups, state(under, F.concat(s["dropped"], F.array(top["i"], s["i"])))).otherwise(state(under))
            marked = F.concat(under, F.array(F.struct(top["kind"].alias("kind"), top["i"].alias("i"), F.lit(True).alias("comma"))))
            wrong = state(s["stack"], ok=F.lit(False))
            return F.when(~s["ok"], s).when(t.isin("(", "[", "{"), state(pushed)).when(t.isin(")", "]", "}"), F.when(none, wrong).when(fits, closed).otherwise(wrong)).when((t == ",") & ~none, state(marked)).otherwise(state(s["stack"]))

        def written(t: Column, i: Column) -> Column:
            last = (t == ",") & at(i + 1).isin(")", "]", "}") & ~at(i - 1).isin("(", "[", "{", ",")
            key = at(i + 1) == ":"
            name = F.when(t == "True", "true").when(t == "False", "false").otherwise("null")
            said = F.when(t == "(", "[").when(t == ")", "]").when(t.isin("[", "]", "{", "}", ",", ":"), t)
            said = said.when(t.rlike(r"^['\"]"), _string(t)).when(t.isin("True", "False", "None"), F.when(key, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(name))
            return F.when(last, F.lit("")).otherwise(said.otherwise(F.when(key, F.concat(F.lit('"'), _number(t), F.lit('"'))).otherwise(_number(t))))

        def joined(s: Column) -> Column:
            parts = F.transform(whole, lambda t, i: F.when(F.array_contains(s["dropped"], i), F.lit("")).otherwise(written(t, i)))
            return F.when(s["ok"] & (s["values"] == 1) & (F.size(s["stack"]) == 0) & ~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, " "))

        return F.transform(F.array(F.aggregate(whole, start, step)), joined)[0]

    return F.when(F.length(F.regexp_replace(rest, r"\s+", "")) == 0, F.transform(F.array(tokens), read)[0])


def literal(text: Column) -> Column:
    """The literal as a variant; null for a text that is none."""
    return F.try_parse_json(json_text(text))
