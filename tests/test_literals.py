"""Python literals against Python's own reader."""

import ast
import json

from pyspark.sql import functions as F

from contrail.functions import literals

TAKEN = [
    "{'state': {'heading': 30, 'position': (1, -2.5, 3e2), 'speed': .5}}",
    '{"state": {"heading": 5., "position": [1, 2, 3], "speed": None}}',
    "{'a': True, \"b\": False, 'c': [], 'd': (), 'e': {}}",
    "{'it\\'s': \"say \\\"hi\\\"\", 'q': '\"', \"p\": \"'\"}",
    "{'t': 'tab\\there', 'x': '\\x41\\u00e9\\101', 'back': '\\\\', 'odd': '\\d'}",
    "{'one': (1,), 'group': (1), 'deep': ((1, 2), [3, (4)]), 'last': [1, 2,], }",
    "{1: 'n', -2.5: 'm', None: 0}",
    "  [ 1 , 2 ]  ",
    "'红方 {x}, ]'",
    "+7",
    "1_000",
    "00",
    "01.5",
    "-0.0",
    "(((5)))",
    "{'nested': {'a': [{'b': (1, 2)}, {'c': 'd, }'}]}}",
    "['tab\there']",
]
REJECTED = ["", "{", "}", "{'a': 1", "(1, 2]", "[1 2]", "{'a' 1}", "[,]", "[1,,2]", "(,)", "{'a': }", "{:1}", "007", "True1", "nope", "{'a': b}", "'open", "1 2", "[1]]", "{'a': 1} x", "[1, 2)", "1__0", "'\\x4'"]


def plain(value):
    """A value as JSON has it: tuples as lists, keys as text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


def test_against_python(spark):
    df = spark.createDataFrame([(t,) for t in [*TAKEN, *REJECTED, None]], "t string")
    got = {r["t"]: (r["j"], r["v"]) for r in df.select("t", literals.json_text(F.col("t")).alias("j"), F.to_json(literals.literal(F.col("t"))).alias("v")).collect()}
    for t in TAKEN:
        assert got[t][1] is not None and json.loads(got[t][1]) == plain(ast.literal_eval(t.strip())), (t, got[t])
    for t in REJECTED:
        try:
            ast.literal_eval(t.strip())
            raise AssertionError(t)
        except (ValueError, SyntaxError):
            assert got[t][1] is None, (t, got[t])
    assert got[None] == (None, None)
