"""Text cleaning, prompts and model output as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL and e-mail patterns of the cleaning rule. The URL's class is one range, without an alternation for
#: the matcher to recurse over: it takes 200,000 characters without a deep stack.
URL = r"https?://[!$-_a-z]+"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
#: All white space that stripping removes, as ranges of code points;
_SPACES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
SPACE = "".join(chr(c) for low, high in _SPACES for c in range(low, high + 1))
#: what a role template says without a system message, and the wording of a text-to-SQL question.
SYSTEM = "你是专业、简洁的中文助手。"
SQL_QUESTION = ("把问题转成 SQL：\n", "\nSCHEMA:\n")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def not_blank(c: Column) -> Column:
    """True for a text that is more than white space; false for null."""
    return F.coalesce(strip(c) != "", F.lit(False))


def clean_text(c: Column) -> Column:
    """URLs and addresses replaced, blanks collapsed, lines of at most ten characters dropped."""
    c = F.regexp_replace(F.regexp_replace(c, URL, "[URL]"), EMAIL, "[EMAIL]")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"[\r\n]+", "\n")
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: F.char_length(x) > 10)
    return strip(F.array_join(lines, "\n"))


def fence_strip(c: Column, strict: bool = False) -> Column:
    """Text within a code fence. ``strict``: a bare fence keeps what follows up to the end, closing fence included."""
    tagged = F.substring_index(F.split_part(c, F.lit("```json"), F.lit(2)), "```", 1)
    bare = F.substr(c, F.locate("```", c) + 3) if strict else F.split_part(c, F.lit("```"), F.lit(2))
    return strip(F.when(F.contains(c, F.lit("```json")), tagged).when(F.contains(c, F.lit("```")), bare).otherwise(c))


def trim_output(c: Column, end: str = "<|im_end|>") -> Column:
    """Up to the end marker, stripped; unchanged without one."""
    return F.when(F.contains(c, F.lit(end)), strip(F.substring_index(c, end, 1))).otherwise(c)


def after_marker(c: Column, marker: str = "<|assistant|>") -> Column:
    """After the last marker, stripped."""
    return strip(F.substring_index(c, marker, -1))


def fixed(c: Column, digits: int) -> Column:
    """Decimal text rounded half-even on the exact binary value, without grouping."""
    return F.call_function("format_number", c, F.lit("0." + "0" * digits if digits else "0"))


def role_prompt(system: Column, users: Column) -> Column:
    """The prompt of a system message, or the default without one, and an array of user messages."""
    said = F.array_join(F.coalesce(users, F.array().cast("array<string>")), "\n\n")
    return F.concat(F.lit("<|system|>\n"), F.coalesce(system, F.lit(SYSTEM)), F.lit("\n<|user|>\n"), said, F.lit("\n<|assistant|>\n"))


def sql_messages(prompt: Column, schema: Column, sql: Column) -> Column:
    """A text-to-SQL row as two messages, ``role, content``; a null part is an empty one."""
    has = lambda c: F.coalesce(c, F.lit(""))
    asked = F.concat(F.lit(SQL_QUESTION[0]), has(prompt), F.lit(SQL_QUESTION[1]), has(schema))
    return F.array(*[F.struct(F.lit(role).alias("role"), said.alias("content")) for role, said in (("user", asked), ("assistant", has(sql)))])


def intent(plan: Column) -> Column:
    """retreat before climb before intercept; a missing plan is an intercept."""
    p = F.lower(F.coalesce(plan, F.lit("")))
    has = lambda *w: F.contains(p, F.lit(w[0])) | F.contains(p, F.lit(w[1]))
    return F.when(has("retreat", "撤退"), "retreat").when(has("climb", "爬升"), "climb").otherwise("intercept")
