"""Message formatting: one plural argument, then named values; all in column expressions.

English and German know the categories one and other only.  Branches may hold braces nested to any depth; a
plural part whose braces don't close stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_HEAD = rf"\{{(\w+){_SPACE}*,{_SPACE}*plural{_SPACE}*,"
_KEY = rf"^{_SPACE}*([a-z]+|=\d+){_SPACE}*$"
_TOKEN = r"[^{}]+|[{}]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chosen(values: dict[str, Column], name: Column, otherwise: Column) -> Column:
    """The value with the name; null values count as missing."""
    for key, value in values.items():
        otherwise = F.when((name == key) & value.isNotNull(), value.cast("string")).otherwise(otherwise)
    return otherwise


def _closed(text: Column) -> Column:
    """The text up to the brace that closes the one before it; null if none does."""
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("body"))

    def step(state: Column, token: Column) -> Column:
        depth = state["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        inside = state["depth"] > 0
        return F.struct(F.when(inside, depth).otherwise(0).alias("depth"), F.when(inside & (depth > 0), F.concat(state["body"], token)).otherwise(state["body"]).alias("body"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), 0), start, step, lambda state: F.when(state["depth"] == 0, state["body"]))


def _branches(body: Column) -> Column:
    """(key, text) of the branches up to the first thing that is none."""
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("depth"), none.alias("key"), F.lit("").alias("text"), F.lit(False).alias("over"), F.array().cast("array<struct<key:string,text:string>>").alias("done"))

    def step(state: Column, token: Column) -> Column:
        depth, key = state["depth"], state["key"]
        opens, closes, top = token == "{", token == "}", depth == 0
        ends = closes & (depth == 1)
        found = F.regexp_extract(token, _KEY, 1)
        return F.when(state["over"], state).otherwise(F.struct(
            (depth + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(ends, none).when(top & ~opens, F.nullif(found, F.lit(""))).otherwise(key).alias("key"),
            F.when(top, "").when(ends, "").otherwise(F.concat(state["text"], token)).alias("text"),
            (top & (closes | (opens & key.isNull()))).alias("over"),
            F.when(ends, F.concat(state["done"], F.array(F.struct(key.alias("key"), state["text"].alias("text"))))).otherwise(state["done"]).alias("done"),
        ))

    return F.aggregate(F.regexp_extract_all(body, F.lit(_TOKEN), 0), start, step, lambda state: state["done"])


def plural(message: Column, values: dict[str, Column]) -> Column:
    """Resolves the first plural argument: =N, then the category, then other, then nothing; # is the number.

    The number is the value that the argument names, 0 where there is none; a whole number has no decimals.  Of
    branches with one key the last counts.
    """
    head, at = F.regexp_extract(message, _HEAD, 0), F.regexp_instr(message, F.lit(_HEAD))
    given = _chosen(values, F.regexp_extract(message, _HEAD, 1), F.lit("0"))
    number = F.regexp_replace(given, r"^([+-]?\d+)\.0+$", "$1")

    def resolved(body: Column) -> Column:
        whole = F.concat(head, body, F.lit("}"))
        before, after = F.substring(message, F.lit(1), at - 1), F.substring(message, at + F.length(whole), F.length(message))
        category = F.when(number == "1", "one").otherwise("other")

        def text(entries: Column) -> Column:
            branch = lambda key: F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["text"]
            return F.replace(F.coalesce(branch(F.concat(F.lit("="), number)), branch(category), branch(F.lit("other")), F.lit("")), F.lit("#"), number)

        return F.when(body.isNotNull(), F.concat(before, _expanded(_let(_branches(body), text), whole, before, after), after)).otherwise(message)

    return F.when(at > 0, _let(_closed(F.substring(message, at + F.length(head), F.length(message))), resolved)).otherwise(message)


def _expanded(text: Column, whole: Column, before: Column, after: Column) -> Column:
    """$$, $&, $` and $' in a text that takes the place of `whole`: a dollar, the whole, what is before and after it."""
    special = {"$$": F.lit("$"), "$&": whole, "$`": before, "$'": after}

    def one(part: Column) -> Column:
        out = part
        for mark, value in special.items():
            out = F.when(part == mark, value).otherwise(out)
        return out

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\$[$&`']|[^$]+|\$"), 0), one), "")


def named(message: Column, values: dict[str, Column]) -> Column:
    """{key} becomes its value, in one pass: braces inside values stay; unknown keys stay, a null value is the word null."""

    def one(part: Column) -> Column:
        return _chosen({"{" + key + "}": F.coalesce(value.cast("string"), F.lit("null")) for key, value in values.items()}, part, part)

    return F.array_join(F.transform(F.regexp_extract_all(message, F.lit(r"\{\w+\}|[^{]+|\{"), 0), one), "")


def formatted(message: Column, values: dict[str, Column]) -> Column:
    """The plural argument, then the named values."""
    return named(plural(message, values), values)


def presence_label(message: Column, count: Column) -> Column:
    """Empty for nobody."""
    return F.when(count == 0, F.lit("")).otherwise(formatted(message, {"count": count}))
