"""A model's raw text reply, as columns.

Fields of the reply are read as VARIANT so that a missing key, an explicit
null and a value of the wrong type stay distinguishable.
"""

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftdesk.constants import (
    CATEGORIES,
    DEFAULT_CATEGORY,
    DEFAULT_CONFIDENCE,
    DEFAULT_RESPONSE,
    DEFAULT_SEVERITY,
    DEFAULT_SUMMARY,
    PY_SPACE,
    SEVERITIES,
)
from siftdesk.functions.numbers import round_float
from siftdesk.schemas import CONFIDENCE, COST

FENCE = "```"

# The reader's own limits are far below what a reply may hold.
_UNLIMITED = {
    "maxStringLen": str(2**31 - 1),
    "maxNumLen": str(2**31 - 1),
    # Deeper ones would overflow the stack of the JVM's recursive reader.
    "maxNestingDepth": "1500",
}
_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE", **_UNLIMITED}


@dataclass(frozen=True)
class Prices:
    """Price of a million tokens, in and out."""

    per_million_in: Decimal
    per_million_out: Decimal


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(PY_SPACE))


def unfenced(raw: Column) -> Column:
    """The reply without the code fence around it.

    An opening fence takes the rest of its line with it, if a line follows.
    """
    text = strip(raw)
    opened = F.when(
        text.startswith(FENCE), F.regexp_replace(text, f"^{FENCE}[^\\n]*\\n|^{FENCE}", "")
    ).otherwise(text)
    closed = F.when(
        opened.endswith(FENCE), F.left(opened, F.char_length(opened) - len(FENCE))
    ).otherwise(opened)
    # Trimming walks the whole text, so only a text with a fence is trimmed twice.
    return F.when(text.startswith(FENCE) | text.endswith(FENCE), strip(closed)).otherwise(text)


def marked_list(body: Column) -> Column:
    """``body`` as the first element of a JSON list that must have two.

    A JSON parser stops at the end of the value it was asked for, so text
    after an object would go unseen. The second element, the body's hash, is
    found in its place only if the body is exactly one value.
    """
    mark = F.xxhash64(body).cast("string")
    return F.concat(F.lit("["), body, F.lit(',{"mark":'), mark, F.lit("}]"))


def read_list(listed: Column, fields: tuple[str, ...]) -> Column:
    """The list with the named fields of its reply; others are passed over."""
    record = ", ".join([*[f"{name} variant" for name in fields], "mark bigint"])
    return F.from_json(listed, f"array<struct<{record}>>", _STRICT)


def reply_record(body: Column, elements: Column) -> Column:
    """The reply's fields if ``body`` is exactly one JSON object, else null."""
    marked = F.get(elements, F.lit(1)).getField("mark") == F.xxhash64(body)
    whole = body.startswith("{") & (F.size(elements) == 2) & marked
    return F.when(whole, F.get(elements, F.lit(0)))


def kind(field: Column) -> Column:
    """Type name of a variant: null if the key is missing, VOID for a JSON null."""
    return F.schema_of_variant(field)


def variant_text(field: Column) -> Column:
    return F.try_variant_get(field, "$", "string")


def is_label(field_kind: Column) -> Column:
    """Whether a label can be read: the key is missing or holds a string."""
    return F.coalesce(field_kind, F.lit("STRING")) == "STRING"


def cleaned_label(field: Column) -> Column:
    return strip(F.lower(variant_text(field)))


def known_label(cleaned: Column, domain: tuple[str, ...], default: str) -> Column:
    return F.when(cleaned.isin(*domain), cleaned).otherwise(F.lit(default))


def severity(cleaned: Column) -> Column:
    return known_label(cleaned, SEVERITIES, DEFAULT_SEVERITY)


def category(cleaned: Column) -> Column:
    return known_label(cleaned, CATEGORIES, DEFAULT_CATEGORY)


def _is_number(field_kind: Column) -> Column:
    return field_kind.isin("BIGINT", "DOUBLE", "FLOAT") | field_kind.startswith("DECIMAL")


def number_tokens(body: Column, kinds: list[Column]) -> Column:
    """The text fields of the reply as written, if one of them is a number; else null."""
    wanted = F.lit(False)
    for field_kind in kinds:
        wanted = wanted | F.coalesce(_is_number(field_kind), F.lit(False))
    return F.when(wanted, F.from_json(body, "summary string, suggested_response string", _STRICT))


def _bound(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """``use`` over a record of the values, each worked out once."""
    record = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.get(F.transform(F.array(record), use), F.lit(0))


def _shortest(value: Column) -> Column:
    """The first of 1 to 17 significant digits that reads back as the same double."""
    tried = F.array(*[F.format_string(f"%.{places}e", value) for places in range(17)])
    return F.get(F.filter(tried, lambda text: text.try_cast("double") == value), F.lit(0))


def _digits(text: Column) -> dict[str, Column]:
    """Significant digits of a number, and the power of ten of the first one."""
    low = F.lower(text)
    whole = F.regexp_extract(low, "^-?([0-9]+)", 1)
    part = F.regexp_extract(low, "\\.([0-9]+)", 1)
    power = F.coalesce(F.regexp_extract(low, "e([+-]?[0-9]+)$", 1).try_cast("bigint"), F.lit(0))
    led = F.regexp_replace(F.concat(whole, part), "^0+", "")
    return {
        "digits": F.regexp_replace(led, "0+$", ""),
        # Leading zeros, of the whole part or behind the point, lower the power.
        "power": F.length(led) - F.length(part) + power - 1,
    }


def _spelled(n: Column) -> Column:
    """A number of which sign, digits and power of ten are known."""
    digits, power = n["digits"], n["power"].cast("int")
    padded = F.rpad(digits, F.greatest(F.length(digits), power + 1), F.lit("0"))
    after = F.substring(padded, power + 2, F.length(padded))
    plain = F.when(
        power >= 0,
        F.concat(F.left(padded, power + 1), F.lit("."), F.when(after == "", "0").otherwise(after)),
    ).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    rest = F.substring(digits, F.lit(2), F.length(digits))
    size = F.abs(power).cast("string")
    scientific = F.concat(
        F.left(digits, F.lit(1)),
        F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)),
        F.when(power < 0, "e-").otherwise("e+"),
        F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")),
    )
    return F.concat(n["sign"], F.when(power.between(-4, 15), plain).otherwise(scientific))


def number_text(token: Column) -> Column:
    """A JSON number as Python prints it: integers digit by digit, others in the
    shortest form that reads back as the same double.

    Up to 15 significant digits a number's own digits are that form; beyond, and
    near zero, the shortest is looked for.
    """
    token = F.btrim(token, F.lit('"'))  # the reader quotes what no double holds

    def float_text(n: Column) -> Column:
        value = n["value"]
        exact = (F.length(n["digits"]) <= 15) & (F.abs(value) >= F.lit(1e-300))
        text = F.when(exact, n["token"]).otherwise(_shortest(value))
        special = (
            F.when(F.isnan(value), F.lit("nan"))
            .when(F.abs(value) == F.lit(float("inf")), F.concat(n["sign"], F.lit("inf")))
            .when(value == 0, F.concat(n["sign"], F.lit("0.0")))
        )
        return F.coalesce(special, _bound({"sign": n["sign"], **_digits(text)}, _spelled))

    given = {
        "token": token,
        "value": token.try_cast("double"),
        "sign": F.when(token.startswith("-"), "-").otherwise(""),
        "digits": _digits(token)["digits"],
    }
    whole = F.when(token == "-0", "0").otherwise(token)
    return F.when(token.rlike("^-?[0-9]+$"), whole).otherwise(_bound(given, float_text))


def free_text(field: Column, field_kind: Column, token: Column, default: str) -> Column:
    """Any JSON value as text, ``token`` being a number as written; lists and
    objects stay JSON, with their keys in alphabetical order."""
    return (
        F.when(field_kind.isNull(), F.lit(default))
        .when(field_kind == "VOID", F.lit("None"))
        .when(field_kind == "BOOLEAN", F.initcap(variant_text(field)))
        .when(_is_number(field_kind), number_text(token))
        .otherwise(variant_text(field))
    )


def summary(field: Column, field_kind: Column, token: Column) -> Column:
    return free_text(field, field_kind, token, DEFAULT_SUMMARY)


def suggested_response(field: Column, field_kind: Column, token: Column) -> Column:
    return free_text(field, field_kind, token, DEFAULT_RESPONSE)


def clamped_number(field: Column, field_kind: Column) -> Column:
    """Numbers and booleans clamped to 0..1; anything else is the default."""
    number = F.when(_is_number(field_kind), F.try_variant_get(field, "$", "double")).when(
        field_kind == "BOOLEAN", F.try_variant_get(field, "$", "boolean").cast("double")
    )
    known = F.coalesce(number, F.lit(DEFAULT_CONFIDENCE))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), known))


def confidence(clamped: Column) -> Column:
    return round_float(clamped, 3).cast(CONFIDENCE)


def token_cost(tokens_in: Column, tokens_out: Column, prices: Prices) -> Column:
    """Cost of a call to six places; null if it does not fit the column."""
    millionths = tokens_in.cast("decimal(10,0)") * F.lit(Decimal(prices.per_million_in)) + (
        tokens_out.cast("decimal(10,0)") * F.lit(Decimal(prices.per_million_out))
    )
    return F.round(millionths / F.lit(Decimal(1_000_000)), 6).try_cast(COST)
