"""Gist records: parse, validate, rank, print fields, and the two synthetic records
(SURVEY N8, H14, H15, H19, H21, C4, C5)."""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from heedline import constants as C
from heedline import schemas
from heedline.functions import dates
from heedline.functions.text import col, sender_name, filled, left, let_sql, or_empty, sql_list

_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
_NUMBER_WORD = r"(?i)^\s*[+-]?(?:inf|infinity|nan)\s*$"
_NUMBER_KIND = r"^(?:BIGINT|DOUBLE|DECIMAL.*)$"

_FLAGS = ("frivolous", "broadcast", "obligation", "critical")
_NULLABLE_TEXTS = ("currency", "due_date", "code", "error")


def whole_json_sql(json: str) -> str:
    """JSON text to VARIANT, NULL unless the *whole* text is one JSON value.

    The parser stops after the first value and ignores what follows.  A tail that survives
    inside an array breaks inside an object and the other way round, so both must parse.
    """
    listed = f"try_parse_json(concat('[', {json}, ']'))"
    boxed = f"""try_parse_json(concat('{{"v":', {json}, '}}'))"""
    return f"CASE WHEN {listed} IS NOT NULL THEN try_variant_get({boxed}, '$.v', 'variant') END"


def _fields_sql() -> str:
    """Every field of the record ``r`` as struct<kind, text>; kind is NULL when missing and
    VOID for JSON null."""

    def field(name: str) -> str:
        kind = f"schema_of_variant(try_variant_get(r, '$.{name}', 'variant'))"
        return f"'{name}', named_struct('kind', {kind}, 'text', try_variant_get(r, '$.{name}', 'string'))"

    return f"named_struct('kind', schema_of_variant(r), {', '.join(field(f.name) for f in schemas.GIST.fields)})"


def _typed_sql() -> str:
    """The fields ``f`` coerced to their types, NULL where that fails."""

    def flag(n: str) -> str:
        spelled = f"f.{n}.kind IN ('BOOLEAN', 'STRING') AND lower(f.{n}.text) IN"
        number = f"f.{n}.kind RLIKE r'{_NUMBER_KIND}' AND try_cast(f.{n}.text AS double) ="
        return f"""CASE WHEN {spelled} ({sql_list(C.TRUE_WORDS)}) THEN true
          WHEN {spelled} ({sql_list(C.FALSE_WORDS)}) THEN false
          WHEN {number} 1 THEN true WHEN {number} 0 THEN false END"""

    def string(n: str) -> str:
        return f"CASE WHEN f.{n}.kind = 'STRING' THEN f.{n}.text END"

    def number(n: str) -> str:
        shaped = f"(f.{n}.text RLIKE r'{_NUMBER}' OR f.{n}.text RLIKE r'{_NUMBER_WORD}')"
        return f"""CASE WHEN f.{n}.kind = 'BOOLEAN' THEN CASE WHEN f.{n}.text = 'true' THEN 1D ELSE 0D END
          WHEN f.{n}.kind RLIKE r'{_NUMBER_KIND}' OR (f.{n}.kind = 'STRING' AND {shaped})
          THEN try_cast(trim(f.{n}.text) AS double) END"""

    def value(n: str) -> str:
        return flag(n) if n in _FLAGS else number(n) if n == "amount" else string(n)

    return f"named_struct({', '.join(f"'{f.name}', {value(f.name)}" for f in schemas.GIST.fields)})"


def _fault_sql() -> str:
    """Name of the first field that breaks a rule in record ``g`` of fields ``f``, else NULL."""
    rules = [
        ("f.kind IS NULL", "json"),
        ("NOT f.kind LIKE 'OBJECT%'", "object"),
        (f"NOT coalesce(g.category IN ({sql_list(C.CATEGORIES)}), false)", "category"),
        (f"NOT coalesce(g.intent IN ({sql_list(C.INTENTS)}), false)", "intent"),
        *[(f"g.{n} IS NULL", n) for n in (*_FLAGS, "sender")],
        *[
            (f"g.{n} IS NULL AND coalesce(f.{n}.kind, 'VOID') <> 'VOID'", n)
            for n in ("amount", *_NULLABLE_TEXTS)
        ],
        (f"g.clue IS NULL OR length(g.clue) > {C.CLUE_MAX_CHARS}", "clue"),
    ]
    return f"CASE {' '.join(f"WHEN {test} THEN '{name}'" for test, name in rules)} END"


def parse_gist(json: str) -> Column:
    """A JSON text column as struct<gist, valid, reason>: the typed record, whether it holds,
    and the first fault.

    It is SQL text because each intermediate is used many times and must be computed once.
    """
    judged = let_sql("g", _typed_sql(), f"named_struct('gist', g, 'reason', {_fault_sql()})")
    result = """named_struct('gist', CASE WHEN j.reason IS NULL THEN j.gist END,
      'valid', j.reason IS NULL, 'reason', j.reason)"""
    fields = let_sql("r", whole_json_sql(json), _fields_sql())
    return F.expr(let_sql("j", let_sql("f", fields, judged), result))


def error_is_set(json: Column | str) -> Column:
    """The SQL-side test: ``$.error`` present and not null.  '' counts, bad JSON does not."""
    return F.get_json_object(col(json), "$.error").isNotNull()


def usable_cache_row(json: Column | str, parsed: Column, gist: bool) -> Column:
    """A cached text that ends the work: non-empty, and no gist carrying an error."""
    present = F.coalesce(col(json) != "", F.lit(False))
    if not gist:
        return present
    stale = parsed["valid"] & filled(parsed["gist"]["error"]).isNotNull()
    return present & ~stale


def priority_group(description: Column | str, parsed: Column) -> Column:
    """critical 3, obligation 2, noise 0, else 1; errors -1, no result -2."""
    g = parsed["gist"]
    return (
        F.when(filled(description).isNull(), -2)
        .when(~parsed["valid"], -1)
        .when(filled(g["error"]).isNotNull(), -1)
        .when(g["critical"], 3)
        .when(g["obligation"], 2)
        .when(g["broadcast"] | g["frivolous"], 0)
        .otherwise(1)
    )


def money(amount: Column | str, currency: Column | str) -> Column:
    """Whole units, half-even; symbol before the number, other codes after it."""
    code = F.upper(or_empty(currency))
    n = F.bround(col(amount), 0).cast("decimal(38,0)").cast("string")
    symbols = F.create_map(*[F.lit(x) for pair in C.CURRENCY_SYMBOLS.items() for x in pair])
    symbol = F.try_element_at(symbols, code)
    return F.when(symbol.isNotNull(), F.concat(symbol, n)).otherwise(
        F.concat_ws(" ", n, filled(code))
    )


def row_meta(gist: Column, as_of: Column | str | dt.date) -> Column:
    """Money, due phrase and code of a row, joined by blanks."""
    amount = F.when(gist["amount"].isNotNull(), money(gist["amount"], gist["currency"]))
    due = filled(dates.relative_due(gist["due_date"], as_of))
    return F.concat_ws(" ", amount, due, filled(gist["code"]))


def _to_json(**fields: Column | str | bool | None) -> Column:
    """A gist as JSON text with every field written, nulls included, in record order."""
    values = []
    for field in schemas.GIST.fields:
        value = fields.get(field.name)
        value = value if isinstance(value, Column) else F.lit(value)
        values.append(value.cast(field.dataType).alias(field.name))
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def blocked_gist(
    sender: Column | str, subject: Column | str, fallback: Column | str = "message_id"
) -> Column:
    """Record for content the classifier refuses: newsletter noise, no error (C4)."""
    clue = F.coalesce(filled(subject), filled(fallback), F.lit("blocked content"))
    return _to_json(
        category="newsletter",
        intent="info",
        frivolous=True,
        broadcast=True,
        obligation=False,
        critical=False,
        sender=sender_name(sender),
        clue=left(clue, C.CLUE_MAX_CHARS),
    )


def failure_gist(
    sender: Column | str,
    label: Column | str,
    subject: Column | str,
    message_id: Column | str,
    error: Column | str,
) -> Column:
    """Record for a failed attempt: other/info noise with the error text."""
    clue = F.coalesce(filled(label), filled(subject), filled(message_id), F.lit("n/a"))
    return _to_json(
        category="other",
        intent="info",
        frivolous=True,
        broadcast=False,
        obligation=False,
        critical=False,
        sender=sender_name(sender),
        clue=left(clue, C.CLUE_MAX_CHARS),
        error=col(error),
    )
