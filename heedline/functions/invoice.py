"""Invoice JSON to a typed nested record with stripped strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heedline import schemas
from heedline.functions.text import col, let, strip


def _stripped(value: Column, kind: T.DataType) -> Column:
    """Strip every string inside ``value``, whatever its nesting; absent lists become empty."""
    if isinstance(kind, T.StringType):
        return strip(value)
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: _stripped(x, kind.elementType))
        return F.coalesce(items, F.array().cast(kind))
    if isinstance(kind, T.StructType):
        fields = [_stripped(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def parse_invoice(json: Column | str) -> Column:
    """Invoice record, read once from its JSON text."""
    return let(F.from_json(col(json), schemas.INVOICE), lambda r: _stripped(r, schemas.INVOICE))


_REQUIRED = ("company_name", "amount", "currency", "payment_reference")
_ITEM_REQUIRED = ("icon", "kind", "quantity", "subtotal")


def invoice_is_complete(record: Column | str) -> Column:
    """All required fields present, on the invoice and on each of its line items."""
    r = col(record)
    ok = r.isNotNull()
    for name in _REQUIRED:
        ok = ok & r[name].isNotNull()

    def item_ok(item: Column) -> Column:
        held = F.lit(True)
        for name in _ITEM_REQUIRED:
            held = held & item[name].isNotNull()
        return held

    return ok & F.forall(r["line_items"], item_ok)
