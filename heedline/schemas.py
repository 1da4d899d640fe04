"""Table schemas and the one rule for evolving them: columns are aligned by name."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("thread_id", T.StringType()),
        T.StructField("label_ids", T.ArrayType(T.StringType())),
        T.StructField("snippet", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("from_addr", T.StringType()),
        T.StructField("to_addr", T.StringType()),
        T.StructField("message_header_id", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("body_html", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("synced_at", T.TimestampType()),
        T.StructField("body_hash", T.StringType()),
        T.StructField("internal_date", T.LongType()),
        T.StructField("date_wall", T.TimestampNTZType()),
        T.StructField("hash_version", T.IntegerType()),
    ]
)

ATTACHMENTS = T.StructType(
    [
        T.StructField("message_id", T.StringType(), False),
        T.StructField("gmail_attachment_id", T.StringType()),
        T.StructField("filename", T.StringType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("pdf_hash", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("local_path", T.StringType()),
        T.StructField("downloaded_at", T.TimestampType()),
    ]
)

EXTRACTIONS = T.StructType(
    [
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("model_name", T.StringType(), False),
        T.StructField("extracted_json", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("message_id", T.StringType()),
    ]
)

# One raw message as it lands; the part tree is recursive, hence VARIANT.
RAW_MESSAGES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("threadId", T.StringType()),
        T.StructField("labelIds", T.ArrayType(T.StringType())),
        T.StructField("snippet", T.StringType()),
        T.StructField("internalDate", T.StringType()),
        T.StructField("payload", T.VariantType()),
    ]
)

# Fetched attachment bodies, base64url text as delivered.
RAW_ATTACHMENTS = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("attachment_id", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)

GIST = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("intent", T.StringType()),
        T.StructField("frivolous", T.BooleanType()),
        T.StructField("broadcast", T.BooleanType()),
        T.StructField("obligation", T.BooleanType()),
        T.StructField("critical", T.BooleanType()),
        T.StructField("sender", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("due_date", T.StringType()),
        T.StructField("clue", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

_MONEY = T.DecimalType(18, 4)

LINE_ITEM = T.StructType(
    [
        T.StructField("icon", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("attributes", T.ArrayType(T.StringType())),
        T.StructField("quantity", _MONEY),
        T.StructField("unit", T.StringType()),
        T.StructField("unit_price", _MONEY),
        T.StructField("subtotal", _MONEY),
    ]
)

INVOICE = T.StructType(
    [
        T.StructField("iban", T.ArrayType(T.StringType())),
        T.StructField("company_name", T.StringType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("amount", _MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("payment_reference", T.StringType()),
        T.StructField("line_items", T.ArrayType(LINE_ITEM)),
        T.StructField("invoice_date", T.StringType()),
        T.StructField("due_date", T.StringType()),
    ]
)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: order and cast known columns, add missing ones as NULL.

    This is the additive migration: an old table read through it has every newer column.
    """
    have = set(df.columns)

    def column(field: T.StructField) -> Column:
        source = F.col(field.name) if field.name in have else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[column(field) for field in schema.fields])
