"""Message-shaped views over the driver's tables, in Spark and in DuckDB.

The SQL text is shared; the engines differ only in the functions of ``Dialect``.  The clock is
fixed: ``AS_OF``.
"""

import datetime as dt
import zlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heedline import constants as C
from heedline import schemas
from heedline.session import durable
from heedline.sources.landing import HASH_VERSION

AS_OF = dt.date(2024, 1, 31)
AS_OF_TIME = dt.datetime(2024, 1, 31, 12, 0, 0)
AS_OF_SECONDS = 1706702400
FIRST_SECOND = 1704067200  # 2024-01-01 00:00 UTC

_OPEN: dict[tuple, "Views"] = {}

TABLES = ("documents", "labels", "pages", "conversations", "events", "orders", "lineitem", "customer")


class Spark:
    @staticmethod
    def sha(x: str) -> str:
        return f"sha2({x},256)"

    @staticmethod
    def strip(x: str) -> str:
        codes = ",".join(f"char({ord(c)})" for c in C.WHITESPACE if ord(c) < 128)
        return f"btrim({x}, concat({codes}))"

    @staticmethod
    def rfc(seconds: str) -> str:
        return f"date_format(timestamp_seconds({seconds}),'EEE, dd MMM yyyy HH:mm:ss')"

    @staticmethod
    def iso(seconds: str) -> str:
        return f"date_format(timestamp_seconds({seconds}),\"yyyy-MM-dd'T'HH:mm:ss\")"

    newline = "char(10)"


class Duck:
    @staticmethod
    def sha(x: str) -> str:
        return f"sha256({x})"

    @staticmethod
    def strip(x: str) -> str:
        codes = ",".join(f"chr({ord(c)})" for c in C.WHITESPACE if ord(c) < 128)
        return f"trim({x}, concat({codes}))"

    @staticmethod
    def rfc(seconds: str) -> str:
        return f"strftime(make_timestamp(({seconds})*1000000),'%a, %d %b %Y %H:%M:%S')"

    @staticmethod
    def iso(seconds: str) -> str:
        return f"strftime(make_timestamp(({seconds})*1000000),'%Y-%m-%dT%H:%M:%S')"

    newline = "chr(10)"


def _views(d, also: str = "") -> dict[str, str]:
    nl = d.newline
    instant = f"{FIRST_SECOND} + doc_id * 1800"
    offset = "case doc_id % 4 when 1 then -25200 when 2 then 19800 else 0 end"
    zone = "case doc_id % 4 when 0 then '+0000' when 1 then '-0700 (PDT)' when 2 then '+0530' else 'GMT' end"
    zone_key = "case doc_id % 4 when 1 then '-07:00' when 2 then '+05:30' else '+00:00' end"
    return {
        "msgs0": f"""
SELECT doc_id, cast(doc_id as string) id, cast(doc_id % 100 as string) thread_id,
  concat(source, ' <noreply@', source, '.Example.com>') from_addr, 'me@example.com' to_addr,
  case when doc_id % 7 = 0 then '' else substr(text,1,40) end subject,
  case when doc_id % 3 = 0 then null else text end body_text,
  case when doc_id % 6 = 0 then text end body_html,
  case when doc_id % 15 = 0 then '' when doc_id % 6 = 3 then text else substr(text,1,100) end snippet,
  case when doc_id % 11 = 0 then '["SENT"]' when doc_id % 13 = 0 then null else '["STARRED","UNREAD"]' end label_ids,
  case when doc_id % 17 = 0 then null else {instant} end internal_date,
  case when doc_id % 9 = 0 then null else concat('<', cast(doc_id as string), '@', source, '>') end message_header_id,
  case when doc_id % 17 = 0 then (case when doc_id % 2 = 0 then 'garbage' end)
    else concat({d.rfc(f"{instant} + {offset}")}, ' ', {zone}) end date,
  case when doc_id % 17 = 0 then null else {instant} + {offset} end wall_seconds,
  case when doc_id % 17 = 0 then '' else concat({d.iso(f"{instant} + {offset}")}, {zone_key}) end date_key,
  {instant} + 3600 synced_seconds, source{also}
FROM documents""",
        "msgs1": f"""
SELECT *, coalesce(nullif(body_text,''), nullif(body_html,''), nullif(snippet,''), '') body,
  concat(case when from_addr <> '' then concat('From: ', from_addr, {nl}) else '' end,
         case when subject <> '' then concat('Subject: ', subject, {nl}) else '' end, {nl}) head
FROM msgs0""",
        "msgs": f"""
SELECT *, {d.sha("canonical")} body_hash FROM (
  SELECT *, {d.strip("concat(head, body)")} canonical
  FROM msgs1) AS c""",
        "cache": """
SELECT case when l.doc_id % 4 = 0 then null else m.id end message_id, m.body_hash content_hash,
  case when l.doc_id % 5 = 0 then 'pro' when l.doc_id % 2 = 0 then 'lite:gist:v3' else 'pro:gist:v3' end model_name,
  concat('{"category":"', case when quality = 1 then 'billing' else 'newsletter' end,
    '","intent":"info","frivolous":', case when quality = 0 then 'true' else 'false' end,
    ',"broadcast":', case when quality = 0 and l.doc_id % 2 = 0 then 'true' else 'false' end,
    ',"obligation":', case when l.doc_id % 3 = 0 then 'true' else 'false' end,
    ',"critical":', case when l.doc_id % 10 = 1 then 'true' else 'false' end,
    ',"sender":"', d.source, '","amount":', cast(l.doc_id as string),
    '.5,"currency":"EUR","clue":"item ', cast(l.doc_id as string),
    '","error":', case when toxic = 1 then '"blocked"' else 'null' end, '}') extracted_json,
  1704067200 + l.doc_id created_seconds
FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN msgs m ON m.doc_id = l.doc_id""",
        "atts": f"""
SELECT page_id, cast(page_id*2 as string) message_id,
  case when page_id % 5 = 0 then null else concat('a', cast(page_id as string)) end gmail_attachment_id,
  concat('p', cast(page_id as string), case when page_id % 4 = 0 then '.XLSX' when page_id % 4 = 1 then '.html' else '.pdf' end) filename,
  {d.sha("html")} content_hash, cast(length(html) as bigint) size_bytes,
  case when page_id % 6 = 0 then null else concat('/docs/', cast(page_id as string), '.pdf') end local_path,
  1704067200 + page_id*60 downloaded_seconds
FROM pages""",
        # Document rows of the cache: some succeeded, some failed, some failed and then succeeded.
        "doc_cache": """
SELECT cast(null as string) message_id, content_hash, model_name, extracted_json, created_seconds FROM (
  SELECT content_hash, 'lite:gist:v3' model_name,
    case when page_id % 2 = 0 then '{"error":"unreadable"}' else '{"error":null}' end extracted_json,
    1704067200 + page_id created_seconds
  FROM atts WHERE page_id % 3 = 0
  UNION ALL
  SELECT content_hash, 'pro:gist:v3' model_name, '{"clue":"retried"}' extracted_json, 1704067300 + page_id created_seconds
  FROM atts WHERE page_id % 12 = 0) AS c""",
        "all_cache": """
SELECT message_id, content_hash, model_name, extracted_json, created_seconds FROM cache
UNION ALL
SELECT message_id, content_hash, model_name, extracted_json, created_seconds FROM doc_cache""",
        "threads": """
SELECT concat(cast(conv_id as string), '-', cast(turn as string)) id, cast(conv_id as string) thread_id,
  case when role = 'assistant' then '["SENT"]' when role = 'system' then null else '["STARRED"]' end label_ids,
  text body_text, role, conv_id, turn
FROM conversations""",
    }


ORACLE_VIEWS = "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in _views(Duck).items()) + "\n"


def message_columns(rows: DataFrame) -> DataFrame:
    """Rows of ``msgs`` with the columns of the messages table that SQL spells otherwise."""
    return rows.withColumns(
        {
            "label_ids": F.from_json("label_ids", "array<string>"),
            "synced_at": F.timestamp_seconds("synced_seconds"),
            "date_wall": F.timestamp_seconds("wall_seconds").cast("timestamp_ntz"),
            "hash_version": F.lit(HASH_VERSION),
        }
    )


class Views:
    """The views as DataFrames with the library's table schemas."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # Temp views are per session; a name per folder keeps two scales apart.
        self._prefix = f"t{zlib.crc32(sf_dir.encode()):08x}"
        self._tables: dict[str, DataFrame] = {}
        self._sql = _views(Spark)

    @staticmethod
    def of(spark: SparkSession, sf_dir: str) -> "Views":
        """One instance per session and folder, so that tables are opened once."""
        key = (spark.sparkContext.applicationId, id(spark), sf_dir)
        if key not in _OPEN:
            _OPEN[key] = Views(spark, sf_dir)
        return _OPEN[key]

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._tables[name].createOrReplaceTempView(f"{self._prefix}_{name}")
        return self._tables[name]

    def view(self, name: str) -> DataFrame:
        """A view with the columns of the shared SQL, unadapted."""
        names = list(self._sql)
        needed = [self._sql[n] for n in names[: names.index(name) + 1]]
        used = [t for t in TABLES if any(f" {t}" in sql for sql in needed)]
        for table in used:
            self.table(table)
        ctes = [f"{t} AS (SELECT * FROM {self._prefix}_{t})" for t in used]
        ctes += [f"{n} AS ({sql})" for n, sql in zip(names, needed)]
        return self.spark.sql(f"WITH {',\n'.join(ctes)}\nSELECT * FROM {name}")

    def with_text(self, name: str) -> DataFrame:
        """``msgs0`` or ``msgs`` with the text of the document itself, for one pass over the documents.

        The driver's tables may be one file with one row group; so texts are dealt out before
        anything larger is made of them, unless there are files enough to read them in parallel.
        Documents without a doc_id match nothing and are left out.
        """
        files, table = self.spark.sparkContext.defaultParallelism, self.table("documents")
        dealt = table.where("doc_id IS NOT NULL")
        if len(table.inputFiles()) < files:
            dealt = dealt.repartition(files, "doc_id")
        dealt.createOrReplaceTempView(f"{self._prefix}_dealt_documents")
        sql = _views(Spark, ", text")
        needed = list(sql)[: list(sql).index(name) + 1]
        ctes = [f"documents AS (SELECT * FROM {self._prefix}_dealt_documents)", *[f"{n} AS ({sql[n]})" for n in needed]]
        return self.spark.sql(f"WITH {',\n'.join(ctes)}\nSELECT * FROM {name}")

    @cached_property
    def messages(self) -> DataFrame:
        rows = message_columns(self.view("msgs")).withColumn("raw_payload", F.lit(None).cast("string"))
        return self._stored(rows, schemas.MESSAGES, "id")

    def _stored(self, rows: DataFrame, schema: T.StructType, key: str) -> DataFrame:
        """A view as a table on disk, as the library's own tables are: several files, read by
        many queries.  The driver's tables are one file with one row group each."""
        files = self.spark.sparkContext.defaultParallelism
        return durable(schemas.align(rows, schema).repartition(files, key), "view")

    def _extractions(self, name: str) -> DataFrame:
        rows = self.view(name).withColumn("created_at", F.timestamp_seconds("created_seconds"))
        return self._stored(rows, schemas.EXTRACTIONS, "content_hash")

    @cached_property
    def cache(self) -> DataFrame:
        return self._extractions("cache")

    @cached_property
    def all_cache(self) -> DataFrame:
        return self._extractions("all_cache")

    @cached_property
    def attachments(self) -> DataFrame:
        rows = self.view("atts").withColumn("downloaded_at", F.timestamp_seconds("downloaded_seconds"))
        return self._stored(rows, schemas.ATTACHMENTS, "message_id")

    @cached_property
    def threads(self) -> DataFrame:
        rows = self.view("threads").withColumn("label_ids", F.from_json("label_ids", "array<string>"))
        return schemas.align(rows, schemas.MESSAGES)

    @cached_property
    def listing(self) -> DataFrame:
        """Paths that exist: every stored path except each seventh."""
        rows = self.table("pages").where(F.col("page_id") % 7 != 0)
        return rows.select(F.concat(F.lit("/docs/"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("path"))
