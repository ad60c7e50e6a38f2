"""WARC archives without repeated payloads: revisit resolution.

Pages become the records of a WARC/1.1 archive. Of the pages with equal
payloads (of at least ``min_bytes`` bytes) the one with the smallest id is
stored whole, as ``response``; every other is a ``revisit`` that names it. The
steps:

1. headers: id, address, length and digests of each payload, payloads left
   behind; they are counted by payload identity (SHA-256 of the bytes), with
   partial counts before the shuffle;
2. the first header of each repeated payload, joined to the others of it;
3. the archive: a response for every different payload, read from the pages
   again (payloads are never shuffled, but for those of full duplicates, see
   below), a revisit with fresh headers for every other row;
4. :func:`read_archives` reads an archive back, holds each record against its
   Content-Length and its payload against its digest;
5. :func:`resolve` joins revisits to the responses they name.

Every record starts with the version line and the WARC-Warcinfo-ID of the run,
a random UUID that no payload from before the run can hold. So these two lines
separate records without a doubt, a large archive file is read in splits, and
the files are written by Spark's own text writer with its commit protocol
(hence their names, ``part-*``). Archives whose records start otherwise are
refused.

Rows: a null payload is empty. A null id is larger than any other, a null
address too; the address breaks ties of id. Rows equal in id, address and
payload are one response and revisits of it, as any others. A null address is
written ``urn:page:<id>``, one with control characters or blanks URL-encoded.
An empty table gives an empty archive. Other columns of the table are ignored.

At scale: all copies of one payload are a third of the rows at most in rows
of some 100 bytes; they are counted by partial sums, the repeated payloads'
table is broadcast only when it is measured to be small, else a merge join
that adaptive execution splits. Rows that are equal in everything are counted
and written out again in blocks of ``BLOCK``.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .common import intermediates, written

CRLF = "\r\n"
BLOCK = 4096
# The version line, the profile of RFC-style revisits, base32.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """A 40-digit hexadecimal number in base32: four letters for five digits."""
    groups = [F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0")
              for at in range(1, 41, 5)]
    return F.translate(F.concat(*groups), BASE32HEX, BASE32)


def payload_digest(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload.cast("binary")))


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            payload_col: str = "html") -> DataFrame:
    """Each page's id, address, payload, its length, SHA-1 and identity."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("bigint").alias("bytes"),
        payload_digest(F.col("payload")).alias("digest"),
        F.sha2(F.col("payload"), 256).alias("key"))


def _uuid(*parts: Column) -> Column:
    """A name-based UUID, so that a task that runs again writes the same."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws(
        "-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        F.lit(">"))


def _address(url: Column, page_id: Column) -> Column:
    known = F.when(url.rlike(r"[\x00-\x20\x7F]"), F.url_encode(url)).otherwise(url)
    return F.coalesce(known, F.concat(F.lit("urn:page:"),
                                      F.coalesce(page_id.cast("string"), F.lit("null"))))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field without a value is left out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
                             for name, value in fields])


def _record(marker: str, kind: str, record_id: Column, date: str, fields: list,
            payload: Column | None) -> Column:
    """The text of one record, but for its last line end, which the writer adds.
    The block is an HTTP head and, in a response, the payload."""
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
                          "Content-Length: "), F.col("bytes").cast("string"),
                    F.lit(CRLF + CRLF))
    block = head if payload is None else F.concat(head, payload)
    return F.concat(
        F.lit(marker),
        _lines(("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id),
               ("WARC-Date", F.lit(date)),
               ("WARC-Target-URI", _address(F.col("url"), F.col("page_id"))),
               ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
               *fields, ("Page-ID", F.col("page_id")),
               ("Content-Type", F.lit("application/http;msgtype=response")),
               ("Content-Length", F.octet_length(block))),
        F.lit(CRLF), block, F.lit(CRLF))


def _response_id(key: Column) -> Column:
    return _uuid(F.lit("response"), key)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 0, date: str | None = None) -> str:
    """Writes the pages as an archive without repeated payloads; ``date`` (now)
    is the records' WARC-Date."""
    spark = pages.sparkSession
    date = date or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    marker = f"{VERSION}{CRLF}WARC-Warcinfo-ID: <urn:uuid:{uuid.uuid4()}>{CRLF}"
    with intermediates(spark):
        whole = headers(pages, id_col, url_col, payload_col)
        heads = written(whole.groupBy("page_id", "url", "bytes", "digest", "key").agg(
            F.count(F.lit(1)).alias("n")), "warc-headers")
        shared = heads.where(F.col("bytes") >= min_bytes)
        first = F.min(F.struct(F.col("page_id").isNull().alias("a"), "page_id",
                               F.col("url").isNull().alias("b"), "url", "n"))
        repeated = written(
            shared.groupBy("key").agg(first.alias("f"), F.sum("n").alias("all"))
            .where("all > 1").select("key", F.col("f.page_id").alias("first_id"),
                                     F.col("f.url").alias("first_url"),
                                     F.col("f.n").alias("first_n")), "warc-repeated")
        side, small = bounded_broadcast(repeated)
        if not small:
            side = side.hint("merge")
        is_first = (F.col("page_id").eqNullSafe(F.col("first_id"))
                    & F.col("url").eqNullSafe(F.col("first_url")))

        stored = whole.join(side, "key", "left").where(F.col("first_n").isNull() | is_first)
        if min_bytes > 0:  # below the bound every row is a response of its own
            stored = stored.withColumn("rid", F.when(
                F.col("first_n").isNull(), _uuid(F.lit("own"), F.expr("uuid()"))))
        columns = ["page_id", "url", "bytes", "digest", "key", "payload"]
        rid = F.coalesce(F.col("rid"), _response_id(F.col("key"))) if min_bytes > 0 \
            else _response_id(F.col("key"))
        responses = stored.select(*columns, rid.alias("record_id"), "first_n")
        if not repeated.where("first_n > 1").isEmpty():
            one = responses.where("first_n > 1").groupBy(
                *[c for c in columns if c != "payload"], "record_id").agg(
                F.any_value("payload").alias("payload"))
            responses = responses.where("first_n is null or first_n = 1").select(
                *columns, "record_id").unionByName(one)
        texts = responses.select(_record(marker, "response", F.col("record_id"), date, [],
                                         F.col("payload")).alias("value"))

        copies = shared.join(side, "key").withColumn(
            "copies", F.col("n") - F.when(is_first, 1).otherwise(0)).where("copies > 0")
        copies = copies.withColumn("block", F.explode(F.expr(
            f"sequence(0L, (copies - 1) div {BLOCK})"))).repartition("key", "page_id", "block")
        copies = copies.withColumn("nth", F.explode(F.expr(
            f"sequence(block * {BLOCK}, least(copies, (block + 1) * {BLOCK}) - 1)")))
        again = copies.select(_record(
            marker, "revisit", _uuid(F.lit("revisit"), *map(F.col, ("key", "page_id", "url",
                                                                    "nth"))), date,
            [("WARC-Profile", F.lit(PROFILE)),
             ("WARC-Refers-To", _response_id(F.col("key"))),
             ("WARC-Refers-To-Target-URI", _address(F.col("first_url"), F.col("first_id"))),
             ("WARC-Refers-To-Date", F.lit(date))], None).alias("value"))
        texts.unionByName(again).write.option("lineSep", CRLF).text(path)
    return path


def _marker(spark: SparkSession, path: str) -> str | None:
    """The two lines that start each record of the archive at ``path``."""
    lines = [r["value"] for r in spark.read.option("lineSep", CRLF).text(path).head(2)]
    if not lines:
        return None
    if lines[0] != VERSION or not lines[1].startswith("WARC-Warcinfo-ID: "):
        raise ValueError(f"{path!r} is no archive of records that start with {VERSION} and a "
                         "WARC-Warcinfo-ID")
    return CRLF.join(lines) + CRLF


def _field(name: str) -> Column:
    value = F.regexp_extract("head", rf"(?imd)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: type, record_id, uri, page_id, refers_to,
    digest, bytes and payload (of a revisit: null and null). Raises for a record
    that is not as long as it says or whose payload has another digest."""
    marker = _marker(spark, path)
    text = spark.read.option("lineSep", marker or CRLF).text(path).where("value <> ''")
    cut = F.locate(CRLF * 2, F.col("value"))
    raw = text.select(F.substr("value", F.lit(1), cut + 1).alias("head"),
                      F.substr("value", cut + 4).alias("rest"))
    told = _field("Content-Length").cast("bigint") + 4
    whole = (F.octet_length("rest") == told) & F.endswith("rest", F.lit(CRLF * 2))
    raw = raw.select("head", F.when(whole, F.col("rest")).otherwise(F.raise_error(F.concat(
        F.lit("record of another length than it says: "), F.col("head")))).alias("rest"))
    body = F.substr("rest", F.locate(CRLF * 2, F.col("rest")) + 4)
    kind = _field("WARC-Type")
    fields = raw.select(
        kind.alias("type"), _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Target-URI").alias("uri"), _field("Page-ID").cast("bigint").alias("page_id"),
        _field("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("told"),
        F.when(kind != "revisit", F.substr(body, F.lit(1), F.length(body) - 4)).alias("payload"))
    found = payload_digest(F.col("payload"))
    digest = F.when(F.col("payload").isNull() | (found == F.col("told")), F.col("told")).otherwise(
        F.raise_error(F.concat(F.lit("payload of another digest: "), F.col("record_id"))))
    return fields.select("type", "record_id", "uri", "page_id", "refers_to",
                         digest.alias("digest"),
                         F.octet_length("payload").cast("bigint").alias("bytes"), "payload")


def resolve(records: DataFrame) -> DataFrame:
    """The records' own columns but payload, and from the response that a revisit
    names (same digest) its ``bytes`` and page, ``refers_page``; a revisit whose
    response is not there has nulls."""
    rows = records.select("type", "record_id", "uri", "page_id", "refers_to", "digest", "bytes")
    known = rows.where("type = 'response'").select(
        F.col("record_id").alias("refers_to"), "digest", F.col("page_id").alias("refers_page"),
        F.col("bytes").alias("refers_bytes"))
    joined = rows.where("type = 'revisit'").join(known, ["refers_to", "digest"], "left")
    return rows.where("type <> 'revisit'").withColumn(
        "refers_page", F.lit(None).cast("bigint")).unionByName(joined.select(
            "type", "record_id", "uri", "page_id", "refers_to", "digest",
            F.col("refers_bytes").alias("bytes"), "refers_page"))


def with_payloads(records: DataFrame) -> DataFrame:
    """All records with their full payloads, those of revisits from the
    responses they name. The copies come back to their full size."""
    known = records.where("type = 'response'").select(
        F.col("record_id").alias("refers_to"), "digest", F.col("payload").alias("full"))
    back = records.where("type = 'revisit'").join(known, ["refers_to", "digest"], "left")
    return records.where("type <> 'revisit'").select("record_id", "page_id", "uri", "payload") \
        .unionByName(back.select("record_id", "page_id", "uri", F.col("full").alias("payload")))


def digest(records: DataFrame) -> DataFrame:
    return resolve(records).select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_page").alias("refers_to"))
