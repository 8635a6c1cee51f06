"""WARC archives: written by Spark's text writer, read back by verified record boundaries.

Writing: a record is one value of the text writer, whose line separator is the two line ends that
close a WARC record. Among equal payloads of at least min_revisit bytes, the page with the largest
page_id is the response and the others are revisit records without a block.

Reading: files are split at the version line, in parallel and within files, so that every version
line starts a candidate, also one inside a payload. A candidate knows its offset (a running sum of
lengths) and from its Content-Length the offset of its successor. Pointer jumping from the start
of each file, which doubles the reach in every round, keeps what the chain of records reaches; all
else is payload, and is put back into the record that it belongs to. Pieces of such a payload are
read a second time and found by their content, so nothing depends on how a read splits the files,
which may differ when executors come and go.

Nulls: a null html is an empty payload, a null url an empty target, a null page_id an empty id,
which is never another's response unless no equal payload has an id. Rows that repeat page_id and
payload are responses alike. Control characters in a url are percent-coded. A payload of any length
is one record, which a task holds whole. An empty table gives an archive without records. Extra
columns are not archived, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import key128, materialise, shared_path

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"


def write_archives(pages: DataFrame, path: str, min_revisit: int = 1000) -> None:
    """pages: page_id, url, html. One archive for each task."""
    payload = F.coalesce("html", F.lit(""))
    size, digest = F.octet_length(payload).cast("long"), F.sha1(payload.cast("binary"))
    groups = (pages.select("page_id", digest.alias("digest"), size.alias("size"))
              .filter(F.col("size") >= min_revisit)
              .groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
              .filter("n > 1").drop("n"))
    groups = materialise(groups, "warc-repeats")
    df = (pages.select("page_id", "url", payload.alias("payload"), digest.alias("digest"), size.alias("size"))
          .join(groups, ["digest", "size"], "left"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.coalesce("url", F.lit(""))
    control = "[\\x00-\\x1F\\x7F]"
    url = F.when(url.rlike(control), F.array_join(F.transform(
        F.split(url, ""), lambda c: F.when(c.rlike(control), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)), "")).otherwise(url)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = [F.lit(f"{MAGIC}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
            F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
            F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
            F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
            F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                                         "\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(""),
            F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
            F.when(again, F.lit("0")).otherwise(F.col("size").cast("string")), F.lit(END)]
    record = F.concat(*head, F.when(again, "").otherwise(F.col("payload")))
    df.select(record.alias("value")).write.option("lineSep", END).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file (a hash of its path), block, k, length, head, value: what follows each version line up to the next, in order of k.

    head is null where no header ends.
    """
    raw = (spark.read.option("lineSep", MAGIC).text(path)
           .select("value", F.xxhash64("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k")))
    cut = F.locate(END, F.col("value"))
    return raw.select("file", "block", "k", F.octet_length("value").cast("long").alias("length"),
                    F.when(cut > 0, F.substring_index("value", END, 1)).alias("head"), "value")


def _field(name: str) -> Column:
    return F.regexp_extract("head", f"(?:^|\r\n)(?i:{name}): *([^\r\n]*)", 1)


def _offsets(parts: DataFrame) -> DataFrame:
    """Adds at: the byte offset of the version line. Sums run in a block first, then over a file's blocks."""
    size = F.col("length") + len(MAGIC)
    w = Window.partitionBy("file", "block").orderBy("k")
    blocks = parts.groupBy("file", "block").agg(F.sum(size).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    upto = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the text before the first version line is the first value, so every offset is short of one magic
    return (parts.withColumn("upto", upto).join(blocks, ["file", "block"])
            .withColumn("at", F.col("base") + F.col("upto") - len(MAGIC)).drop("base", "upto"))


def reachable(links: DataFrame) -> DataFrame:
    """file, at: the candidates that the chain from offset 0 of each file reaches.

    links: file, at, next. Round k knows where 2^k steps lead, and doubles the set of those reached.
    """
    jump = materialise(links.select("file", "at", "next"), "warc-jumps")
    seen = materialise(jump.filter("at = 0").select("file", "at"), "warc-seen")
    count = seen.count()
    while True:
        ahead = seen.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")).join(
            links.select("file", "at"), ["file", "at"], "left_semi")
        seen = materialise(seen.unionByName(ahead).distinct(), "warc-seen")
        if (now := seen.count()) == count:
            return seen
        count = now
        jump = materialise(jump.join(jump.select("file", F.col("at").alias("next"), F.col("next").alias("then")),
                                     ["file", "next"]).select("file", "at", F.col("then").alias("next")), "warc-jumps")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, declared_digest: one row for each record.

    For a revisit the payload is that of the response that it refers to.
    """
    parts = candidates(spark, path)
    head_bytes = F.octet_length("head").cast("long") + len(END)
    content = F.when(_field("Content-Length").rlike("^[0-9]+$"), _field("Content-Length").cast("long"))
    # what lies in one piece is digested where it is read; payloads are moved only when a version line cut them
    body = F.substring(F.col("value").cast("binary"), head_bytes.cast("int") + 1, content.cast("int"))
    whole = F.col("length") - head_bytes >= content
    v1, v2 = key128(F.col("value"))
    parts = materialise(parts.select(
        "file", "block", "k", "length",
        _field("WARC-Type").alias("record_type"), _field("WARC-Record-ID").alias("id"),
        _field("WARC-Refers-To").alias("refers"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Payload-Digest").alias("declared_digest"),
        head_bytes.alias("head_bytes"), content.alias("content"),
        F.when(whole, F.sha1(body)).alias("digest"), v1.alias("v1"), v2.alias("v2")), "warc-parts")
    facts = materialise(_offsets(parts).filter("at >= 0"), "warc-candidates")
    step = F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("content") + len(END)
    links = facts.filter("content is not null").select("file", "at", step.alias("next"))
    seen = reachable(links)
    true = facts.join(seen, ["file", "at"], "left_semi")
    cut = materialise(true.filter("digest is null").select("file", "at", "head_bytes", "content"), "warc-cut")
    if not cut.isEmpty():
        true = true.join(_mended(spark, path, facts, seen, cut), ["file", "at"], "left").withColumn(
            "digest", F.coalesce("digest", "mended"))
    true = materialise(true, "warc-records")
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    rows = true.select(number("id").alias("page_id"), "url", "record_type", number("refers").alias("refers_to"),
                       F.col("content").alias("own_bytes"), F.col("digest").alias("own_digest"),
                       F.regexp_replace("declared_digest", "^sha1:", "").alias("declared_digest"))
    full = (rows.filter("record_type = 'response' and page_id is not null")
            .groupBy(F.col("page_id").alias("refers_to"), F.col("own_digest").alias("declared_digest"))
            .agg(F.max("own_bytes").alias("full_bytes")))
    revisit = rows.filter("record_type = 'revisit'").join(full, ["refers_to", "declared_digest"], "left")
    columns = ["page_id", "url", "record_type", "refers_to"]
    return (rows.filter("record_type <> 'revisit'")
            .select(*columns, F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"))
            .unionByName(revisit.select(*columns, F.col("full_bytes").alias("payload_bytes"),
                                        F.when(F.col("full_bytes").isNotNull(), F.col("declared_digest")).alias("payload_digest"))))


def _mended(spark: SparkSession, path: str, facts: DataFrame, seen: DataFrame, cut: DataFrame) -> DataFrame:
    """file, at, mended: digests of the payloads that hold version lines, put together from their pieces."""
    # every candidate belongs to the last record of its file that starts at or before it
    starts = cut.select("file", "at", F.col("at").alias("start"), "head_bytes", "content")
    true = seen.select("file", "at", F.lit(True).alias("true"))
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = (facts.select("file", "at", "length", "v1", "v2").join(true, ["file", "at"], "left")
             .withColumn("start", F.last(F.when(F.col("true"), F.col("at")), ignorenulls=True).over(upto)))
    pieces = materialise(owned.drop("true").join(starts.drop("at"), ["file", "start"]), "warc-pieces")
    content = ["length", "v1", "v2"]
    v1, v2 = key128(F.col("value"))
    values = candidates(spark, path).select("length", v1.alias("v1"), v2.alias("v2"), "value").join(
        pieces.select(*content).distinct(), content, "left_semi").groupBy(*content).agg(F.first("value").alias("value"))
    got = pieces.join(values, content)
    pieces_of = F.array_sort(F.collect_list(F.struct("at", "value")))
    joined = F.array_join(F.transform(pieces_of, lambda x: x.value), MAGIC)
    whole = got.groupBy("file", F.col("start").alias("at"), "head_bytes", "content").agg(joined.cast("binary").alias("all"))
    return whole.select("file", "at", F.sha1(F.substring("all", (F.col("head_bytes") + 1).cast("int"), F.col("content").cast("int"))).alias("mended"))
