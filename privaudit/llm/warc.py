"""WARC archives: writing with payload deduplication, and verified reading.

Writing: one record per page.  Of the records with equal payloads of at least
``least_bytes`` bytes the one with the smallest ``page_id`` is a ``response`` with
the payload, the others are ``revisit`` records that refer to it.  Spark's text
writer puts them down: a row is a record without its closing two line breaks,
which are the line separator, so the files are plain WARC/1.1.

Reading: Spark's text reader cuts the files at the version line, inside payloads
as well.  Each piece that has a complete header is a candidate: it claims a
length, so it names the offset of its successor.  A task follows the links that
stay in its split, so each of its candidates knows where its chain leaves the
split.  Pointer jumping over these exits, from offset zero of each file, finds
the one true entry of each split: a record-like text inside a payload is never
reached.  A chain that ends anywhere but at a file's end is an error.  A second
pass over the files walks from each split's entry and reads the payloads of the
records on the chain only, so false candidates cost their header and no more.

Offsets inside a split come from adding up lengths, and a split's own offset from
the splits before it, so no reader internals are needed.  A payload of which one
task does not see all, since it holds the version line and crosses the end of a
split, is put together by a join on the splits that it lies in.

Defined cases: a null payload is empty; a null url is an empty target; rows that
repeat a ``page_id`` with the smallest id of their payload are responses each; a
null ``page_id`` is never referred to and is a response; an empty table gives an
empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from privaudit.llm.storage import materialize, scratch, spread_join

MAGIC = "WARC/1.1\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows about splits are broadcast up to so many, and joined beyond.
_BROADCAST_ROWS = 100_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0, records_per_file: int = 50_000) -> str:
    """Write ``page_id, url, html`` as WARC files; returns the folder.

    Payloads are hashed where they are, and copies are found by ids and digests
    alone.  Pages then meet the list of revisits, which Spark broadcasts up to the
    session's threshold; a longer list costs one shuffle of the pages.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    digests = materialize(rows.select("page_id", F.sha1("html").alias("sha1"), F.octet_length("html").alias("bytes")).where("page_id is not null").where(F.col("bytes") >= least_bytes), "warc-digests")
    # copies are counted before they are joined: a payload with one page never is
    first = digests.groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = spread_join(digests, first.drop("copies"), ["sha1", "bytes"]).where("page_id <> first").select(F.col("page_id").alias("again_id"), F.col("sha1").alias("again_sha1"), "first").distinct()
    again = materialize(again, "warc-revisits")
    joined = rows.join(again, (F.col("page_id") == F.col("again_id")) & (F.sha1("html") == F.col("again_sha1")), "left")

    revisit = F.col("first").isNotNull()
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    uri = F.translate(F.col("url"), "\r\n", "")
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("html")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    joined.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "none").text(path)
    return path


_LENGTH, _URN = re.compile("[0-9]{1,15}"), re.compile("<urn:page:(-?[0-9]{1,19})>")


def parse_header(head: bytes) -> tuple[dict[str, str], int] | None:
    """Fields and length of a record header that follows the version line; None if it is not one."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields: dict[str, str] = {}
    for line in head[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or b" " in name:
            return None
        fields.setdefault(name.decode("latin-1").lower(), value.strip().decode("utf-8", "replace"))
    if not _LENGTH.fullmatch(fields.get("content-length", "")) or "warc-type" not in fields:
        return None
    return fields, end + 4


def _page(urn: str | None) -> int | None:
    found = _URN.fullmatch(urn or "")
    number = int(found[1]) if found else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each piece its row, its offset in its split, and itself with the version line that the reader took away."""
    now, at, lead = None, 0, False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != now:
                now, at, lead = row[:2], 0, row[1] == 0  # before a file's first version line stands nothing, or no record
            whole = row[2] if lead else MAGIC.encode() + row[2]
            yield row, at, whole, lead
            at, lead = at + len(whole), False


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


_CANDIDATES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("exit_at", pa.int64())])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split (its size, at -1), and one per record-like piece: where its chain leaves the split."""

    def rows(now, size, found):
        exits: dict[int, int] = {}
        for start, end in reversed(found):
            exits[start] = exits.get(end, end)
        return _batch([(*now, -1, size, None), *((*now, start, end - start, exits[start]) for start, end in found)], _CANDIDATES)

    now, size, found = None, 0, []
    for row, at, whole, lead in _splits(batches):
        if row[:2] != now:
            if now is not None:
                yield rows(now, size, found)
            now, found = row[:2], []
        size = at + len(whole)
        head = None if lead else parse_header(row[2])
        if head:
            found.append((at, at + len(MAGIC) + head[1] + int(head[0]["content-length"]) + 4))
    if now is not None:
        yield rows(now, size, found)


class _Payload:
    """Hashes a record's payload, which follows the HTTP header of its block."""

    def __init__(self, length: int):
        self.left, self.hash, self.bytes, self.pending = length, hashlib.sha1(), 0, b""

    def feed(self, data: bytes) -> None:
        data = data[: self.left]
        self.left -= len(data)
        if self.pending is not None:
            self.pending += data
            cut = self.pending.find(b"\r\n\r\n")
            if cut < 0:
                return
            data, self.pending = self.pending[cut + 4 :], None
        self.hash.update(data)
        self.bytes += len(data)

    def digest(self) -> str:
        return base64.b32encode(self.hash.digest()).decode()


_RECORDS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("sha1", pa.string()), ("open", pa.bool_())])
_RECORD_COLUMNS = "file string, start long, stop long, kind string, page_id long, refers_to long, digest string, length long, payload_bytes long, sha1 string, open boolean"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records on the chain from each split's entry; ``open``: the split does not hold all of the payload."""
    now, expected, reading, out = None, None, None, []

    def close():
        nonlocal reading
        if reading is not None:
            fields, start, stop, payload = reading
            done = payload.left == 0
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            out.append((now[0], start, stop, fields["warc-type"], _page(fields.get("warc-record-id")), _page(fields.get("warc-refers-to")), digest, int(fields["content-length"]), payload.bytes if done else None, payload.digest() if done else None, not done))
            reading = None

    for row, at, whole, lead in _splits(batches):
        file, block, piece, base, entry = row
        if (file, block) != now:
            close()
            now, expected = (file, block), entry
        if base + at == expected and not lead:
            close()
            fields, begin = parse_header(piece)
            stop = expected + len(MAGIC) + begin + int(fields["content-length"]) + 4
            reading = (fields, expected, stop, _Payload(int(fields["content-length"])))
            reading[3].feed(piece[begin:])
            expected = stop
        elif reading is not None:
            reading[3].feed(whole)
        if len(out) >= 1000:
            yield _batch(out, _RECORDS)
            out.clear()
    close()
    yield _batch(out, _RECORDS)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records on the chains from the files' starts.

    ``file, start, kind, page_id, refers_to, digest`` (as the header says),
    ``length, payload_bytes, sha1`` (of the payload read).
    """
    columns = ["file", "start", "kind", "page_id", "refers_to", "digest", "length", "payload_bytes", "sha1"]
    if spark.read.text(path).isEmpty():
        return spark.createDataFrame([], _RECORD_COLUMNS).select(columns)
    scanned = materialize(_pieces(spark, path).mapInArrow(_candidates, "file string, block long, at long, size long, exit_at long"), "warc-candidates")
    # where each split begins: a row per split
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = scanned.where("at < 0").select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.col("size").alias("held"), F.sum("size").over(Window.partitionBy("file")).alias("file_size"))
    splits = materialize(splits, "warc-splits")
    known = scanned.where("at >= 0").join(splits, ["file", "block"])
    candidates = materialize(known.select("file", "block", (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("exit_at")).alias("leaves")), "warc-offsets")

    # pointer jumping over the splits' exits: reach doubles each time
    jumps = candidates.select("file", "start", F.col("leaves").alias("to"))
    reached = splits.where("held > 0").select("file").distinct().select("file", F.lit(0).cast("long").alias("start"))
    size = reached.count()
    while True:
        further = reached.join(jumps, ["file", "start"]).select("file", F.col("to").alias("start"))
        reached = materialize(reached.union(further).distinct(), "warc-reached")
        count = reached.count()
        if count == size:
            break
        size = count
        ahead = jumps.select("file", F.col("start").alias("to"), F.col("to").alias("next"))
        jumps = materialize(jumps.join(ahead, ["file", "to"], "left").select("file", "start", F.coalesce("next", "to").alias("to")), "warc-jumps")

    ends = reached.join(splits.select("file", "file_size").distinct(), "file").where("start = file_size")
    files = splits.where("held > 0").select("file").distinct()
    if not files.join(ends, "file", "left_anti").isEmpty():
        raise ValueError("a chain of records does not lead from its file's start to its end")
    # a row per split that a record starts in
    entries = candidates.join(reached, ["file", "start"]).groupBy("file", "block").agg(F.min("start").alias("entry"))
    entries = materialize(splits.join(entries, ["file", "block"]).select("file", "block", "base", "entry"), "warc-entries")

    if entries.count() <= _BROADCAST_ROWS:
        placed = _pieces(spark, path).join(F.broadcast(entries), ["file", "block"])
    else:  # pieces of a split come together again, in the order in which they were read
        order = F.monotonically_increasing_id().alias("order")
        placed = _pieces(spark, path).select("*", order).join(entries, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "order")
    records = materialize(placed.select("file", "block", "piece", "base", "entry").mapInArrow(_records, _RECORD_COLUMNS), "warc-records")
    cut = records.where("open")
    if cut.isEmpty():
        return records.select(columns)
    return records.where("not open").select(columns).union(_whole(spark, path, cut, splits).select(columns))


def _whole(spark: SparkSession, path: str, cut: DataFrame, splits: DataFrame) -> DataFrame:
    """Payloads that no single task saw: their pieces are joined by the splits they lie in and hashed in order.

    A split has at most one such record, its last, and rows about splits and
    records are all that meet by file.
    """

    def place(batches):
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("piece", pa.binary())])
        rows: list[tuple] = []
        size = 0
        for row, at, whole, _ in _splits(batches):
            rows.append((*row[:2], at, whole))
            size += len(whole)
            if size > 8 << 20:
                yield _batch(rows, schema)
                rows, size = [], 0
        yield _batch(rows, schema)

    over = splits.select("file", "block", "base", (F.col("base") + F.col("held")).alias("end"))
    wanted = over.join(cut.select("file", "start", "stop"), "file").where("base < stop and end > start").select("file", "block", "base", "start", "stop")
    wanted = materialize(wanted, "warc-cut")
    placed = _pieces(spark, path).mapInArrow(place, "file string, block long, at long, piece binary").join(_few(wanted), ["file", "block"])
    held = placed.select("file", "start", "stop", (F.col("base") + F.col("at")).alias("from"), "piece").where((F.col("from") < F.col("stop")) & (F.col("from") + F.octet_length("piece") > F.col("start")))
    held = held.repartition("file", "start").sortWithinPartitions("file", "start", "from")

    def hashed(batches):
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("payload_bytes", pa.int64()), ("sha1", pa.string())])
        now, payload = None, None
        rows: list[tuple] = []
        for batch in batches:
            for file, start, piece in zip(*(batch.column(k).to_pylist() for k in ("file", "start", "piece"))):
                if (file, start) == now:
                    payload.feed(piece)
                    continue
                if now is not None:
                    rows.append((*now, payload.bytes, payload.digest()))
                now, head = (file, start), parse_header(piece[len(MAGIC) :])
                payload = _Payload(int(head[0]["content-length"]))
                payload.feed(piece[len(MAGIC) + head[1] :])
        if now is not None:
            rows.append((*now, payload.bytes, payload.digest()))
        yield _batch(rows, schema)

    found = held.mapInArrow(hashed, "file string, start long, payload_bytes long, sha1 string")
    return cut.drop("payload_bytes", "sha1").join(found, ["file", "start"])


def resolve(records: DataFrame) -> DataFrame:
    """One row per page: payload size and digest, for revisits those of the record they refer to.

    A payload whose digest is not the one its header states, or a revisit
    whose response is missing, is an error.
    """
    responses = records.where("kind = 'response'")
    wrong = F.when(F.col("sha1") != F.col("digest"), F.raise_error(F.lit("a payload does not have the digest that its header states"))).otherwise(F.col("sha1"))
    own = responses.select("page_id", "payload_bytes", wrong.alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = records.where("kind = 'revisit'").select("page_id", "refers_to", "digest", F.col("kind").alias("record_type"))
    targets = responses.select(F.col("page_id").alias("refers_to"), F.col("digest"), "payload_bytes", F.col("sha1").alias("found")).distinct()
    lost = F.when(F.col("found").isNull() | (F.col("found") != F.col("digest")), F.raise_error(F.lit("a revisit does not lead to its payload"))).otherwise(F.col("found"))
    return own.union(spread_join(materialize(revisits, "warc-revisits"), targets, ["refers_to", "digest"], "left").select("page_id", "payload_bytes", lost.alias("payload_digest"), "record_type", "refers_to"))
