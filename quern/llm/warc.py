"""WARC archives with a two-level capture index.

Records are packed into values of up to ``ARCHIVE_BYTES`` that Spark's text writer, with the record end (two line ends)
as separator, puts into a file each: uncompressed WARC/1.1 files, on any file system, by the usual commit protocol.
Equal payloads are stored once; the others revisit it. Archives are read back whole files at a time by record framing
alone. The captures' keys (host labels reversed, then path) are range-sorted into compressed blocks; the first key of
each block (of each few, if there are too many) makes the sparse directory. A lookup bisects the directory, reads the
block, bisects in it, compares urls, and reads the record's byte range from the archive. Many lookups are one job:
urls meet their blocks sorted, so a task holds one block at a time, and ranges are read in an archive's order.

Defined results: null html is an empty payload; a null url is written without target and has the key ')';
payloads under 100 bytes are always stored; of equal longer ones that with the smallest page id is stored (rows
that repeat that id are all stored; null ids never are the smallest where others exist); line ends in urls
are percent-encoded; a repeated url gives each of its captures once; a record is held whole, so it is at most 2 GB; an
empty table gives archives without records and no rows; other columns are never looked at.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, delete, durable, read, shared_dir, small_enough

#: Payloads that may be revisited, bytes of an archive (but for a longer record), lines of an index block.
LEAST_REVISITED, ARCHIVE_BYTES, BLOCK_LINES = 100, 16 << 20, 2_000
#: Groups of equal payloads (about 60 bytes each) and directory entries (about 100 bytes) that are broadcast or held.
BROADCAST_GROUPS, DIRECTORY_ENTRIES = 1_000_000, 200_000
DATE = "2024-01-01T00:00:00Z"

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "url_key string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, archive string, offset bigint, length bigint"
FIELDS = [x.split()[0] for x in ENTRY.split(", ")]
_KINDS = [{"string": pa.string(), "bigint": pa.int64()}[x.split()[1]] for x in ENTRY.split(", ")]


def _target(url: str) -> Column:
    """A url as records have it."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _records(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """One string per page: a record without its end."""
    html, digest = F.coalesce(F.col("html"), F.lit("")), F.col("digest")
    rows = pages.join(groups, "digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("refers_to"), F.lit(False))
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x], F.lit("\r\n"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", F.octet_length(html)), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(html))
    head = F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: ", uri(F.col("page_id"))),
        line(f"WARC-Date: {DATE}"),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI: ", _target("url"))),
        line("WARC-Payload-Digest: sha256:", digest),
        F.when(revisit, F.concat(line("WARC-Refers-To: ", uri(F.col("refers_to"))), line(f"WARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes the pages' records to WARC files in ``folder``. Payloads don't move: the groups of equal ones are broadcast if they are few enough."""
    rows = pages.select(col(id_col).cast("bigint").alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    sizes = durable(rows.select("page_id", "digest", F.octet_length(F.coalesce("html", F.lit(""))).alias("n")))
    groups = sizes.where(F.col("n") >= LEAST_REVISITED).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    groups = durable(groups)
    side = F.broadcast(groups) if small_enough(groups, BROADCAST_GROUPS) else groups
    packed = _records(rows, side).mapInArrow(_packed(ARCHIVE_BYTES), "value string")
    packed.write.option("lineSep", END).option("maxRecordsPerFile", 1).mode("overwrite").text(folder)


def _packed(most: int):
    """Runs of records with the record end between them, of ``most`` bytes but for a single longer record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def value() -> pa.RecordBatch:
            joined = pa.array([END.encode().join(held)], pa.binary()).cast(pa.string())
            held.clear()
            return pa.RecordBatch.from_arrays([joined], names=["value"])

        for batch in batches:
            for record in batch.column(0).cast(pa.binary()):
                data = record.as_py()
                if held and size + len(data) > most:
                    yield value()
                    size = 0
                held.append(data)
                size += len(data) + len(END)
        if held:
            yield value()

    return run


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_record(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end (after the record's two line ends) of the record at ``at``."""
    data = data if isinstance(data, bytes) else bytes(data)
    stop = data.index(b"\r\n\r\n", at) + 4
    headers = {m[1].decode().lower(): m[2].decode() for m in _HEADER.finditer(data, data.index(b"\r\n", at) + 2, stop)}
    end = stop + int(headers["content-length"])
    if data[at : at + 5] != b"WARC/" or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"no WARC record at {at}")
    return headers, data[stop:end], end + 4


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    stop = block.index(b"\r\n\r\n") + 4
    return {m[1].decode().lower(): m[2].decode() for m in _HEADER.finditer(block, 0, stop)}, block[stop:]


def url_key(url: str | None) -> str:
    """Host labels in reverse, comma-separated, then ')' and the rest: captures of a host and of its subdomains sort together."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "")
    if not m:
        return ")" + (url or "")
    return ",".join(reversed(m[1].lower().split("."))) + (m[2] or "") + ")" + (m[3] or "/")


def _page_id(uri: str | None) -> int | None:
    digits = (uri or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            data, at, rows = content.as_py(), 0, []
            while at < len(data):
                headers, block, end = parse_record(data, at)
                http, payload = split_http(block)
                stored = headers["warc-type"] == "response"
                digest = sha256(payload).hexdigest() if stored else headers["warc-payload-digest"].removeprefix("sha256:")
                if "sha256:" + digest != headers["warc-payload-digest"]:
                    raise ValueError(f"payload at {at} of {path} doesn't have the digest that its record names")
                url = headers.get("warc-target-uri")
                n = len(payload) if stored else int(http["content-length"])
                refers = None if stored else _page_id(headers["warc-refers-to"])
                rows.append((url_key(url), _page_id(headers["warc-record-id"]), url, headers["warc-type"], refers, n, digest, path.as_py(), at, end - at))
                at = end
            for i in range(0, len(rows), 20_000):
                yield _as_batch(rows[i : i + 20_000])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """An index entry per record, read from the archives: digests are those of the stored payloads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.where("length > 0").select("path", "content").mapInArrow(_entries, ENTRY)


def _blocks(size: int):
    """Compressed blocks of ``size`` sorted entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        keys: list[str] = []

        def block(n: int) -> pa.RecordBatch:
            lines, names = held[:n], keys[:n]
            del held[:n], keys[:n]
            values = [[names[0]], [names[-1]], [n], [zlib.compress("\n".join(lines).encode())]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.string(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["first_key", "last_key", "n", "lines"])

        for batch in batches:
            for row in batch.to_pylist():
                keys.append(row["url_key"])
                held.append(json.dumps([row[f] for f in FIELDS]))
            while len(held) >= size:
                yield block(size)
        if held:
            yield block(len(held))

    return run


def _rows(lines: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(lines).decode().split("\n")]


def _captures(rows: list[list], key: str, url: str | None) -> list[list]:
    """Those of a block's sorted rows that have the key, by bisection, and the url."""
    at, to = bisect_left(rows, key, key=lambda x: x[0]), bisect_right(rows, key, key=lambda x: x[0])
    return [x for x in rows[at:to] if x[2] == url]


def _as_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], names=FIELDS)


def _groups_of(firsts: list[str], key: str) -> range:
    """Places in the directory of what can hold the key."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def _located(firsts: list[str], groups: list[int]):
    """Of each url its key and the groups of blocks that can hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(groups[i], key, url) for url in batch.column("asked").to_pylist() for key in [url_key(url)] for i in _groups_of(firsts, key)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=["part", "url_key", "asked"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that a group's blocks come before the urls that are looked up there: the captures of these."""
    now, blocks = None, []
    for batch in batches:
        out: list[list] = []
        parts, lines, keys, asked = (batch.column(c) for c in ("part", "lines", "url_key", "asked"))
        for i, part in enumerate(parts.to_pylist()):
            if part != now:
                now, blocks = part, []
            if lines[i].is_valid:
                blocks.append(_rows(lines[i].as_py()))
            else:
                out += [x for rows in blocks for x in _captures(rows, keys[i].as_py(), asked[i].as_py())]
        yield _as_batch(out)


def _ranged(path: str):
    """The file system's and the file's name for pyarrow, if that knows the scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))


READ = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def _told(record: bytes) -> tuple:
    """What a record says, with the digest taken from its payload where it has that."""
    headers, block, _ = parse_record(record, 0)
    http, payload = split_http(block)
    stored, said = headers["warc-type"] == "response", headers["warc-payload-digest"].removeprefix("sha256:")
    digest = sha256(payload).hexdigest() if stored else said
    if digest != said:
        raise ValueError(f"the payload of {headers['warc-record-id']} doesn't have the digest that its record names")
    return _page_id(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], None if stored else _page_id(headers["warc-refers-to"]), len(payload) if stored else int(http["content-length"]), digest


def _told_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in READ.split(", ")])


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, file = None, None
    for batch in batches:
        rows = []
        for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
            if archive != now:
                system, name = _ranged(archive)
                now, file = archive, system.open_input_file(name)
            rows.append(_told(file.read_at(length, offset)))
        yield _told_batch(rows)


def _cut_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same from rows sorted so that an archive's content comes before its ranges."""
    data = b""
    for batch in batches:
        rows = []
        for content, offset, length in zip(batch.column("content"), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True):
            if content.is_valid:
                data = content.as_py()
            else:
                rows.append(_told(data[offset : offset + length]))
        yield _told_batch(rows)


class CaptureIndex:
    """Two levels over archives: compressed blocks of sorted entries, and their first keys."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._directory: tuple[list[str], list[int], int] | None = None

    @classmethod
    def build(cls, entries: DataFrame, folder: str) -> CaptureIndex:
        """Range-sorts the entries by key, so a block's keys are next to each other, and writes blocks and directory."""
        dealt = entries.repartitionByRange("url_key", "archive", "offset").sortWithinPartitions("url_key", "archive", "offset")
        blocks = dealt.mapInArrow(_blocks(BLOCK_LINES), "first_key string, last_key string, n int, lines binary")
        blocks.withColumn("block", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/blocks")
        spark = entries.sparkSession
        spark.read.parquet(f"{folder}/blocks").select("first_key", "block").write.mode("overwrite").parquet(f"{folder}/directory")
        return cls(spark, folder)

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/blocks")

    def directory(self) -> tuple[list[str], list[int], int]:
        """First keys, the groups of blocks that they begin, and blocks a group: as few as leave ``DIRECTORY_ENTRIES`` groups of a partition's neighbours."""
        if self._directory is None:
            table = self.spark.read.parquet(f"{self.folder}/directory")
            # rows of a partition are numbered on; each partition begins a group
            parts = F.expr("shiftright(block, 33)")
            n, several = table.agg(F.count("*"), F.count_distinct(parts)).first()
            step = 1 if n <= DIRECTORY_ENTRIES else -(-n // max(1, DIRECTORY_ENTRIES - several))
            some = table.select("first_key", _group(step).alias("part")).groupBy("part").agg(F.min("first_key").alias("first_key"))
            held = sorted((r.part, r.first_key) for r in some.collect())  # bounded by DIRECTORY_ENTRIES
            self._directory = [k for _, k in held], [p for p, _ in held], step
        return self._directory

    def lookup(self, url: str | None) -> list[dict]:
        """The entries of a url's captures."""
        firsts, groups, step = self.directory()
        key = url_key(url)
        wanted = [groups[i] for i in _groups_of(firsts, key)]
        out = []
        if wanted:
            for r in self.blocks().where(_group(step).isin(wanted) & (F.col("first_key") <= key) & (F.col("last_key") >= key)).select("lines").toLocalIterator():
                out += [dict(zip(FIELDS, x, strict=True)) for x in _captures(_rows(r.lines), key, url)]
        return sorted(out, key=lambda x: (x["archive"], x["offset"]))

    def lookup_all(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """The entries of all captures of the urls, each once."""
        firsts, groups, step = self.directory()
        asked = urls.select(_target(col(url_col).cast("string")).alias("asked")).distinct().mapInArrow(_located(firsts, groups), "part bigint, url_key string, asked string")
        held = self.blocks().select(_group(step).alias("part"), "lines", F.lit(None).cast("string").alias("url_key"), F.lit(None).cast("string").alias("asked"))
        both = held.unionByName(asked.withColumn("lines", F.lit(None).cast("binary")))
        return both.repartition("part").sortWithinPartitions("part", F.col("lines").isNull(), "url_key", "asked").mapInArrow(_met, ENTRY)

    def read_all(self, entries: DataFrame) -> DataFrame:
        """What the entries' records say (``READ``), by range reads in the order of the archives; by whole archives where only Spark reads their file system."""
        ranges = entries.select("archive", "offset", "length")
        try:
            _ranged(self.folder)
        except (ValueError, NotImplementedError, ImportError, OSError):
            files = self.spark.read.format("binaryFile").load(f"{self.folder}/../archives/part-*").select(F.col("path").alias("archive"), "content")
            both = files.unionByName(ranges, allowMissingColumns=True)
            return both.repartition("archive").sortWithinPartitions("archive", F.col("content").isNull(), "offset").mapInArrow(_cut_ranges, READ)
        return ranges.repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(_read_ranges, READ)

    def fetch(self, entry: dict) -> tuple[dict[str, str], bytes]:
        """Headers and payload of a capture, by one range read of its archive (a revisit's payload is empty)."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(entry["archive"])
        stream = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(path)
        try:
            stream.seek(entry["offset"])
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(entry["length"])))
        finally:
            stream.close()
        headers, block, _ = parse_record(data, 0)
        return headers, split_http(block)[1]


def _group(step: int) -> Column:
    """Blocks of a partition, ``step`` neighbours a group, by number of partition and group."""
    return F.expr(f"shiftleft(shiftright(block, 33), 33) + (block & {(1 << 33) - 1}) div {step}")


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture, looked up by url in the index over the archives and read from there by range."""
    folder, pages = f"{shared_dir(spark)}/quern-warc-{uuid.uuid4().hex}", read(spark, sf_dir, "pages")
    write_archives(pages, f"{folder}/archives")
    index = CaptureIndex.build(read_archives(spark, f"{folder}/archives"), f"{folder}/index")
    found = durable(index.read_all(index.lookup_all(pages)))
    delete(spark, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as n from pages
), g as (
  select html, min(page_id) as first from p where n >= 100 group by html having count(*) > 1
)
select page_id, n as payload_bytes, sha256(p.html) as payload_digest,
  case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from p left join g on p.html = g.html
"""
