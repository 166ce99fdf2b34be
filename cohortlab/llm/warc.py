"""WARC archives with a two-level capture index.

Pages are sorted by a reversed-host URL key and page_id and written as ``.warc.gz`` files, one gzip member a record.
Beside each archive stand its index, capture lines in that order packed into zstd blocks of ``BLOCK_LINES`` lines, and
its sparse directory: one ``first key, first page_id, block offset, block length`` per block. A look-up finds the archive
by halves among the first captures of all archives, searches that archive's directory by halves, range-reads one block
(more only if a key fills several), searches its lines by halves and range-reads the records. The query looks up every
page, in key order, so that neighbours share a block.

Payloads of at least ``least`` bytes are stored once: of the records with equal payloads that with the smallest page_id
is a response, the others are revisits that refer to it. Which digests recur is found by a grouped minimum over digests
before any payload moves, so a payload that a third of all pages share costs no task more than its lines.

Defined cases: a null html is an empty payload; a null url has the key ``""`` and comes first; rows that repeat the
smallest page_id of their payload are all responses; a null page_id counts as the largest and is kept null; an empty
table writes nothing and gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import frame, fresh_path, save
from ._files import Reader, write_file

BLOCK_LINES = 512
LEAST = 100
_DATE = "2000-01-01T00:00:00Z"


def url_key(url: str | Column) -> Column:
    """``com,example,www)/path?query``: lower-case host reversed, without scheme, user, port and fragment."""
    c = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(c, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"^.*@", ""), r":\d+$", "")
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    return F.when(c == "", "").otherwise(F.concat(F.concat_ws(",", F.reverse(F.split(F.lower(host), r"\."))), F.lit(")"), path))


def decisions(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, digest, n, refers_to`` for revisits only; ``pages`` has ``page_id, digest, n`` and no payload."""
    big = pages.where(F.col("n") >= least)
    firsts = save(big.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "warc-firsts")
    again = big.join(firsts, "digest").where(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    return save(again.select("page_id", "digest", F.col("first_id").alias("refers_to")).distinct(), "warc-revisits")


def _record(kind: str, page_id: int | None, url: str, digest: str, payload: bytes, size: int, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {json.dumps(url)[1:-1]}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + http + payload + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """One record from its gzip member. ``headers, http, payload``; lengths are tested, gzip tests its checksum."""
    data = zlib.decompress(member, 31)
    head, _, body = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    if len(body) != int(headers["Content-Length"]) + 4 or not body.endswith(b"\r\n\r\n"):
        raise ValueError("the record's length differs")
    http, _, payload = body[:-4].partition(b"\r\n\r\n")
    return {"headers": headers, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def _page(urn: str) -> int | None:
    inner = urn[len("<urn:page:") : -1]
    return int(inner) if inner else None


_PAGES = "page_id long, url string, key string, payload binary, digest string, n long, refers_to long"
DIRECTORY = "archive_no int, archive string, index string, block int, first_key string, first_page long, offset long, length long, lines int, directory string"


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, archives: int | None = None) -> DataFrame:
    """Write archives and their indexes below ``root``; returns the sparse directory."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    named = named.withColumns({"digest": F.sha2("payload", 256), "n": F.length("payload").cast("long"), "key": url_key("url")})
    revisits = decisions(named.select("page_id", "digest", "n"), least)
    other = revisits.select(F.col("page_id").alias("__p"), F.col("digest").alias("__d"), "refers_to")
    told = named.join(other, named["page_id"].eqNullSafe(other["__p"]) & (named["digest"] == other["__d"]), "left").withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    n = archives or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("key"), F.col("page_id").asc_nulls_last()]
    ranged = told.select("page_id", "url", "key", "payload", "digest", "n", "refers_to").repartitionByRange(n, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name, part = uuid.uuid4().hex, TaskContext.get().partitionId()
        blocks, lines, index, at = [], [], [], 0

        def close_block() -> None:
            data = zstandard.compress("\n".join(lines).encode(), 3)
            offset = blocks[-1][6] + blocks[-1][7] if blocks else 0
            blocks.append((part, f"{name}.warc.gz", f"{name}.cdx.zst", len(blocks), *json.loads(lines[0])[:2], offset, len(data), len(lines), f"{name}.dir.zst"))
            index.append(data)
            lines.clear()

        def members() -> Iterator[bytes]:
            nonlocal at
            for b in batches:
                for page_id, url, key, payload, digest, size, refers in b.itertuples(index=False):
                    page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                    kind = "response" if refers is None else "revisit"
                    member = _record(kind, page_id, url or "", digest, payload or b"", size, refers)
                    lines.append(json.dumps([key, page_id, kind, digest, at, len(member)], ensure_ascii=False))
                    at += len(member)
                    yield member
                    if len(lines) == BLOCK_LINES:
                        close_block()
            if lines:
                close_block()

        first = next(it := members(), None)
        if first is not None:
            write_file(root, f"{name}.warc.gz", _chain(first, it))
            write_file(root, f"{name}.cdx.zst", index)
            sparse = zstandard.compress("\n".join(json.dumps(x[4:8], ensure_ascii=False) for x in blocks).encode(), 3)
            write_file(root, f"{name}.dir.zst", [len(sparse).to_bytes(8, "little"), sparse])
            yield frame(blocks, [c.split()[0] for c in DIRECTORY.split(", ")])

    return save(ranged.mapInPandas(write, DIRECTORY), "warc-directory")


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def read_block(reader: Reader, index: str, offset: int, length: int) -> list[list]:
    """The capture lines of one block: ``key, page_id, type, digest, offset, length``."""
    return [json.loads(line) for line in zstandard.decompress(reader.read(index, offset, length)).decode().split("\n")]


def _place(line: list) -> tuple:
    """Where a capture or directory line stands: by key, then page_id, null last."""
    return line[0], line[1] is None, line[1] or 0


class _Archives:
    """Look-ups over all archives; ``tops`` has the first place, the archive, index and directory of each, ascending. The
    last directory and block are kept, for look-ups that come in order."""

    def __init__(self, root: str, tops: list[tuple]):
        self.tops, self.firsts = tops, [x[0] for x in tops]
        self.sparse, self.index, self.archive = Reader(root), Reader(root), Reader(root)
        self.directory, self.block = (None, []), (None, [])

    def _directory(self, name: str) -> list[list]:
        if self.directory[0] != name:
            size = int.from_bytes(self.sparse.read(name, 0, 8), "little")
            data = zstandard.decompress(self.sparse.read(name, 8, size)).decode()
            self.directory = name, [json.loads(line) for line in data.split("\n")]
        return self.directory[1]

    def _block(self, index: str, offset: int, length: int) -> list[list]:
        if self.block[0] != (index, offset):
            self.block = (index, offset), read_block(self.index, index, offset, length)
        return self.block[1]

    def find(self, low: tuple, high: tuple) -> Iterator[tuple[str, list]]:
        """Archive and line of the captures from ``low`` to ``high``."""
        a = max(bisect.bisect_left(self.firsts, low) - 1, 0)
        while a < len(self.tops) and self.firsts[a] <= high:
            _, archive, index, name = self.tops[a]
            rows = self._directory(name)
            k = max(bisect.bisect_left(rows, low, key=_place) - 1, 0)
            while k < len(rows) and _place(rows[k]) <= high:
                lines = self._block(index, *rows[k][2:])
                at = bisect.bisect_left(lines, low, key=_place)
                while at < len(lines) and _place(lines[at]) <= high:
                    yield archive, lines[at]
                    at += 1
                k += 1
            a += 1


def _tops(directory: DataFrame) -> list[tuple]:
    """One row an archive; their number is that of the partitions they were written from, whatever the input."""
    rows = directory.where("block = 0").select("first_key", "first_page", "archive", "index", "directory").collect()
    return sorted((_place(r[:2]), *r[2:]) for r in rows)


def resolve(directory: DataFrame, root: str, pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The captures of the given pages, looked up one by one in key order; every record is tested against its line."""
    spark = directory.sparkSession
    tops = spark.sparkContext.broadcast(_tops(directory))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archives, last = _Archives(root, tops.value), None
        for b in batches:
            out = []
            for key, page in b.itertuples(index=False):
                place = _place([key, None if page is None else int(page)])
                if place == last:  # rows that repeat were found together
                    continue
                last, found = place, 0
                for archive, (_, page_id, kind, digest, offset, length) in archives.find(place, place):
                    out.append((*_tested(archives.archive, archive, page_id, kind, digest, offset, length), key))
                    found += 1
                if not found:
                    raise ValueError(f"page {page}: not in the index")
            yield frame(out, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key"])

    asked = pages.select(url_key(url_col).alias("key"), F.col(id_col).cast("long").alias("page_id"))
    order = [F.col("key"), F.col("page_id").asc_nulls_last()]
    tasks = asked.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    tasks = tasks.select("key", F.col("page_id").cast("string"))  # whole beside nulls
    return tasks.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string")


def _tested(reader: Reader, archive: str, page_id: int | None, kind: str, digest: str, offset: int, length: int) -> tuple:
    """What the record says, which must be what its capture line says."""
    rec = parse_record(reader.read(archive, offset, length))
    head, payload = rec["headers"], rec["payload"]
    size = int(rec["http"]["Content-Length"])
    if head["WARC-Type"] != kind or _page(head["WARC-Record-ID"]) != page_id:
        raise ValueError(f"{archive} at {offset}: another record than the index says")
    found = hashlib.sha256(payload).hexdigest() if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha256:")
    if found != digest or kind == "response" and size != len(payload):
        raise ValueError(f"{archive} at {offset}: the payload differs")
    return page_id, size, found, kind, _page(head["WARC-Refers-To"]) if kind == "revisit" else None


def look_up(directory: DataFrame, root: str, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """The captures of the given URL keys; a null key has none."""
    tops = directory.sparkSession.sparkContext.broadcast(_tops(directory))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archives = _Archives(root, tops.value)
        for b in batches:
            out = []
            for key in (k for k in b["key"] if k is not None):
                for archive, line in archives.find((key, False, float("-inf")), (key, True, float("inf"))):
                    rec = parse_record(archives.archive.read(archive, line[4], line[5]))
                    out.append((key, line[1], line[2], line[3], rec["payload"]))
            yield frame(out, ["key", "page_id", "record_type", "payload_digest", "payload"])

    return keys.select(F.col(key_col).alias("key")).mapInPandas(find, "key string, page_id long, record_type string, payload_digest string, payload binary")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and look every page up in them."""
    root = fresh_path(pages.sparkSession, "warc")
    return resolve(write_archives(pages, root), root, pages)
