"""WARC archives of pages, and an index of all captures by external merge.

Writing: one gzip member per record, files closed at a size limit. Pages with equal payloads are stored once, the
others become revisit records that name the stored one. Reading: every archive gives a run of index entries sorted by
URL key and time. Spark deals the entries into ranges of whole keys, of bounded size, and the runs of a range are merged
by a k-way loser tree, so that ranges in turn give the globally ordered history of every URL.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_dir, put_file, read_files

EPOCH = datetime.datetime(2000, 1, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Parts that the copies of a payload are dealt out in.
PARTS = 64
ENTRY = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file long, offset long, length long"


def url_key(url: str | None) -> str:
    """A URL with its host reversed and lower-cased, so that a site's pages sort together: com,example)/path?query."""
    parts = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    if not parts:
        return url or ""
    host = parts[1].rpartition("@")[2].lower()
    return ",".join(reversed(host.split(":")[0].split("."))) + ")" + (parts[2] or "/")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit has the HTTP head only, whose Content-Length tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    when = EPOCH + datetime.timedelta(seconds=(page_id or 0) % 1_000_000_000)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def records(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, head, block) of every record of an archive."""
    at, step, view = 0, 1 << 16, memoryview(raw)
    while at < len(raw):
        inflate, parts, to = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if to >= len(raw):
                raise ValueError("archive is cut short")
            parts.append(inflate.decompress(view[to : to + step]))
            to = min(to + step, len(raw))
        end = to - len(inflate.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield at, end - at, fields, rest[: int(fields["Content-Length"])]
        at = end


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_shared: int = 1000, file_bytes: int = 16 << 20) -> DataFrame:
    """Writes a record per row of pages to archives in folder; returns (file, n), a row per archive."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # copies are found by (digest, page) alone, dealt out in parts; payloads move once, by page
    copies = rows.where((F.octet_length("payload") >= least_shared) & F.col("page_id").isNotNull()).select("digest", "page_id").distinct().withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(PARTS)))
    parts = copies.groupBy("digest", "part").agg(F.max("page_id").alias("largest"))
    stored = parts.join(parts.groupBy("digest").agg(F.max("largest").alias("stored")), "digest").select("digest", "part", "stored")
    revisits = copies.join(stored, ["digest", "part"]).where("page_id <> stored").select("page_id", "digest", "stored")
    marked = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", F.col("stored").alias("refers_to"))

    def write(batches):
        part, file, out, size, n = TaskContext.get().partitionId(), 0, [], 0, 0

        def close():
            nonlocal file, out, size, n
            number = (part << 24) + file
            put_file(f"{folder}/{number:020d}.warc.gz", b"".join(out))
            made = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n])], names=["file", "n"])
            file, out, size, n = file + 1, [], 0, 0
            return made

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(len(batch)):
                out.append(record(*(c[i].as_py() for c in columns)))
                size, n = size + len(out[-1]), n + 1
                if size >= file_bytes:
                    yield close()
        if out:
            yield close()

    return marked.mapInArrow(write, "file long, n long")


def read_runs(files: DataFrame) -> DataFrame:
    """Index entries of archives (path, content), each archive's sorted by URL key, time and page: a run, with seq its order."""

    def read(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number, run = int(path.rpartition("/")[2].split(".")[0]), []
                for offset, length, head, block in records(raw.as_buffer().to_pybytes()):
                    http, _, body = block.partition(b"\r\n\r\n")
                    kind, page = head["WARC-Type"], head["WARC-Record-ID"][10:-1]
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = hashlib.sha1(body).hexdigest() if kind == "response" else head["WARC-Payload-Digest"][5:]
                    refers = int(head["WARC-Refers-To"][10:-1]) if kind == "revisit" else None
                    run.append((url_key(head.get("WARC-Target-URI")), head["WARC-Date"], int(page) if page else None, size, digest, kind, refers, number, offset, length))
                run.sort(key=lambda e: (e[0], e[1], -1 if e[2] is None else e[2], e[8]))
                yield pa.RecordBatch.from_pydict(dict(zip([c.split()[0] for c in ENTRY.split(", ")], ([*c] for c in zip(*run, strict=True)), strict=True)) | {"seq": list(range(len(run)))}, schema=pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in (ENTRY + ", seq long").split(", ")]))

    return files.mapInArrow(read, ENTRY + ", seq long")


def merge(runs: list[list]) -> Iterator:
    """Loser-tree merge of sorted lists: every inner node keeps the loser of its match, the winner moves up."""
    k = len(runs)
    if not k:
        return
    heads = [0] * k
    done = object()
    value = [run[0] if run else done for run in runs]
    tree = [-1] * k

    def wins(a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0  # not yet seeded: waits at the node
        if value[a] is done or value[b] is done:
            return value[b] is done and (value[a] is not done or a < b)
        return (value[a], a) < (value[b], b)

    def replay(leaf: int) -> None:
        node, winner = (leaf + k) // 2, leaf
        while node:
            if wins(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner

    for leaf in range(k - 1, -1, -1):
        replay(leaf)
    while value[top := tree[0]] is not done:
        yield value[top]
        heads[top] += 1
        value[top] = runs[top][heads[top]] if heads[top] < len(runs[top]) else done
        replay(top)


def merged_index(runs: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """All runs' entries with (range, rank): ascending range and then rank is the order by URL key, time and page.

    Ranges of about rows_per_range entries are cut at whole keys (URL key, time, page, record), so a URL of many captures
    spans several. Nulls of URL key and page come first.
    """
    ranges = max(1, -(-runs.count() // rows_per_range))
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def join_runs(batches):
        batches = list(batches)
        if not sum(map(len, batches)):
            return
        table = pa.Table.from_batches(batches)
        table = table.sort_by([("file", "ascending"), ("seq", "ascending")])
        keys = list(zip([u or "" for u in table["url_key"].to_pylist()], table["captured"].to_pylist(), [-1 if p is None else p for p in table["page_id"].to_pylist()], range(len(table)), strict=True))
        files = table["file"].to_pylist()
        cut = [i for i in range(len(files)) if not i or files[i] != files[i - 1]] + [len(files)]
        order = [k[3] for k in merge([keys[a:b] for a, b in zip(cut, cut[1:])])]
        out = table.take(pa.array(order, pa.int64())).select(names).combine_chunks()
        out = out.append_column("range", pa.array([TaskContext.get().partitionId()] * len(order), pa.int64())).append_column("rank", pa.array(range(len(order)), pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    key = [F.coalesce("url_key", F.lit("")), F.col("captured"), F.coalesce("page_id", F.lit(-1)), F.col("file"), F.col("seq")]
    return runs.select(*names, "seq").repartitionByRange(ranges, *key).mapInArrow(join_runs, ENTRY + ", range long, rank long")


def capture_index(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes pages (page_id, url, html) to archives, reads those back and returns their merged index.

    Rows: url_key, captured, page_id, payload_bytes, payload_digest (SHA-1 of the full payload), record_type,
    refers_to, the record's file, offset and length, and its place (range, rank). A null html is an empty payload.
    Among payloads of at least 1000 bytes that are equal, the largest page_id is the response; rows that repeat that id
    are responses too, and so are rows without an id. A page has no capture time of its own; its id in seconds after
    the year 2000 stands for it. Null URLs sort first. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    written = materialize(write_archives(pages, folder, **options), "warc-files")
    if written.isEmpty():
        return spark.createDataFrame([], ENTRY + ", range long, rank long")
    return merged_index(materialize(read_runs(read_files(spark, folder)), "warc-runs"))
