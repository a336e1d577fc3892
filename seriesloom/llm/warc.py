"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Records are found from any byte range of a file, so that a large archive is read by many tasks. A
version line inside a payload looks like a record, too. So a task only proposes candidates: each
place that parses as a record header, with the offset of its successor. A candidate is a record if and
only if the chain of successors from the start of the file reaches it. Each block first contracts its own
candidates (where does a chain that enters here leave the block?); then pointer jumping over the
blocks of a file, doubling the distance in each round, marks the entries that the file's start
reaches. Records are then read from each block's reached entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import open_store, text_chunks
from seriesloom.operators.enrich import MAX_BROADCAST_BYTES
from seriesloom.storage import new_path, written_table

# Version line and profile of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Payloads shorter than this are always stored.
MIN_REVISIT_BYTES = 1000
BLOCK_BYTES = 16 * 1024 * 1024
# Bytes of a digest of 40 digits with its page_id.
DIGEST_BYTES = 48
# Bytes read beyond a block, and bytes of a record read first; longer headers are read on to their end.
READ_AHEAD, FIRST_READ = 1 << 20, 8192

_MANIFEST = "path string, n_bytes long, n_records long"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id_of(uri: str | None) -> int | None:
    digits = uri.removeprefix("<urn:page:").removesuffix(">") if uri else ""
    return int(digits) if digits else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                 revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit that names the response."""
    target = "".join((url or "").split())
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}",
            "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


# What ``parse_header`` returns if the data ends before the header does.
UNFINISHED: tuple[dict[str, str], int] = ({}, -1)


def parse_header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """(fields, start of the block) of a record header at ``at``; None if it is none.

    Lines are taken one by one, so a place that is no header costs no more than its first wrong line.
    """
    if not data.startswith(VERSION, at):
        return None
    fields, at = {}, at + len(VERSION)
    while (end := data.find(b"\r\n", at)) != at:
        if end < 0:
            return UNFINISHED
        name, colon, value = data[at:end].partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        at = end + 2
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    return fields, at + 2


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files; returns ``path, n_bytes, n_records``.

    Of equal payloads of at least ``MIN_REVISIT_BYTES`` bytes the one with the largest page_id is
    stored (all rows with that id, should it repeat), the others become revisits. A null html is
    an empty payload, a null page_id sorts below all others. Other columns are ignored; an empty
    table gives an empty manifest. The number of copies and the largest id per payload are
    combined before their shuffle. The digests that repeat are measured: if small they are broadcast, and payloads
    stay in their tasks; else a frequent payload's rows are spread by a salt in the join.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark)
    store, inner = open_store(folder)
    store.create_dir(inner, recursive=True)
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = written_table(
        rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy(F.col("digest").alias("same"))
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("same", "keeper"))
    if groups.count() * DIGEST_BYTES <= MAX_BROADCAST_BYTES:
        joined = rows.join(F.broadcast(groups), F.col("digest") == F.col("same"), "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(16)))
        groups = groups.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(15))))
        joined = rows.join(groups, (F.col("digest") == F.col("same")) & (F.col("salt") == F.col("s")), "left")
    revisit = F.col("same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    joined = joined.select("page_id", "url", "digest", "keeper", revisit.alias("revisit"), "payload")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sink, n_bytes, n_records = TaskContext.get(), None, 0, 0
        path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.warc"
        for batch, payloads in text_chunks(batches, "payload"):
            if sink is None:
                files, inner = open_store(path)
                sink = files.open_output_stream(inner)
            for row, payload in zip(batch.drop_columns(["payload"]).to_pylist(), payloads):
                record = record_bytes(row["page_id"], row["url"], payload, row["digest"], row["keeper"], row["revisit"])
                sink.write(record)
                n_bytes, n_records = n_bytes + len(record), n_records + 1
        if sink is not None:
            sink.close()
            yield pa.record_batch([pa.array([v]) for v in (path, n_bytes, n_records)],
                                  names=["path", "n_bytes", "n_records"])

    return written_table(joined.mapInArrow(write, _MANIFEST))


def archive_blocks(archives: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, n_bytes, start`` for every block of every file."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(block_bytes).cast("long"))
    return archives.where("n_bytes > 0").select("path", "n_bytes", F.explode(starts).alias("start"))


def candidate_records(archives: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, block, at, successor, leaves`` for every place that parses as a record.

    ``successor`` is where the record ends; ``leaves`` is where the chain from here first leaves the block.
    A record must be followed by the end of the file or end with two line breaks.
    """
    schema = "path string, block long, at long, successor long, leaves long"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                path, start, size = block["path"], block["start"], block["n_bytes"]
                files, inner = open_store(path)
                with files.open_input_file(inner) as source:
                    data = source.read_at(min(block_bytes + READ_AHEAD, size - start), start)
                    found, at, last = [], data.find(VERSION), block_bytes + len(VERSION) - 1
                    while 0 <= at < block_bytes:
                        while (parsed := parse_header(data, at)) is UNFINISHED and start + len(data) < size:
                            here = start + len(data)
                            data += source.read_at(min(max(READ_AHEAD, len(data) - at), size - here), here)
                        if parsed and parsed is not UNFINISHED:
                            successor = start + parsed[1] + int(parsed[0]["content-length"]) + 4
                            if successor <= size:
                                found.append((start + at, successor))
                        at = data.find(VERSION, at + 1, last)
                leaves: dict[int, int] = {}
                for at, successor in reversed(found):
                    leaves[at] = leaves.get(successor, successor)
                for i in range(0, len(found), 50_000):
                    part = found[i:i + 50_000]
                    yield pa.record_batch(
                        [pa.array([path] * len(part)), pa.array([start] * len(part)), pa.array([a for a, _ in part]),
                         pa.array([s for _, s in part]), pa.array([leaves[a] for a, _ in part])],
                        names=["path", "block", "at", "successor", "leaves"])

    blocks = archive_blocks(archives, block_bytes)
    return blocks.repartition(*_spread(blocks), "path", "start").mapInArrow(scan, schema)


def _spread(blocks: DataFrame) -> tuple[int]:
    """As many partitions as there are blocks, up to a bound on the number of tasks."""
    return (max(1, min(blocks.count(), 100_000)),)


def reached_entries(candidates: DataFrame, archives: DataFrame) -> DataFrame:
    """``path, at`` of the candidates where the chain from the file's start enters a block.

    ``jump`` leads 1, 2, 4, ... blocks ahead from round to round; what is reached by then jumps
    along. The number of rounds is the logarithm of the largest number of blocks of a file. A chain that
    does not reach the end of its file raises an error, so that no record is left out unnoticed.
    """
    entries = candidates.select("path", "at", F.col("leaves").alias("to"))
    rounds = (candidates.groupBy("path").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] or 1)
    reached = archives.where("n_bytes > 0").select("path", F.lit(0).cast("long").alias("at"))
    jump, ahead = entries, 1
    while True:
        step = reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = written_table(reached.unionByName(step).distinct())
        if ahead >= rounds:
            ends = archives.where("n_bytes > 0").select("path", F.col("n_bytes").alias("at"))
            broken = ends.join(reached, ["path", "at"], "left_anti").first()
            if broken:
                raise ValueError(f"the records of {broken['path']} do not lead to its end at {broken['at']}")
            return reached.join(entries, ["path", "at"], "left_semi")
        onward = jump.select("path", F.col("at").alias("to"), F.col("to").alias("further"))
        jump = written_table(jump.join(onward, ["path", "to"]).select("path", "at", F.col("further").alias("to")))
        ahead *= 2


def read_archives(archives: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every verified record.

    Length and digest of a response are taken from its payload as read.
    """
    candidates = written_table(candidate_records(archives, block_bytes))
    entries = reached_entries(candidates, archives)
    blocks = candidates.select("path", "at", "block").join(entries, ["path", "at"]).select("path", "block", "at")
    blocks = written_table(blocks)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for block in batch.to_pylist():
                files, inner = open_store(block["path"])
                with files.open_input_file(inner) as source:
                    size, at, end, rows = source.size(), block["at"], block["block"] + block_bytes, []
                    while at < min(end, size):
                        n = FIRST_READ
                        while (parsed := parse_header(source.read_at(min(n, size - at), at), 0)) is UNFINISHED and n < size - at:
                            n *= 4
                        fields, body = parsed
                        length = int(fields["content-length"])
                        row = [_id_of(fields["warc-record-id"]), int(fields["x-payload-length"]),
                               fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"],
                               _id_of(fields.get("warc-refers-to"))]
                        if row[3] == "response":
                            payload = source.read_at(length, at + body)
                            row[1:3] = len(payload), hashlib.sha1(payload).hexdigest()
                        rows.append(row)
                        at += body + length + 4
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return blocks.repartition(*_spread(blocks), "path", "block").mapInArrow(read, _RECORDS)
