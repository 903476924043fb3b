"""WARC archives with a merged capture index.

1. Every task writes its pages into archive files (one gzip member per record) and returns, per file, its
   captures as a run sorted by URL key, timestamp and place.
2. The runs are dealt out by ranges of that order; every range receives an ascending piece of each run.
   A loser tree merges the pieces, which gives capture histories in global order. A URL that fills
   a third of the table spans several ranges, since the timestamp and the place are part of the order.
3. Archives are read back record by record at the places in the index.

Equal payloads of at least REVISIT_BYTES are stored once; the other captures are revisit records.
A file is known to the index only when its task succeeded, so repeated attempts leave nothing behind
but files that nobody reads.
"""

import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from skilltide.storage import new_path, settle

from .files import opened
from .losertree import merge, natural_runs
from .ship import ship

REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
CAPTURES_PER_RANGE = 200_000
FIRST_CAPTURE = datetime.datetime(2024, 1, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ORDER = ["urlkey", "timestamp", "file", "offset"]
RUN = "urlkey string, timestamp string, page_id string, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Host labels in reverse, then path and query; lower case. Empty for null."""
    plain = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(plain, "(?s)^[^:/?#]*://|#.*$", "")
    host = F.regexp_extract(rest, "(?s)^([^/?]*)", 1)
    labels = F.array_join(F.reverse(F.split(host, "\\.")), ",")
    return F.when(rest == "", F.lit("")).otherwise(F.concat(
        labels, F.lit(")"), F.regexp_extract(rest, "(?s)^[^/?]*(.*)$", 1)))


def capture_time(page_id: int | None) -> str:
    """Pages have no time of their own: one second per page id after FIRST_CAPTURE."""
    seconds = (page_id or 0) % (10 ** 9)
    return (FIRST_CAPTURE + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    found = name.rpartition(":")[2].rstrip(">")
    return None if found == "none" else int(found)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, as a gzip member."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {capture_time(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """The fields of a record; the digest of a stored payload is computed anew and compared."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest,
            "record_type": fields["WARC-Type"],
            "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None}


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _shown(number: int | None) -> str | None:
    return None if number is None else str(number)


def write_archives(pages: DataFrame, address: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write the archives below ``address``; the result lists the captures of each file as a sorted
    run. Evaluating it writes, so it has to be settled once."""
    if not isinstance(pages.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    payload = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
                        url_key(F.col(url_col)).alias("urlkey"))
    firsts = base.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(
        F.count("*").alias("n"), F.min("page_id").alias("first_id")).where(
        "n > 1 and first_id is not null").select("digest", "first_id")
    linked = base.join(firsts, "digest", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = opened(address)
        system.create_dir(folder, recursive=True)
        out, run, name, size = None, [], "", 0

        def finished() -> pd.DataFrame:
            out.close()
            run.sort(key=lambda c: (c[0], c[1], c[3], c[4]))
            return pd.DataFrame(run, columns=["urlkey", "timestamp", "page_id", "file", "offset", "length"])

        for pdf in batches:
            for page_id, url, text, digest, key, first in zip(
                    pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["urlkey"], pdf["first_id"]):
                if out is None:
                    name, size, run = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                page, first = _whole(page_id), _whole(first)
                revisit = first is not None and page != first
                member = record(page, url, text.encode(), digest, first, revisit)
                out.write(member)
                run.append((key, capture_time(page), page_id, name, size, len(member)))
                size += len(member)
                if size >= FILE_BYTES:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    # ids pass pandas as texts, which would make rounded floats of longs with a null among them
    return linked.select(F.col("page_id").cast("string"), "url", "payload", "digest", "urlkey",
                         F.col("first_id").cast("string")).mapInPandas(write, RUN)


def merged_index(runs: DataFrame) -> DataFrame:
    """The captures of all runs in one order (URL key, timestamp, place), range by range."""
    ranges = -(-runs.count() // CAPTURES_PER_RANGE) or 1

    def merge_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: list[str] = []

        def captures() -> Iterator[tuple]:
            for pdf in batches:
                names[:] = list(pdf.columns)
                yield from pdf.itertuples(index=False, name=None)

        def key(c: tuple) -> tuple:
            return c[0], c[1], c[3], c[4]

        out = []
        for capture in merge(natural_runs(captures(), key), key):
            out.append(capture)
            if len(out) == 50_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return runs.repartitionByRange(ranges, *ORDER).mapInPandas(merge_range, RUN).withColumn(
        "page_id", F.col("page_id").cast("long"))


def read_archives(index: DataFrame, address: str) -> DataFrame:
    """One row per capture of the index, from its record in the archives."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = opened(address)
        name, source = None, None
        for pdf in batches:
            out = []
            for file, offset, length in zip(pdf["file"], pdf["offset"], pdf["length"]):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, system.open_input_file(f"{folder}/{file}")
                out.append(parse(source.read_at(int(length), int(offset))))
            shown = [r | {c: _shown(r[c]) for c in ("page_id", "refers_to")} for r in out]
            yield pd.DataFrame(shown, columns=["page_id", "payload_bytes", "payload_digest", "record_type",
                                               "refers_to"])
        if source is not None:
            source.close()

    placed = index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    found = placed.mapInPandas(read, "page_id string, payload_bytes long, payload_digest string, "
                               "record_type string, refers_to string")
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def capture_index(pages: DataFrame, address: str, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """Archive the pages below ``address`` and return the merged index of their captures."""
    runs = settle(write_archives(pages, address, id_col, url_col, html_col), "capture-runs")
    return settle(merged_index(runs), "capture-index")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """Write all pages, merge their index and read everything back through it.

    One row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``. The payload is
    the html in UTF-8, empty for null. Of records with equal payloads of REVISIT_BYTES or more, that of
    the smallest page id is the response and the others revisit it; rows that repeat that id and payload
    are all responses. A null id is never the smallest; where all ids of a group are null, all are
    responses. Null URLs have an empty key. An empty table gives an empty result, and other columns
    are ignored.
    """
    ship(pages.sparkSession)
    address = new_path(pages.sparkSession, "warc")
    return read_archives(capture_index(pages, address, id_col, url_col, html_col), address)
