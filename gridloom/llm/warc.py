"""WARC derivatives: metadata and plain-text conversion records of responses, linked to them.

Records are rows; `block` holds the record's body and `record` its whole WARC/1.1 form. Identifiers follow
from the response's own, so a task that runs again writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import pagetext

DATE = "1970-01-01T00:00:00Z"
#: Namespace of the identifiers derived here.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gridloom:warc")

def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {source}')}>"


def described(page: pagetext.Page, http: str | None) -> str:
    """The fields of a metadata record, one a line: what the page says of itself, where it links, and the response's headers."""
    found = [("title", page.title), ("languages-html", page.language), ("charset-detected", page.charset)]
    lines = [f"{name}: {one_line(value)}" for name, value in found if value is not None]
    lines += [f"outlink: {one_line(x)} L a/@href" for x in page.links]
    lines += [f"source-http-header: {one_line(x)}" for x in (http or "").splitlines() if x.strip()]
    return "".join(x + "\r\n" for x in lines)


def one_line(value: str) -> str:
    return " ".join(value.split())


def written(headers: list[tuple[str, str]], block: bytes) -> bytes:
    clean = lambda v: re.sub(r"\s*[\r\n]+\s*", "; ", v.strip())
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of WARC bytes: headers and block."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        start, n = end + 4, int(headers["Content-Length"])
        out.append((headers, data[start : start + n]))
        at = start + n + 4
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as responses: page_id, target_uri, record_id, date, http_headers, payload (bytes of the page)."""
    name = F.sha1(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(url_col), F.lit("-"))))
    dashes = F.regexp_replace(F.substring(name, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    return pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), dashes.alias("record_id"), F.lit(DATE).alias("date"),
        F.lit("Content-Type: text/html; charset=utf-8").alias("http_headers"), F.col(html_col).cast("string").cast("binary").alias("payload"),
    )


_OUT = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_digest string, source_headers string, block binary, record binary"


def derive(source: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response (page_id, target_uri, record_id, date, http_headers, payload).

    refers_to is the response's record_id; its target, date, HTTP headers and payload digest come along as
    WARC-Target-URI, WARC-Date, WARC-Source-HTTP-Headers (on one line, split by semicolons; the metadata record's block has
    a line for each) and WARC-Source-Payload-Digest. The last two are extensions, which the format allows; it keeps
    WARC-Refers-To-Target-URI and -Date for revisit records. The date is the response's own, so that a task that
    runs again writes the same bytes. A null payload is an
    empty page: both records exist, the conversion's block empty. A null target has no such header. Bytes that aren't
    UTF-8 are replaced in the text. Repeated responses give repeated records. More columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page_id, target, rid, date, http, payload in zip(*(batch.column(i) for i in range(6)), strict=True):
                raw = payload.as_py() or b""
                page = pagetext.scan(raw.decode("utf-8", "replace"))
                target, rid, date, http = (x.as_py() for x in (target, rid, date, http))
                came = digest(raw)
                for kind, content, block in (("metadata", "application/warc-fields", described(page, http)), ("conversion", "text/plain; charset=utf-8", page.text())):
                    body = block.encode("utf-8", "replace")
                    own, digested = record_id(kind, rid or ""), digest(body)
                    headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", rid), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", digested), ("WARC-Source-Payload-Digest", came), ("WARC-Source-HTTP-Headers", http), ("Content-Type", content), ("Content-Length", str(len(body)))]
                    rows.append((page_id.as_py(), kind, own, rid, target, date, content, len(body), digested, came, http, body, written([(k, v) for k, v in headers if v is not None], body)))
                if len(rows) >= 512:
                    yield made(rows, batch)
                    rows = []
            if rows:
                yield made(rows, batch)

    names = ["page_id", *(x.split()[0] for x in _OUT.split(", "))]
    types = [pa.int64() if x.endswith(" long") else pa.binary() if x.endswith(" binary") else pa.string() for x in _OUT.split(", ")]

    def made(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [batch.schema.field(0).type, *types], strict=True)], names)

    kind = dict(source.dtypes)["page_id"]
    return source.select("page_id", "target_uri", "record_id", "date", "http_headers", "payload").mapInArrow(run, f"page_id {kind}, {_OUT}")


def write(records: DataFrame, path: str) -> None:
    """Write the records of each partition as one .warc file under path, a store that pyarrow can open from any executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():05d}.warc"
        n = 0
        with store.open_output_stream(f"{name}.{context.taskAttemptId()}") as out:
            for batch in batches:
                for x in batch.column(0):
                    out.write(x.as_py())
                    n += 1
        store.move(f"{name}.{context.taskAttemptId()}", name)  # whole files only, whichever attempt wrote them
        yield pa.RecordBatch.from_pydict({"n": [n]})

    records.select("record").mapInArrow(run, "n long").collect()
