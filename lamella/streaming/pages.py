"""A harvest of saved OAI-PMH pages as a stream whose offset is the resumption token.

Each page names the next one by a token, and a page without a token, or an empty one, ends the harvest. The driver reads
pages for their tokens only, some pages a batch; rows name the pages, and tasks open and parse them. Where the next page
isn't saved yet the stream waits; a query that starts again goes on at the token in its checkpoint.

Pages lie in one folder that all machines share, as start.xml and <token>.xml with the token percent-encoded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import quote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

_TOKEN = re.compile(r"<resumptionToken[^>]*>\s*([^<]*?)\s*</resumptionToken>")
_ERROR = re.compile(r'<error[^>]*code="([^"]+)"')


def page_path(root: str, token: str | None) -> str:
    return f"{root}/{quote(token, safe='') if token else 'start'}.xml"


def read_page(path: str) -> tuple[str | None, str | None] | None:
    """(next token, error code) of a saved page, or None if it isn't there. An empty set of records is no error."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        text = f.read()
    token, error = _TOKEN.search(text), _ERROR.search(text)
    code = error[1] if error and error[1] != "noRecordsMatch" else None
    return (token[1] or None if token and "<record" in text and not code else None), code


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, pages: int) -> None:
        self.root, self.pages = root, pages

    def initialOffset(self) -> dict:
        return {"token": None, "complete": False, "pages": 0}

    def _follow(self, start: dict, most: int) -> tuple[list[tuple], dict]:
        out, at = [], start
        while not at["complete"] and len(out) < most:
            path = page_path(self.root, at["token"])
            found = read_page(path)
            if found is None:
                break
            token, error = found
            out.append((at["pages"], at["token"], path, token, error))
            at = {"token": token, "complete": token is None, "pages": at["pages"] + 1}
        return out, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, end = self._follow(start, self.pages)
        return iter(out), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._follow(start, end["pages"] - start["pages"])[0])

    def commit(self, end: dict) -> None:
        pass


class SavedPages(DataSource):
    """options: path, and pages (how many a batch)."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "page long, token string, path string, next string, error string"

    def simpleStreamReader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("pages", "100")))


def page_stream(spark: SparkSession, path: str, pages: int = 100) -> DataFrame:
    """page, token, path, next, error: a row a page, in the order of the tokens."""
    spark.dataSource.register(SavedPages)
    return spark.readStream.format("saved_pages").option("pages", pages).load(path)


def records(pages: DataFrame, since: str | None = None) -> DataFrame:
    """page, record_id, modified, deleted, title, text, links of the pages' records, those modified since a date if one is given."""
    schema = pa.schema([("page", pa.int64()), ("record_id", pa.string()), ("modified", pa.string()), ("deleted", pa.bool_()), ("title", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string()))])
    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def of(record: ElementTree.Element) -> tuple:
        said: dict[str, list[str]] = {}
        head: dict[str, str] = {}
        gone = False
        for e in record.iter():
            if local(e) == "header":
                gone = e.get("status") == "deleted"
                head = {local(x): (x.text or "").strip() for x in e}
            elif local(e) in ("title", "description") or (local(e) == "identifier" and (e.text or "").strip() != head.get("identifier")):
                said.setdefault(local(e), []).append(" ".join((e.text or "").split()))
        return head.get("identifier"), head.get("datestamp"), gone, next(iter(said.get("title", [])), None), " ".join(said.get("description", [])) or None, said.get("identifier", [])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, path in zip(batch["page"].to_pylist(), batch["path"].to_pylist(), strict=True):
                root = ElementTree.parse(path).getroot()
                found = [of(e) for e in root.iter() if local(e) == "record"]
                found = [r for r in found if r[0] and (since is None or (r[1] or "") >= since)]
                if found:
                    columns = [[page] * len(found), *map(list, zip(*found, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pages.where("error is null").mapInArrow(made, "page long, record_id string, modified string, deleted boolean, title string, text string, links array<string>")


def harvest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what there is now to `path`; a later call goes on after it."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
