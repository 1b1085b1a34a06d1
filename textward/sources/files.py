"""Uploaded files: admission and text extraction."""

from __future__ import annotations

import csv
import email
import io
import itertools
import json
import re
from collections.abc import Iterator
from email.errors import MessageError
from email.header import decode_header
from email.message import Message

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import catalog as C


def extension(name: Column) -> Column:
    """Lower-cased part after the last dot, '' without one."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def admission(files: DataFrame, name: str = "filename", size: str = "size_bytes") -> DataFrame:
    """Append ``admitted`` and ``reject_reason``; decided on metadata, before contents are read."""
    ext = extension(F.col(name))
    reason = F.when(~ext.isin(*C.FILE_EXTENSIONS), "extension").when(F.col(size) > C.MAX_FILE_BYTES, "size")
    return files.select("*", ext.alias("ext"), reason.alias("reject_reason"), reason.isNull().alias("admitted"))


def admit_texts(requests: DataFrame, text: str = "text", max_chars: int = C.MAX_PROMPT_CHARS) -> DataFrame:
    """Append ``admitted``: 1 to ``max_chars`` characters."""
    return requests.withColumn("admitted", F.coalesce(F.length(text).between(1, max_chars), F.lit(False)))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Admissible files under a path with their bytes; size and extension filters reach the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select(F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("size_bytes"), "content")
    return admission(named).where("admitted").drop("reject_reason", "admitted")


def _header(message: Message, name: str) -> str:
    """Value of a mail header, folded lines joined and encoded words decoded; empty without it."""
    raw = next((str(v) for k, v in message.raw_items() if k.lower() == name), "")
    value = re.sub(r"\r?\n[ \t]+", " ", raw.encode("utf-8", "surrogateescape").decode("utf-8", "replace"))
    if "=?" not in value:
        return value
    try:
        return "".join(x if isinstance(x, str) else x.decode(charset or "raw-unicode-escape", "replace")
                       for x, charset in decode_header(value))
    except (ValueError, LookupError, MessageError):
        return value


def _mail(content: bytes) -> str:
    """Sender, recipient, subject and the text parts of a message at any depth, decoded, a line each."""
    message = email.message_from_bytes(content)
    parts = [_header(message, name) for name in ("from", "to", "subject")]
    for part in message.walk():
        if not part.is_multipart() and (part.get_content_type() == "text/plain" or not message.is_multipart()):
            parts.append((part.get_payload(decode=True) or b"").decode("utf-8", "replace"))
    return "\n".join(parts)


@F.arrow_udf(StructType().add("text", "string").add("error", "string"))
def _mail_texts(contents: pa.Array) -> pa.Array:
    """Text or error of each mail; null contents are no mails."""
    out = []
    for content in contents:
        if not content.is_valid:
            out.append(None)
            continue
        try:
            out.append({"text": _mail(content.as_py()), "error": None})
        except Exception:  # whatever a broken mail raises, it is not judged as clean
            out.append({"text": None, "error": "not a mail"})
    return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))


def extract_text(files: DataFrame, *keys: str) -> DataFrame:
    """``ext, text, extracted, error`` of each file (``ext``, ``content``); mails are parsed by ``email``, the rest by columns.

    The whole file is text: bytes that are no UTF-8 become U+FFFD, JSON is parsed (so escapes in its strings are
    resolved) and written again, CSV stays as it is, mails give their headers and text parts.  A file that cannot be
    read, or whose kind has no reader (PDF, DOCX), has a null text and an error; it must not be judged as clean.
    """
    ext = F.col("ext")
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    document = F.try_parse_json(raw).cast("string")
    text = F.when(ext.isin("txt", "csv"), raw).when(ext == "json", document)
    error = F.when(F.col("content").isNull(), "no content").when(~ext.isin("txt", "csv", "json", "eml"), "no reader") \
        .when((ext == "json") & document.isNull(), "not JSON")
    mail = _mail_texts(F.when(ext == "eml", F.col("content")))
    read = files.select(*keys, "ext", text.alias("_text"), error.alias("_error"), mail.alias("_mail"))
    failed = F.coalesce("_error", "_mail.error")
    return read.select(*keys, "ext", F.when(failed.isNull(), F.coalesce("_text", "_mail.text")).alias("text"),
                       failed.isNull().alias("extracted"), failed.alias("error"))


class _Pairs(list):
    """Members of a JSON object; a name may occur twice."""


def _leaves(document) -> Iterator[tuple[str, str]]:
    """Path and value of every leaf of a parsed JSON document but nulls, in document order."""
    todo = [("$", document)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, _Pairs):
            todo += reversed([(f"{path}.{k}" if re.fullmatch(r"\w+", k) else f"{path}[{json.dumps(k, ensure_ascii=False)}]", v)
                              for k, v in node])
        elif isinstance(node, list):
            todo += reversed([(f"{path}[{i}]", v) for i, v in enumerate(node)])
        elif node is not None:
            yield path, node if isinstance(node, str) else json.dumps(node)


def _cells(text: str) -> Iterator[tuple[int, str, str]]:
    """Row, column name and value of every CSV cell that is not empty; the header is row 0."""
    csv.field_size_limit(max(len(text), 1))
    names: list[str] = []
    for row, cells in enumerate(csv.reader(io.StringIO(text, newline=""))):
        names = names if row else cells
        for i, cell in enumerate(cells):
            if cell:
                yield row, names[i] if i < len(names) else f"column {i + 1}", cell


def _file_values(ext: str, text: str) -> Iterator[tuple[int | None, str | None, str | None, str | None]]:
    text = text.removeprefix("\ufeff")
    try:
        if ext == "csv":
            yield from ((row, path, value, None) for row, path, value in _cells(text))
        else:
            document = json.loads(text, object_pairs_hook=_Pairs, parse_int=str, parse_float=str)
            yield from ((None, path, value, None) for path, value in _leaves(document))
    except (ValueError, RecursionError, csv.Error):
        yield None, None, None, "not JSON" if ext == "json" else "not CSV"


def _values_of(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """The values of each file, the other columns repeated, in batches of so many rows however large a file is."""
    for batch in batches:
        kept = [n for n in batch.schema.names if n != "_raw"]
        values = ((i, *v) for i in range(batch.num_rows)
                  for v in _file_values(batch.column("ext")[i].as_py(), batch.column("_raw")[i].as_py()))
        while block := list(itertools.islice(values, rows)):
            at, row, path, value, error = zip(*block)
            taken = batch.select(kept).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(row, pa.int64()), *(pa.array(x, pa.string()) for x in (path, value, error))],
                [*kept, "row", "path", "value", "error"])


def file_values(files: DataFrame, *keys: str) -> DataFrame:
    """``ext, row, path, value, error``: the values of JSON and CSV files one by one, so that a finding names its place.

    JSON gives a row for every string, number (as written) and boolean with its path (``$.a[0]``, names that are no words in quotes);
    CSV one for every cell that is not empty, its column as path and its row, where the header is row 0 and is given
    too, in case it is data.  A cell beyond the header is named by its number.  A file that cannot be read gives one
    row with an error (after the cells read before it), an empty CSV file none, other kinds and files without content are left out.
    """
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    read = files.where(F.col("ext").isin("json", "csv") & F.col("content").isNotNull()).select(*keys, "ext", raw.alias("_raw"))
    schema = read.drop("_raw").schema.add("row", "long").add("path", "string").add("value", "string").add("error", "string")
    return read.mapInArrow(_values_of, schema)
