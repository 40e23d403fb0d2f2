"""Collections in CBOR: files of nested items, read whole by Spark and decoded item by item in the task.

Only data items of the published format are known: integers, byte and text strings, arrays and maps of either length, tags,
floats and simple values. Strings of unknown length are joined. A file that ends inside an item, or holds what is no item, is told by its path and byte.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CborError(ValueError):
    """Bytes that are no CBOR item."""


class Break:
    """Ends an array, map or string of unknown length."""


SIMPLE = {20: False, 21: True, 22: None, 23: None}


def item(data: bytes, at: int = 0) -> tuple[Any, int]:
    """The item at a byte, and the byte behind it. Nesting is as deep as Python's stack allows."""
    if at >= len(data):
        raise CborError(f"the data ends at byte {at}")
    kind, info = data[at] >> 5, data[at] & 31
    at += 1
    size: int | None = info
    if 24 <= info <= 27:
        width = 1 << info - 24
        raw = data[at : at + width]
        if len(raw) < width:
            raise CborError(f"the data ends at byte {len(data)}")
        at += width
        if kind == 7 and width > 1:
            return struct.unpack({2: ">e", 4: ">f", 8: ">d"}[width], raw)[0], at
        size = int.from_bytes(raw)
    elif info == 31 and kind in (2, 3, 4, 5, 7):
        size = None
    elif info > 27:
        raise CborError(f"no item at byte {at - 1}")
    if kind == 7:
        return (Break if size is None else SIMPLE.get(size)), at
    if kind in (0, 1):
        return (size if kind == 0 else -1 - size), at
    if kind == 6:
        return item(data, at)
    if kind in (2, 3) and size is not None:
        if at + size > len(data):
            raise CborError(f"the data ends at byte {len(data)}")
        raw = data[at : at + size]
        return (raw if kind == 2 else raw.decode("utf-8", "replace")), at + size
    found = []
    wanted = None if size is None else size * (2 if kind == 5 else 1)
    while wanted is None or len(found) < wanted:
        one, at = item(data, at)
        if one is Break:
            if wanted is not None:
                raise CborError(f"a break inside an item at byte {at - 1}")
            break
        found.append(one)
    if kind in (2, 3):
        return (b"" if kind == 2 else "").join(found), at
    return (found if kind == 4 else list(zip(found[::2], found[1::2], strict=True))), at


def elements(data: bytes) -> Iterator[Any]:
    """The items of a file one after another; an array of unknown length that is no item's part gives its elements, so that
    no more than one of them is held decoded."""
    at, inside = 0, False
    while at < len(data):
        if data[at] == 0x9F and not inside:
            at, inside = at + 1, True
            continue
        one, at = item(data, at)
        if one is Break:
            inside = False
        else:
            yield one


def paragraph(record: Any) -> tuple[str, str] | None:
    """(docno, text) of a paragraph record: tag, id, bodies. A body is text, or a link whose anchor counts as text; the names of
    the linked pages follow the text as keywords. None for other items and paragraphs without text."""
    if not (isinstance(record, list) and len(record) == 3 and isinstance(record[1], (bytes, str)) and isinstance(record[2], list)):
        return None
    name = record[1].decode("utf-8", "replace") if isinstance(record[1], bytes) else record[1]
    said, pages = [], []

    def read(value: Any, depth: int, into: list[str]) -> None:
        if isinstance(value, (bytes, str)):
            into.append(value.decode("utf-8", "replace") if isinstance(value, bytes) else value)
        elif isinstance(value, list):
            for n, x in enumerate(value):
                # a link is tag, page, section, page id, anchor
                if depth == 1 and n == 3:
                    continue
                read(x, depth + 1, pages if depth == 1 and n == 1 else into)

    for body in record[2]:
        read(body, 0, said)
    text = " ".join(x for x in said if x)
    keywords = ", ".join(x for x in pages if x)
    text = " ".join(filter(None, [text, f">>> {keywords}" if keywords else ""]))
    return (f"CAR_{name}", text) if name and text else None


def read_records(spark: SparkSession, path: str, make: Callable[[Any], tuple | None], schema: str) -> DataFrame:
    """What ``make`` gives of each item of the CBOR files below a path, one task for each file or more of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    for one in elements(content):
                        made = make(one)
                        if made is not None:
                            rows.append(made)
                        if len(rows) >= 1000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except (CborError, RecursionError) as e:
                    raise CborError(f"{file}: {e}") from e
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(docno, text) of a paragraph corpus."""
    return read_records(spark, path, paragraph, "docno string, text string")


def paragraph_fields(rows: DataFrame) -> DataFrame:
    """(docno, feature, said): ``:pid:`` and ``:paragraph:`` of each."""
    parts = F.create_map(F.lit(":pid:"), F.col("docno"), F.lit(":paragraph:"), F.col("text"))
    return rows.select("docno", F.explode(parts).alias("feature", "said"))


def encoded(value: Any) -> bytes:
    """An item for a value: numbers, strings, bytes, lists, None and booleans."""

    def head(kind: int, n: int) -> bytes:
        if n < 24:
            return bytes([kind << 5 | n])
        width = next(w for w in (1, 2, 4, 8) if n < 1 << 8 * w)
        return bytes([kind << 5 | 24 + (1, 2, 4, 8).index(width)]) + n.to_bytes(width)

    if value is None or isinstance(value, bool):
        return bytes([0xE0 | {False: 20, True: 21, None: 22}[value]])
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, (bytes, str)):
        raw = value.encode() if isinstance(value, str) else value
        return head(3 if isinstance(value, str) else 2, len(raw)) + raw
    return head(4, len(value)) + b"".join(map(encoded, value))
