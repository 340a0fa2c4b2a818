"""Reading and writing documents as files: text, CSV, JSON, spreadsheets, word-processor files, and databases.

Formats that are zipped XML are read with the standard library in Arrow batches of binary files; formats whose
decoding needs other libraries (PDF, images, audio) take a decoder function.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_EXTENSIONS = ("txt", "md")
#: What a file holds, by its extension (fixed values).
MODALITIES = {"pdf": "text", "txt": "text", "md": "text", "docx": "text", "html": "text", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "mp3": "audio", "wav": "audio", "m4a": "audio", "mp4": "video", "avi": "video", "csv": "table", "xlsx": "table"}
#: Encodings tried in order after UTF-8 (fixed values); the last reads anything.
ENCODINGS = ("utf-8", "utf-16", "cp1252", "latin-1")


def scan(spark: SparkSession, folder: str, extensions: Sequence[str] = ()) -> DataFrame:
    """path, length, modificationTime and content of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(extension(F.col("path")).isin(*extensions)) if extensions else files


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def modality(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MODALITIES.items() for x in kv])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("unknown"))


def page_modality(pages: DataFrame, path: str) -> DataFrame:
    """image for files with more image pages than text pages, else text. pages: is_image."""
    return pages.groupBy(path).agg(F.when(F.count_if("is_image") > F.count_if(~F.col("is_image")), "image").otherwise("text").alias("modality"))


def decode(content: bytes) -> tuple[str, str]:
    """Text and the encoding that it was read in."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace"), "utf-16"
    for name in ENCODINGS:
        if name != "utf-16":
            try:
                return content.decode(name), name
            except UnicodeDecodeError:
                continue
    raise AssertionError("the last encoding reads anything")


def tidied(text: str) -> str:
    """One kind of line end; white space within a line as single spaces; trimmed."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return "\n".join(" ".join(line.split()) for line in lines).strip()


def _docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{name}t")) for p in root.iter(f"{name}p"))


def _xlsx(content: bytes) -> list[tuple[str, list[list[str]]]]:
    name = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{name}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{name}si")]
        out = []
        for sheet in sorted(n for n in names if re.match(r"xl/worksheets/[^/]+\.xml$", n)):
            rows = []
            for row in ElementTree.fromstring(z.read(sheet)).iter(f"{name}row"):
                cells = []
                for c in row.iter(f"{name}c"):
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = c.find(f"{name}v")
                    text = "".join(t.text or "" for t in c.iter(f"{name}t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                    cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
                rows.append(cells)
            out.append((sheet.rsplit("/", 1)[1][:-4], rows))
    return out


DECODERS: dict[str, Callable[[bytes], str]] = {"txt": lambda b: decode(b)[0], "md": lambda b: decode(b)[0], "docx": _docx}


def documents(files: DataFrame, decoders: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, text, n_lines and error of binary files, by a decoder for each extension. Files without one, and broken ones, have an error instead of a text."""
    known = DECODERS | (decoders or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
                try:
                    text = tidied(known[kind](content))
                    rows.append((path, text, text.count("\n") + 1, None))
                except KeyError:
                    rows.append((path, None, None, f"unsupported: {kind}"))
                except Exception as e:  # noqa: BLE001  a broken file is a row, not the end of the job
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "text", "n_lines", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, n_lines long, error string")


def sheets(files: DataFrame) -> DataFrame:
    """path, sheet, row and cells of spreadsheet files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, sheet, i, cells) for sheet, lines in _xlsx(content) for i, cells in enumerate(lines)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInArrow(run, "path string, sheet string, row long, cells array<string>")


WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Properties of a word-processor file and their elements in docProps/core.xml (fixed values).
PROPERTIES = {
    "title": "{http://purl.org/dc/elements/1.1/}title",
    "author": "{http://purl.org/dc/elements/1.1/}creator",
    "created": "{http://purl.org/dc/terms/}created",
    "modified": "{http://purl.org/dc/terms/}modified",
    "revision": "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}revision",
}


def _paragraphs(node: ElementTree.Element) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in node.iter(f"{WORD}p"))


def _word_file(content: bytes, tables: bool, images: bool, headers: bool) -> dict:
    out: dict = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "docProps/core.xml" in names:
            core = ElementTree.fromstring(z.read("docProps/core.xml"))
            out |= {k: core.findtext(tag) for k, tag in PROPERTIES.items()}
        root = ElementTree.fromstring(z.read("word/document.xml"))
        related = {}
        if "word/_rels/document.xml.rels" in names:
            related = {r.get("Id"): r for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
        if tables:
            body = root.find(f"{WORD}body")
            out["tables"] = [[[_paragraphs(c) for c in row.findall(f"{WORD}tc")] for row in t.findall(f"{WORD}tr")] for t in (body if body is not None else []) if t.tag == f"{WORD}tbl"]
        if images:
            found = [f"word/{r.get('Target')}" for r in related.values() if r.get("Type", "").endswith("/image") and r.get("TargetMode") != "External"]
            out["images"] = [{"name": n.rsplit("/", 1)[1], "data": z.read(n)} for n in found if n in names]
        if headers:
            for kind in ("header", "footer"):
                texts, now = [], ""
                # A section without a part of its own has the one of the section before.
                for section in root.iter(f"{WORD}sectPr"):
                    for ref in section.findall(f"{WORD}{kind}Reference"):
                        target = related.get(ref.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"))
                        if ref.get(f"{WORD}type", "default") == "default" and target is not None:
                            now = _paragraphs(ElementTree.fromstring(z.read(f"word/{target.get('Target')}")))
                    texts.append(now)
                out[f"{kind}s"] = texts
    return out


def word_parts(files: DataFrame, *, tables: bool = True, images: bool = True, headers: bool = True) -> DataFrame:
    """path, properties (title, author, created, modified, revision), tables (rows of cells' texts), images (name and data), headers and footers (a text
    a section) and error of word-processor files. Parts that are not asked for are null; a broken file has an error and nothing else."""
    strings = pa.list_(pa.string())
    kinds = {
        **{k: pa.string() for k in ("path", *PROPERTIES)}, "tables": pa.list_(pa.list_(strings)), "images": pa.list_(pa.struct([("name", pa.string()), ("data", pa.binary())])),
        "headers": strings, "footers": strings, "error": pa.string(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    row = _word_file(content, tables, images, headers)
                except Exception as e:  # noqa: BLE001  a broken file is a row, not the end of the job
                    row = {"error": f"{type(e).__name__}: {e}"}
                row["path"] = path
                yield pa.RecordBatch.from_arrays([pa.array([row.get(k)], kind) for k, kind in kinds.items()], names=list(kinds))

    schema = "path string, " + ", ".join(f"{k} string" for k in PROPERTIES) + ", tables array<array<array<string>>>, images array<struct<name: string, data: binary>>, headers array<string>, footers array<string>, error string"
    return files.select("path", "content").mapInArrow(run, schema)


def dialect(sample: str) -> dict[str, str]:
    """Separator and quote of a CSV file from its first 1024 characters."""
    import csv

    try:
        found = csv.Sniffer().sniff(sample[:1024])
        return {"sep": found.delimiter, "quote": found.quotechar or '"'}
    except csv.Error:
        return {"sep": ",", "quote": '"'}


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.read.options(**{"header": "true", "inferSchema": "true", "multiLine": "true", "escape": '"'} | options).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    reader = spark.read.option("multiLine", str(multi_line).lower())
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", gzip: bool = False) -> None:
    df.write.mode(mode).option("compression", "gzip" if gzip else "none").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A database table; with a number column and its bounds it is read in partitions."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), extension(F.col("path")).alias("extension"), modality(F.col("path")).alias("modality"))


def snapshot(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Writes a collection; by: columns whose values become folders, so that filters on them skip files."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def compacted(df: DataFrame, path: str, files: int) -> None:
    df.repartition(files).write.mode("overwrite").parquet(path)


def create_collection(spark: SparkSession, name: str, schema: str) -> bool:
    """Registers an empty table unless there is one; whether it was created."""
    if spark.catalog.tableExists(name):
        return False
    spark.createDataFrame([], schema).write.saveAsTable(name)
    return True
