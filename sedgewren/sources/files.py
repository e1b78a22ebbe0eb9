"""Sources: documents of many formats, JSON lines, evaluation artefacts and client frames."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "source string, path string, doc_type string, text string, error string"
LABELLED = "text string, label string, _corrupt string"
FRAME = "session_id string, type string, text string, ts timestamp"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def read_plain(data: bytes) -> str:
    """UTF-8 text; a byte-order mark is dropped and undecodable bytes are replaced."""
    return data.decode("utf-8-sig", "replace")


def read_docx(data: bytes) -> str:
    """Paragraphs and table cells in document order, each block on its own line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for block in body:
        if block.tag == f"{_W}p":
            out.append("".join(t.text or "" for t in block.iter(f"{_W}t")))
        elif block.tag == f"{_W}tbl":
            for cell in block.iter(f"{_W}tc"):
                out.append("".join(t.text or "" for t in cell.iter(f"{_W}t")))
    return "\n".join(x for x in out if x.strip())


def _shapes(tree, dx: int = 0, dy: int = 0):
    """(top, left, text) of all shapes and tables below a tree; offsets inside groups are made absolute."""
    for shape in tree:
        if shape.tag == f"{_P}grpSp":
            own, inner = (next((x for x in shape.iter(f"{_A}{n}")), None) for n in ("off", "chOff"))
            move = [int(own.get(k, 0)) - int(inner.get(k, 0)) if own is not None and inner is not None else 0 for k in "xy"]
            yield from _shapes(shape, dx + move[0], dy + move[1])
        elif shape.tag in (f"{_P}sp", f"{_P}graphicFrame"):
            off = next(shape.iter(f"{_A}off"), None)
            at = (int(off.get("y", 0)) + dy, int(off.get("x", 0)) + dx) if off is not None else (dy, dx)
            lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p")]
            yield at, "\n".join(x for x in lines if x.strip())
        else:
            yield from _shapes(shape, dx, dy)


def read_pptx(data: bytes) -> str:
    """Texts of each slide's shapes, from top to bottom and left to right."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(filter(str.isdigit, n.rsplit("/", 1)[1])) or 0))
        for name in slides:
            out += [t for _, t in sorted(_shapes(ElementTree.fromstring(z.read(name))), key=lambda s: s[0]) if t]
    return "\n".join(out)


def read_pdf(data: bytes) -> str:
    """Page texts, if a PDF library is installed."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("no PDF library is installed") from e
    return "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)


def read_image(data: bytes) -> str:
    """Recognised text of an image, if a recogniser is installed; it is loaded once for each Python worker."""
    try:
        from rapidocr_onnxruntime import RapidOCR
    except ImportError as e:
        raise RuntimeError("no text recogniser is installed") from e
    global _recogniser
    _recogniser = globals().get("_recogniser") or RapidOCR()
    found, _ = _recogniser(data)
    return "\n".join(line[1] for line in found or [])


LOADERS: dict[str, Callable[[bytes], str]] = {".txt": read_plain, ".md": read_plain, ".docx": read_docx, ".pptx": read_pptx, ".pdf": read_pdf, ".jpg": read_image, ".png": read_image}


def picture_counts(width: Column, height: Column, page_width: Column, page_height: Column, least: float = 0.6) -> Column:
    """Whether a picture is large enough on its page to be recognised: both ratios at least ``least``."""
    return (width / page_width >= least) & (height / page_height >= least)


def load_documents(spark: SparkSession, folder: str, doc_type: str | None = None, loaders: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """One row for each file below a folder. The type is ``doc_type``, else the parent folder if it is law or case, else NULL.

    Unknown extensions and failing files keep a row with NULL text and an error; other files are not affected. A ``doc_type``
    other than law and case is not taken, and each row's error says so.
    """
    known = loaders or LOADERS
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    inferred = F.nullif(F.regexp_extract("path", r"/(law|case)/[^/]+$", 1), F.lit(""))
    kind = F.lit(doc_type) if doc_type in ("law", "case") else inferred

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, k in zip(*(b.column(i).to_pylist() for i in range(3))):
                name = path.rsplit("/", 1)[-1]
                ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
                try:
                    text, error = (known[ext](content), None) if ext in known else (None, f"unknown extension {ext!r}")
                except Exception as e:  # noqa: BLE001
                    text, error = None, f"{type(e).__name__}: {e}"
                rows.append((name, path, k, text, error))
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], names=["source", "path", "doc_type", "text", "error"])

    loaded = files.withColumn("kind", kind).mapInArrow(run, DOCUMENT)
    if doc_type in (None, "law", "case"):
        return loaded
    return loaded.withColumn("error", F.concat_ws("; ", F.lit(f"unknown doc_type {doc_type!r}"), "error"))


def read_labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(text, label) of good JSON lines, and counts of (read, rejected); blank lines count as neither.

    A line is rejected if it is no JSON object, its text is blank or not a string, or its label is not 0 or 1.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"(?U)^\s*$"))
    o = F.try_parse_json("value")
    text = F.when(F.schema_of_variant(F.try_variant_get(o, "$.text", "variant")) == "STRING", F.try_variant_get(o, "$.text", "string"))
    label = F.try_variant_get(o, "$.label", "double")
    parsed = lines.select(F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("text"), label.alias("label"))
    good = F.coalesce((F.length("text") > 0) & F.col("label").isin(0.0, 1.0), F.lit(False))
    return parsed.where(good).select("text", F.col("label").cast("int").alias("label")), parsed.agg(F.count_if(good).alias("read"), F.count_if(~good).alias("rejected"))


def read_artefact(spark: SparkSession, path: str, field: str = "samples") -> DataFrame:
    """Rows of the array ``field`` of a JSON document with a meta header."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode(field).alias("x")).select("x.*")


def read_excel_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer) rows of a small workbook's first sheet."""
    with zipfile.ZipFile(path) as z:  # a workbook is one file of a bounded size
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        rows = []
        for r in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{ns}row"):
            cells = []
            for c in r.iter(f"{ns}c"):
                v = c.find(f"{ns}v")
                cells.append("".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else None)
            rows.append((cells + [None, None])[:2])
    return spark.createDataFrame(rows[1:], "question string, answer string")


def parse_frames(raw: DataFrame, value: str = "value") -> DataFrame:
    """(type, text) of raw client frames; what is no JSON object is a question."""
    f = F.from_json(F.col(value), "type string, text string")
    known = F.col("f.type").isin("question", "ping", "pong")
    return raw.withColumn("f", f).withColumn("type", F.when(known, F.col("f.type")).otherwise("question")).withColumn("text", F.when(known, F.col("f.text")).otherwise(F.col(value))).drop("f")


def repaired_json(c: Column) -> Column:
    """A model's JSON array as text: without code fence, else from the first [ to the last ]; NULL if neither parses."""
    bare = F.regexp_replace(c, r"^\s*```[A-Za-z]*\s*|\s*```\s*$", "")
    inner = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(inner).isNotNull(), inner)


def artefact(meta: dict, rows: list[dict]) -> str:
    """A JSON document with a meta header, for small results."""
    return json.dumps({"meta": meta, "samples": rows}, ensure_ascii=False, indent=2, default=str)
