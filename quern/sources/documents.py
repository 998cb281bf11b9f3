"""Reading uploaded files: checks, decoding into pages, OCR as a replaceable engine."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

# Kinds by suffix, declared types per kind, limits and signatures.
SUFFIXES = {".pdf": "pdf", ".txt": "text", ".md": "text", ".markdown": "text", ".docx": "docx"}
DECLARED = {
    "pdf": ("application/pdf",), "text": ("text/plain", "text/markdown", "text/x-markdown", "application/octet-stream"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/octet-stream"),
}
MAX_BYTES, MIN_PAGE_LETTERS, LONGEST_NAME = 25 * 1024 * 1024, 24, 255
EICAR = "EICAR-STANDARD-ANTIVIRUS-TEST-FILE"
OCR_LANGUAGES = {"tam": "ta", "eng": "en", "hin": "hi"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def file_name(path: Column) -> Column:
    """Last part of a path of either convention; null if empty, too long, or with controls."""
    name = F.regexp_extract(F.trim(path), r"[^/\\]*$", 0)
    return F.when((name != "") & ~name.isin(".", "..") & (F.length(name) <= LONGEST_NAME) & ~name.rlike(r"[\x00-\x1f\x7f]"), name)


def kind_of(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return table[F.lower(F.regexp_extract(name, r"\.[^.]+$", 0))]


@pandas_udf(T.BooleanType())
def is_word_file(s: pd.Series) -> pd.Series:
    """Whether bytes are a zip that lists its content types, as word files do."""

    def one(data: bytes | None) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                return "[Content_Types].xml" in z.namelist()
        except (zipfile.BadZipFile, ValueError, EOFError):
            return False

    return s.map(one).astype(bool)


def checked(files: DataFrame) -> DataFrame:
    """files (path, content, mime) with name, kind, sha256 and the code of the first failed check."""
    f = files.withColumn("name", file_name(F.col("path"))).withColumn("kind", kind_of(F.col("name")))
    declared = F.lower(F.trim(F.split("mime", ";")[0]))
    fits = F.lit(False)
    for kind, mimes in DECLARED.items():
        fits = fits | ((F.col("kind") == kind) & declared.isin(*mimes))
    body = F.col("content")
    as_text = body.cast("string")
    real = (
        F.when(F.col("kind") == "pdf", F.hex(F.substring(body, 1, 5)) == F.lit(b"%PDF-".hex().upper()))
        .when(F.col("kind") == "docx", (F.hex(F.substring(body, 1, 4)) == "504B0304") & is_word_file(body))
        .otherwise(F.is_valid_utf8(as_text) & ~as_text.contains("\0"))
    )
    error = (
        F.when(F.length(body) > MAX_BYTES, "too_large").when(F.length(body) == 0, "empty").when(F.col("name").isNull(), "bad_name").when(F.col("kind").isNull(), "unsupported_kind")
        .when(~F.coalesce(fits, F.lit(False)), "wrong_type").when(~F.coalesce(real, F.lit(False)), "wrong_content").when(as_text.contains(EICAR), "malware")
    )
    return f.withColumn("sha256", F.sha2("content", 256)).withColumn("error", error)


def docx_text(data: bytes) -> str:
    """Paragraphs of a word file, joined by line ends."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")).strip()


def _pypdf_pages(data: bytes) -> list[str]:
    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


def _pdfium_pages(data: bytes) -> list[str]:
    import pypdfium2

    return [p.get_textpage().get_text_range() for p in pypdfium2.PdfDocument(data)]


#: Readers of PDF files, tried in order.
PDF_READERS: list[Callable[[bytes], list[str]]] = [_pypdf_pages, _pdfium_pages]


def pdf_pages(data: bytes, pdf_readers: list[Callable[[bytes], list[str]]]) -> list[str]:
    """Text per page by the first reader that is installed, does not fail and finds pages."""
    last: Exception = RuntimeError("no PDF reader is installed")
    for reader in pdf_readers:
        try:
            if pages := reader(data):
                return pages
            last = ValueError("no pages")
        except ImportError:
            continue
        except Exception as e:
            last = e
    raise last


def page_image(data: bytes, page: int, scale: float = 2.0) -> bytes:
    """One page of a PDF, counted from 1, as PNG; needs the optional renderer."""
    import pypdfium2

    out = io.BytesIO()
    pypdfium2.PdfDocument(data)[page - 1].render(scale=scale).to_pil().save(out, format="PNG")
    return out.getvalue()


def parse(files: DataFrame) -> DataFrame:
    """(sha256, page_number, text, needs_ocr, error) of checked files without an error."""
    pdf_readers = list(PDF_READERS)  # as they are set here, not in the workers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {"text": lambda b: [b.decode()], "docx": lambda b: [docx_text(b)], "pdf": lambda b: pdf_pages(b, pdf_readers)}
        for pdf in batches:
            rows = []
            for sha, kind, data in zip(pdf["sha256"], pdf["kind"], pdf["content"]):
                try:
                    rows += [(sha, n, text, None) for n, text in enumerate(readers[kind](bytes(data)), 1)]
                except Exception as e:
                    rows.append((sha, 1, None, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["sha256", "page_number", "text", "error"])

    pages = files.where("error is null").select("sha256", "kind", "content").mapInPandas(run, "sha256 string, page_number int, text string, error string")
    letters = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))
    return pages.withColumn("needs_ocr", F.col("error").isNull() & (letters < MIN_PAGE_LETTERS))


class OcrEngine(Protocol):
    name: str

    def read(self, image: bytes, languages: str) -> list[tuple[str, float, list[tuple[float, float]]]]:
        """(text, confidence, corners) of each block."""


class NullOcr:
    name = "unavailable"

    def read(self, image: bytes, languages: str) -> list[tuple[str, float, list[tuple[float, float]]]]:
        return []


class TesseractOcr:
    """By the optional library; words it is not sure of at all (below 0) are dropped."""

    name = "tesseract"

    def read(self, image: bytes, languages: str) -> list[tuple[str, float, list[tuple[float, float]]]]:
        import pytesseract
        from PIL import Image

        d = pytesseract.image_to_data(Image.open(io.BytesIO(image)), lang=languages, output_type=pytesseract.Output.DICT)
        return [
            (t, float(c) / 100, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
            for t, c, x, y, w, h in zip(d["text"], d["conf"], d["left"], d["top"], d["width"], d["height"]) if float(c) >= 0 and t.strip()
        ]


class PaddleOcr:
    """By the optional library, which takes one language."""

    name = "paddle"

    def read(self, image: bytes, languages: str) -> list[tuple[str, float, list[tuple[float, float]]]]:
        import numpy as np
        from paddleocr import PaddleOCR
        from PIL import Image

        return self.blocks(PaddleOCR(lang=ocr_language(languages)).ocr(np.asarray(Image.open(io.BytesIO(image)))))

    @staticmethod
    def blocks(raw: object) -> list[tuple[str, float, list[tuple[float, float]]]]:
        """Blocks [corners, (text, score)] at any depth of nested lists; those whose score is no
        share are dropped."""
        out, stack = [], [raw]
        while stack:
            x = stack.pop()
            if not isinstance(x, (list, tuple)):
                continue
            if len(x) == 2 and isinstance(x[1], (list, tuple)) and len(x[1]) == 2 and isinstance(x[1][0], str):
                score = float(x[1][1])
                if 0.0 <= score <= 1.0:
                    out.append((x[1][0], score, [(float(a), float(b)) for a, b in x[0]]))
            else:
                stack += reversed(x)
        return out


#: OCR engines by name.
OCR_ENGINES: dict[str, type] = {e.name: e for e in (NullOcr, TesseractOcr, PaddleOcr)}


def box(corners: list[tuple[float, float]]) -> tuple[int, int, int, int]:
    """Left, top, width and height around a polygon."""
    xs, ys = [int(x) for x, _ in corners], [int(y) for _, y in corners]
    return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)


def ocr_language(spec: str) -> str:
    """First known language of a list like tam+eng."""
    return next((OCR_LANGUAGES[p] for p in re.split(r"[+,\s]+", spec) if p in OCR_LANGUAGES), "en")


def ocr(images: DataFrame, engine: OcrEngine, languages: str = "tam+eng") -> DataFrame:
    """images (sha256, page_number, image) with text, blocks, engine and mean confidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sha, n, image in zip(pdf["sha256"], pdf["page_number"], pdf["image"]):
                found = [(t, c, b) for t, c, b in engine.read(bytes(image), languages) if 0.0 <= c <= 1.0 and t.strip()]
                rows.append((sha, n, " ".join(t for t, _, _ in found), sum(c for _, c, _ in found) / len(found) if found else None, engine.name, [{"text": t, "confidence": c, "bbox": list(box(b))} for t, c, b in found]))
            yield pd.DataFrame(rows, columns=["sha256", "page_number", "text", "ocr_confidence", "ocr_engine", "ocr_blocks"])

    return images.mapInPandas(run, "sha256 string, page_number int, text string, ocr_confidence double, ocr_engine string, ocr_blocks array<struct<text:string,confidence:double,bbox:array<int>>>")


def damaged(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files (path, sha256) whose content is not what was recorded (path, sha256) of them."""
    return files.select("path", "sha256").join(recorded.select("path", F.col("sha256").alias("recorded")), "path").where("sha256 <> recorded")


def admitted(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Checked files (workspace_id, path, sha256, error, at) with ``error`` 'duplicate' where the
    workspace holds the same content already (``existing``: workspace_id, sha256) or an earlier
    file of the batch brings it. Other workspaces do not matter."""
    known = existing.select("workspace_id", "sha256").distinct().withColumn("_known", F.lit(True))
    good = F.when(F.col("error").isNull(), 0).otherwise(1)
    first = F.row_number().over(Window.partitionBy("workspace_id", "sha256").orderBy(good, "at", "path"))
    marked = files.withColumn("_n", first).join(known, ["workspace_id", "sha256"], "left")
    twice = F.col("_known") | (F.col("_n") > 1)
    return marked.withColumn("error", F.when(F.col("error").isNull() & F.coalesce(twice, F.lit(False)), "duplicate").otherwise(F.col("error"))).drop("_n", "_known")


def blob_key(workspace: Column, document: Column, sha256: Column, version: int = 1) -> Column:
    """Where the content of a version is kept."""
    return F.concat(F.lit("workspaces/"), workspace, F.lit("/documents/"), document, F.lit(f"/v{version}-"), F.substring(sha256, 1, 16))


def accepted(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Uploads (workspace_id, document_id, path, content, mime, at) taken through all checks: the
    first that fails gives the error code, the others get the key of their content."""
    one = admitted(checked(files), existing)
    return one.withColumn("key", F.when(F.col("error").isNull(), blob_key(F.col("workspace_id"), F.col("document_id"), F.col("sha256"))))


def store_blobs(files: DataFrame, path: str) -> None:
    """Write content once under its key; files with an error are not stored. Appending what is
    there already is left out, so a repeated call changes nothing."""
    rows = files.where("error is null").select("key", "content", "sha256").dropDuplicates(["key"])
    try:
        rows = rows.join(files.sparkSession.read.parquet(path).select("key"), "key", "left_anti")
    except AnalysisException:  # nothing there yet
        pass
    rows.write.mode("append").parquet(path)


def pages_of(files: DataFrame, engine: OcrEngine, render: Callable[[bytes, int], bytes] | None = None, languages: str = "tam+eng") -> DataFrame:
    """(sha256, page_number, text, ocr_engine, ocr_confidence, error) of checked files: parsed
    text, and where a page has next to none, what the engine reads of its image."""
    parsed = parse(files)
    draw = page_image if render is None else render
    asked = parsed.where("needs_ocr").join(files.where("kind = 'pdf'").select("sha256", "content").dropDuplicates(["sha256"]), "sha256")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["sha256", "page_number"]].assign(image=[draw(bytes(c), int(n)) for c, n in zip(pdf["content"], pdf["page_number"])])

    images = asked.select("sha256", "page_number", "content").mapInPandas(run, "sha256 string, page_number int, image binary")
    read = ocr(images, engine, languages).select("sha256", "page_number", F.col("text").alias("seen"), "ocr_confidence", "ocr_engine")
    joined = parsed.join(read, ["sha256", "page_number"], "left")
    return joined.select("sha256", "page_number", F.when(F.col("ocr_engine").isNotNull(), F.col("seen")).otherwise(F.col("text")).alias("text"), "ocr_engine", "ocr_confidence", "error")
