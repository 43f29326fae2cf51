"""Uploaded documents: what kind they are, the text layer of PDF files, small PDF fixtures."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions import extraction as X
from tallyline.sources.images import UnreadableImage, read_text
from tallyline.sources.vision import VisionClient

#: Largest upload taken.
MAX_BYTES = 10 * 1024 * 1024
# How files of each kind begin.
MAGIC = {"pdf": b"%PDF-", "png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff"}

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|/?[A-Za-z'\"*][A-Za-z0-9*'\"]*", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def kind_of(content: Column) -> Column:
    """'pdf', 'png', 'jpeg' or null, by the first bytes."""
    out = F.lit(None).cast("string")
    for kind, magic in MAGIC.items():
        out = F.when(F.startswith(content, F.lit(magic)), kind).otherwise(out)
    return out


def scan_documents(spark: SparkSession, path: str, stream: bool = False, rejects: bool = False) -> DataFrame:
    """(path, content, kind) of the acceptable files of a folder: of a known kind and not above MAX_BYTES.

    With ``rejects`` the others come as well, without content, and why in ``rejected`` (null for acceptable ones). What is
    too large isn't read.
    """
    reader = (spark.readStream if stream else spark.read).format("binaryFile")
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    kind = kind_of(F.col("content"))
    df = reader.load(path).where(F.col("length") <= MAX_BYTES).select("path", "content", kind.alias("kind"))
    if not rejects:
        return df.where("kind is not null")
    unknown = F.when(F.col("kind").isNull(), F.lit("neither PDF, PNG nor JPEG"))
    known = df.select("path", F.when(F.col("kind").isNotNull(), F.col("content")).alias("content"), "kind", unknown.alias("rejected"))
    large = reader.load(path).where(F.col("length") > MAX_BYTES)
    return known.unionByName(large.select("path", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("kind"), F.lit(f"larger than {MAX_BYTES} bytes").alias("rejected")))


def _literal(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")

    def plain(m: re.Match) -> bytes:
        x = m.group(1)
        return _ESCAPES.get(x, b"" if x in (b"\n", b"\r\n") else bytes([int(x, 8) & 255]) if x.isdigit() else x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S).decode("cp1252", "replace")


def pdf_text(data: bytes) -> str:
    """The text layer: shown strings of every content stream, a new line wherever the text position moves down.

    Streams may be plain or deflated; fonts are read as Windows-1252. A file that is no PDF raises ValueError; one without a
    text layer gives ''.
    """
    if not data.startswith(MAGIC["pdf"]):
        raise ValueError("not a PDF file")
    pages = []
    for head, body in _STREAM.findall(data):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        lines, held, depth = [""], [], 0
        for token in _TOKEN.findall(body):
            if token[:1] in b"(<":
                held.append(_literal(token))
            elif token in (b"[", b"]"):
                depth += 1 if token == b"[" else -1
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"'):
                    lines.append("")
                lines[-1] += "".join(x for x in held if isinstance(x, str))
                held = []
            elif token in (b"T*", b"Td", b"TD", b"Tm", b"ET"):
                if lines[-1]:
                    lines.append("")
                held = []
            elif not depth and token[:1].isalpha():
                held = []
        pages.append("\n".join(x for x in lines if x.strip()))
    return "\n".join(pages).strip()


#: An A4 page in points, the first baseline, the distance of baselines, and lines on one page.
PAGE, TOP, LEFT, LEADING, PAGE_LINES = (595, 842), 790, 60, 16, 45


def make_pdf(lines: list[str]) -> bytes:
    """Pages of PAGE_LINES lines, each shown at its own place; packed streams. What Windows-1252 lacks becomes '?'."""
    sheets = [lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)] or [[]]
    objects: dict[int, bytes] = {}

    def put(body: bytes) -> int:
        objects[len(objects) + 1] = body
        return len(objects)

    font = put(b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding>>")
    tree = put(b"")  # the pages name their tree, which names them: filled in below
    kids = []
    for sheet in sheets:
        shown = (f"1 0 0 1 {LEFT} {TOP - LEADING * i} Tm <{x.encode('cp1252', 'replace').hex()}> Tj" for i, x in enumerate(sheet))
        packed = zlib.compress("\n".join(["BT", "/Text 11 Tf", *shown, "ET"]).encode())
        drawn = put(b"<</Filter/FlateDecode/Length %d>>\nstream\n%b\nendstream" % (len(packed), packed))
        kids.append(put(b"<</Type/Page/Parent %d 0 R/MediaBox[0 0 %d %d]/Contents %d 0 R/Resources<</Font<</Text %d 0 R>>>>>>" % (tree, *PAGE, drawn, font)))
    objects[tree] = b"<</Type/Pages/Count %d/Kids[%b]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    root = put(b"<</Type/Catalog/Pages %d 0 R>>" % tree)
    out, entries = bytearray(b"%PDF-1.5\n"), [b"0000000000 65535 f\r\n"]
    for number, body in objects.items():
        entries.append(b"%010d 00000 n\r\n" % len(out))
        out += b"%d 0 obj %b endobj\n" % (number, body)
    end = len(out)
    return bytes(out) + b"xref\n0 %d\n%btrailer<</Root %d 0 R/Size %d>>\nstartxref\n%d\n%%%%EOF" % (len(entries), b"".join(entries), root, len(entries), end)


_READ = T.StructType([T.StructField("text", T.StringType()), T.StructField("method", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_READ)
def _read(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """Text of each document; a document that can't be read has an error instead, and the batch goes on."""
    rows = []
    for data, k in zip(content, kind):
        try:
            if k == "pdf" and (text := pdf_text(data)):
                rows.append((text, "text", None))
            elif k == "png":
                rows.append((read_text(data), "vision", None))
            else:  # without a rasteriser or a JPEG decoder there is nothing to see
                rows.append(("", "vision", None))
        except UnreadableImage:
            rows.append(("", "vision", None))
        except Exception as broken:  # noqa: BLE001 - any bad upload must fail alone
            rows.append((None, None, f"{type(broken).__name__}: {broken}"[:500]))
    return pd.DataFrame(rows, columns=["text", "method", "error"])


#: Confidence of the built-in recogniser in a fully read photo.
VISION_CONFIDENCE = 0.95


def _asked(client: VisionClient):
    """A column function: the client's answer for each document, or why there is none."""

    @F.pandas_udf("struct<answer:string,error:string>")
    def ask(content: pd.Series, kind: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        rows = []
        for data, k, w in zip(content, kind, wanted):
            try:
                rows.append((client.answer(data, k) if w else None, None))
            except Exception as broken:  # noqa: BLE001 - any bad document must fail alone
                rows.append((None, f"{type(broken).__name__}: {broken}"[:500]))
        return pd.DataFrame(rows, columns=["answer", "error"])

    return ask


def read_documents(documents: DataFrame, client: VisionClient | None = None) -> DataFrame:
    """(path, text, method, error, fields, missing, confidence) of scanned documents.

    PDF files with a text layer are read as text. All else is a picture, for which ``client`` answers, or the built-in
    reader; the answer is kept as ``text``, checked, and an invalid one is an error. A picture's confidence is the
    recogniser's times the share of core fields found. Rejected documents have that as their error.
    """
    out = X.extracted(documents.withColumn("r", _read("content", "kind")).select(*documents.columns, "r.*"), "text")
    pictured = (F.col("method") == "vision") & F.col("error").isNull()
    if client is None:
        f, sure = F.col("fields"), F.round(VISION_CONFIDENCE * F.col("confidence"), 2)
        own = F.struct(f["vendor_name"].alias("vendor_name"), f["invoice_no"].alias("invoice_no"), f["invoice_date"].cast("string").alias("invoice_date"), f["amount"].alias("amount"), f["tax_id"].alias("tax_id"), sure.alias("extraction_confidence"))
        out = out.withColumn("a", F.struct(F.when(pictured, F.to_json(own)).alias("answer"), F.lit(None).cast("string").alias("error")))
    else:
        out = out.withColumn("a", _asked(client)("content", "kind", pictured & F.col("kind").isNotNull()))
    v = X.validated(F.col("a.answer"))
    out = out.withColumn("v", v)
    invalid = F.when(pictured, F.coalesce(F.col("a.error"), F.col("v.error")))
    rejected = F.col("rejected") if "rejected" in documents.columns else F.lit(None).cast("string")
    seen = F.struct(*(F.col(f"v.{n}").alias(n) for n in ("vendor_name", "invoice_no", "amount", "invoice_date", "tax_id")))
    out = out.withColumns({"fields": F.when(pictured, seen).otherwise(F.col("fields")), "error": F.coalesce(rejected, F.col("error"), invalid), "text": F.when(pictured, F.col("a.answer")).otherwise(F.col("text"))})
    out = out.withColumn("missing", X.missing_of(F.col("fields")))
    found = F.round((len(X.CORE_FIELDS) - F.size("missing")) / float(len(X.CORE_FIELDS)), 2)
    return out.select("path", "text", "method", "error", "fields", "missing", F.when(F.col("method") == "vision", F.round(F.col("v.confidence") * found, 2)).otherwise(found).alias("confidence"))
