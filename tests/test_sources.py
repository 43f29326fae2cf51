import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.functions import extraction as X
from tallyline.operators.tuning import TunedModel
from tallyline.sources import documents, images, jsonl
from tallyline.sources.store import Store, active_model, log_model
from tallyline.streaming import ingest

LINES = ["Vendor: Northwind Logistics, Ltd.", "Invoice No: INV-2024/0001", "Invoice Date: 2024-03-14", "Amount Due: USD 12,345.00", "Tax ID: 12-3456789-401"]
PHOTO = ("Northwind Logistics, Ltd.", "INV-2024/0001", "2024-03-14", "12,345.00", "12-3456789-401")


def test_fields(spark):
    texts = ["\n".join(LINES), "nothing here", "Inv # X9\nSupplier : A\nFrom: B\nDate: soon\nDate: 1/2/2024\nTotal: -\nGrand total: 7,5", None]
    df = X.extracted(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").select("fields.*", "missing", "confidence").collect()
    assert (df[0].vendor_name, df[0].invoice_no, df[0].amount, str(df[0].invoice_date), df[0].tax_id, df[0].confidence) == ("Northwind Logistics, Ltd.", "INV-2024/0001", 12345, "2024-03-14", "12-3456789-401", 1.0)
    assert df[1].confidence == df[3].confidence == 0.0 and len(df[1].missing) == 4
    assert (df[2].vendor_name, str(df[2].invoice_date), df[2].amount) == ("A", "2024-02-01", 8)


@pytest.mark.parametrize(
    "answer, error",
    [
        ({"vendor_name": "A", "amount": 5, "invoice_date": "2024-01-02", "extraction_confidence": 0.5}, None),
        ({"vendor_name": None, "amount": "USD 5", "invoice_no": "x", "extraction_confidence": 1}, None),
        ({"vendor_name": 5}, "vendor_name"), ({"invoice_date": "soon"}, "invoice_date"), ({"amount": "none"}, "amount"), ({"amount": []}, "amount"),
        ({"extraction_confidence": "high"}, "extraction_confidence"), ({"extraction_confidence": 1.5}, "extraction_confidence"), ([1], "object"), ("{broken", "object"),
    ],
)
def test_answers(spark, answer, error):
    text = answer if isinstance(answer, str) else json.dumps(answer)
    r = spark.createDataFrame([(text,)], "t string").select(X.validated(F.col("t")).alias("x")).first().x
    assert (r.error is None) if error is None else error in r.error


def test_pdf_round_trip():
    lines = LINES + ["(a) \\ b", "Größe 5 €"] + [f"line {i}" for i in range(100)]
    assert documents.pdf_text(documents.make_pdf(lines)) == "\n".join(lines)
    assert documents.pdf_text(documents.make_pdf([])) == ""
    with pytest.raises(ValueError):
        documents.pdf_text(b"hello")


@pytest.mark.parametrize("seed", [3, 4, 5, 30, 42])
def test_photo_round_trip(seed):
    assert images.read_text(images.make_photo(*PHOTO, seed=seed)).split("\n") == [x.upper() for x in LINES]


def test_photos_of_many_seeds():
    for seed in range(1, 9):
        assert images.read_text(images.render_text([LINES[1]], seed=seed)) == LINES[1].upper()
    assert images.read_text(images.render_text(["   "], seed=5)) == ""


def test_row_filters_and_colours():
    import zlib

    def file(rows, kind, width, height):
        blocks = {b"IHDR": width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, kind, 0, 0, 0]), b"IDAT": zlib.compress(rows), b"IEND": b""}
        return images.SIGNATURE + b"".join(len(b).to_bytes(4, "big") + t + b + zlib.crc32(t + b).to_bytes(4, "big") for t, b in blocks.items())

    def paeth(a, b, c):
        return min((a, b, c), key=lambda v: abs(a + b - c - v))

    rng = np.random.default_rng(1)
    for kind, step in ((0, 1), (4, 2), (2, 3), (6, 4)):
        pixels = rng.integers(0, 256, (10, 7 * step))
        raw = b""
        for y in range(10):
            up = pixels[y - 1] if y else np.zeros(7 * step, int)
            left, corner = (np.concatenate([np.zeros(step, int), x[:-step]]) for x in (pixels[y], up))
            guess = [0 * up, left, up, (left + up) // 2, np.array([paeth(*v) for v in zip(left, up, corner)])][y % 5]
            raw += bytes([y % 5]) + ((pixels[y] - guess) % 256).astype(np.uint8).tobytes()
        want = pixels.reshape(10, 7, step)
        want = want[:, :, 0] if step < 3 else want[:, :, :3].mean(2).astype(int)
        assert (images.read_png(file(raw, kind, 7, 10)) == want).all()


def test_bad_images():
    png = images.write_png(np.full((20, 20), 255))
    assert images.read_text(png) == ""
    for bad in (b"x", png[:40], images.SIGNATURE, png.replace(b"\x08\x00\x00\x00\x00", b"\x08\x02\x00\x00\x00", 1)):
        with pytest.raises(images.UnreadableImage):
            images.read_png(bad)


def test_jsonl(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"id": "a", "amount": 5, "x": 1}\n\n{"id": "b", "amount": 6, "vendor_name": "Ä", "invoice_date": "2024-01-02"}\n')
    inv = jsonl.read_invoices(spark, str(p))
    assert [(r.id, r.vendor_name, r.currency) for r in inv.orderBy("id").collect()] == [("a", "", "USD"), ("b", "Ä", "USD")]
    jsonl.write_invoices(inv, str(tmp_path / "out"))
    assert jsonl.read_invoices(spark, str(tmp_path / "out")).exceptAll(inv).isEmpty()
    p.write_text('{"amount": 5}\n')
    with pytest.raises(Exception, match="without id"):
        jsonl.read_invoices(spark, str(p)).collect()
    pairs = spark.sql("select 'a' id_a, 'b' id_b, 0.123456D score, 'flag' label, named_struct('invoice_no', 0.98765D, 'tax_id', 'match', 'rule', cast(null as string)) breakdown")
    jsonl.write_pairs(pairs, str(tmp_path / "pairs"))
    r = jsonl.read_pairs(spark, str(tmp_path / "pairs")).first()
    assert (r.score, r.breakdown.invoice_no, r.breakdown.rule) == (0.1235, 0.9877, None)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "w"))
    assert s.read("t", "x int").isEmpty() and active_model(s) is None
    s.append("t", spark.range(2).select(F.col("id").cast("int").alias("x")))
    assert s.read("t", "x int").count() == 2
    s.replace("p", spark.sql("select 1 x"))
    old = s.read("p", "x int")
    s.replace("p", spark.sql("select 2 x"))
    assert s.read("p", "x int").first().x == 2 and old.first().x == 1
    log_model(s, TunedModel(bias=0.5, model_id="m"))
    assert active_model(s).bias == 0.5
    log_model(s, None, active=False)
    assert active_model(s) is None
    s.clear("t", "p")
    assert s.read("p", "x int").isEmpty()


def test_ingest(spark, tmp_path):
    inbox, root = tmp_path / "inbox", str(tmp_path / "root")
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(documents.make_pdf(LINES))
    (inbox / "b.png").write_bytes(images.make_photo(*PHOTO))
    (inbox / "broken.png").write_bytes(images.SIGNATURE + b"junk")
    (inbox / "note.txt").write_bytes(b"hello")
    ingest.run(spark, str(inbox), root)
    s = Store(spark, root)
    rows = s.read("invoices", ingest.INVOICES)
    assert rows.count() == 3 and rows.where("amount = 12345").count() == 2
    pair = s.read("pairs", "id_a string, id_b string, score double, label string").where("score > 0.9").collect()
    assert len(pair) == 1
    ingest.run(spark, str(inbox), root)
    assert s.read("invoices", ingest.INVOICES).count() == 3
    (inbox / "c.pdf").write_bytes(documents.make_pdf(["Invoice No: 7"]))
    ingest.run(spark, str(inbox), root)
    assert s.read("invoices", ingest.INVOICES).count() == 4
    audit = s.read("audit", ingest.AUDIT)
    assert audit.where("status = 'done'").count() == 4
    assert [r.error for r in audit.where("status = 'failed'").collect()] == ["neither PDF, PNG nor JPEG"]
    assert rows.where("extraction_confidence = 0.95").count() == 1


def test_asked_recognisers(spark):
    from tallyline.sources.vision import ChatClient

    sent = []

    def send(url, body, headers, seconds):
        sent.append((url, json.loads(body), headers))
        return json.dumps({"choices": [{"message": {"content": '{"vendor_name": "A"}'}}]}).encode()

    client = ChatClient("http://x", "m", "k", send=send)
    assert json.loads(client.answer(b"abc", "png")) == {"vendor_name": "A"} and "data:image/png;base64,YWJj" in json.dumps(sent[0][1]) and sent[0][2]["Authorization"] == "Bearer k"
    with pytest.raises(RuntimeError):
        ChatClient("http://x", "m", send=lambda *a: b"{}").answer(b"", "png")

    class Told:
        def answer(self, content, kind):
            return {b"1": '{"vendor_name": "A", "invoice_no": "7", "amount": 5, "invoice_date": "2024-01-02", "extraction_confidence": 0.8}', b"2": '{"amount": []}'}[bytes(content[-1:])]

    png, jpeg = documents.MAGIC["png"], documents.MAGIC["jpeg"]
    df = spark.createDataFrame([("a", bytearray(jpeg + b"1"), "jpeg"), ("b", bytearray(png + b"2"), "png"), ("c", bytearray(png + b"3"), "png")], "path string, content binary, kind string")
    got = {r.path: r for r in documents.read_documents(df, Told()).collect()}
    assert (got["a"].fields.vendor_name, got["a"].fields.amount, got["a"].confidence, got["a"].error) == ("A", 5, 0.8, None)
    assert "amount" in got["b"].error and "KeyError" in got["c"].error
