"""Checking new batches against all history by content-defined chunks.

A record's number becomes byte streams in which neither look-alike letters, case, punctuation nor the order of parts
count: its signs sorted, the same without words added in passing, and its digits but zeros, sorted. A rolling hash over
two bytes is taken along each stream, and a boundary follows wherever it is smaller than at the bytes around: the *content*
says where, so a sign more or less moves the boundaries next to it and no others. The persistent table has a row (key,
record) for every chunk of every accepted record; the key also takes in the vendor and the amount's band, so a chunk
leads to the few records that could match at all.

A new record follows its rarest chunks only: as many as any record sharing ``COVERAGE`` of a stream's bytes must have one
of. Chunks that thousands of numbers share are thus never followed, however long their lists; how long they are stands
in a table of counts beside the chunks. For the records met, the bytes of shared chunks are added up, and those covered
to ``COVERAGE`` in one of the streams are compared exactly. Whatever the exact comparison accepts agrees in one stream
altogether, hence is covered whole: no such pair is lost.

Equal records (vendor, amount, number as written without case and punctuation) are one record with its first batch:
copies, though they be a third of the table, have one entry, and are looked up once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.formatting import spells
from tallyline.llm.texts import missing
from tallyline.llm.variants import vendor_classes
from tallyline.plans.lineage import Scratch
from tallyline.sources.store import Store

#: Share of a stream's bytes in shared chunks from which two numbers are compared.
COVERAGE = 0.8
#: Lists of a chunk up to this length count as equally rare.
SHORT_LIST = 16
#: A boundary has the smallest rolling hash of so many bytes before and after it; no chunk but a whole stream is shorter than that.
REACH = 3
#: Amounts may differ by one in a hundred of the larger.
TOLERANCE = 0.01
#: Width of an amount band as a logarithm: amounts within the tolerance are in one band or two adjacent ones.
BAND = 0.0202
#: Keys of a batch up to which they are broadcast to the tables of the history, which then are read where they lie;
#: beyond, the joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Words added to a number in passing; look-alike letters and the digits they are read as.
INCIDENTAL = frozenset("copy kopie copie copia salinan duplicate duplicata duplikat dup scan scanned orig original rev revised resend resent 2nd second final draft page".split())
_FOLD = str.maketrans("ilsbzgo", "1158260")

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def chunk_batch(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, hash, bytes) of every chunk of the streams, all at once.

    A boundary follows a byte whose rolling hash (of it and its predecessor) is smaller than those of the REACH bytes
    before it and not larger than those of the REACH bytes after it. A chunk's hash is a difference of the running
    polynomial hash, scaled back to the chunk's beginning.
    """
    data = np.frombuffer(b"".join(streams), np.uint8)
    n = len(data)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    owner = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    first = np.append(True, owner[1:] != owner[:-1])
    before = np.append(np.uint8(0), data[:-1]).astype(np.uint32)
    before[first] = 0
    rolled = ((before * np.uint32(0x01000193)) ^ data) * np.uint32(0x85EBCA6B)
    rolled ^= rolled >> np.uint32(13)
    cut = ~first
    cut[:REACH] = cut[-REACH:] = False
    for d in range(1, min(REACH, n - 1) + 1):
        same = owner[d:] == owner[:-d]  # no boundary so near either end of a stream
        cut[d:] &= same & (rolled[d:] < rolled[:-d])
        cut[:-d] &= same & (rolled[:-d] <= rolled[d:])
    ends = np.flatnonzero(cut | np.append(first[1:], True))
    begins = np.append(0, ends[:-1] + 1)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(n, _BASE))
        scaled = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)
        back = np.cumprod(np.full(n, _INVERSE))
        ahead = np.where(begins > 0, scaled[begins - 1], np.uint64(0))
        hashes = (scaled[ends] - ahead) * back[begins]
    size = ends - begins + 1
    hashes ^= size.astype(np.uint64) << np.uint64(56)
    return owner[ends], hashes.view(np.int64), size


def streams_of(form: str) -> list[bytes]:
    """The different streams of a number (lower-case parts joined by blanks): all signs, those of the parts that are no
    words added in passing (look-alikes as digits), and the digits as written but zeros; each sorted, none empty."""
    parts = form.split()
    kept = "".join(p for p in parts if p not in INCIDENTAL)
    found = ("".join(parts).translate(_FOLD), kept.translate(_FOLD), "".join(c for c in kept if c in "123456789"))
    return list(dict.fromkeys("".join(sorted(x)).encode() for x in found if x))


def chunks_of(forms: list[str]) -> list[list[dict[int, int]]]:
    """For each number and each of its streams the hashes of its chunks and their bytes (a repeated chunk's together)."""
    streams = [streams_of(f) for f in forms]
    out: list[list[dict[int, int]]] = [[{} for _ in s] for s in streams]
    flat = [held for s in out for held in s]
    for owner, h, n in zip(*(x.tolist() for x in chunk_batch([x for s in streams for x in s]))):
        flat[owner][h] = flat[owner].get(h, 0) + n
    return out


def coverage(a: list[dict[int, int]], b: list[dict[int, int]]) -> float:
    """Bytes of shared chunks by those of the longer stream, in the two streams where that is highest."""
    return max((sum(min(n, y[h]) for h, n in x.items() if h in y) / max(sum(x.values()), sum(y.values())) for x in a for y in b), default=0.0)


def _zeroless(parts: list[str], target: str) -> bool:
    """Whether the parts without leading zeros, in some order, spell ``target`` when zeros between them are skipped."""
    target = target.lstrip("0")
    if not parts:
        return not target
    tried = set()
    for i, part in enumerate(parts):
        if part not in tried and target.startswith(part) and _zeroless(parts[:i] + parts[i + 1 :], target[len(part) :]):
            return True
        tried.add(part)
    return False


def _runs(parts: list[str]) -> tuple[list[str], list[str]]:
    """Letter runs and digit runs of all parts."""
    letters: list[str] = []
    digits: list[str] = []
    for p in parts:
        for is_digit, run in groupby(p, lambda c: c in "0123456789"):
            (digits if is_digit else letters).append("".join(run))
    return letters, digits


def same_invoice_number(a: str, b: str) -> bool:
    """Whether two numbers (lower-case parts joined by blanks) are one, however written.

    Punctuation, case, order of parts and look-alike characters don't count, nor do leading zeros of a part; words added
    in passing are ignored, and letters may be left out of one of the two. All digits must agree.
    """
    pa_, pb = a.split(), b.split()
    fa, fb = [p.translate(_FOLD) for p in pa_], [p.translate(_FOLD) for p in pb]
    ca, cb = "".join(fa), "".join(fb)
    if ca == cb or spells(fa, cb) or spells(fb, ca):
        return True
    ka, kb = ([p for p in x if p not in INCIDENTAL] for x in (pa_, pb))
    if len(ka) < len(pa_) or len(kb) < len(pb):
        return bool(ka and kb) and same_invoice_number(" ".join(ka), " ".join(kb))
    (la, da), (lb, db) = _runs(ka), _runs(kb)
    if la and lb and sorted(la) != sorted(lb):
        return False
    sa, sb = ([s for d in x if (s := d.lstrip("0"))] for x in (da, db))
    if not sa or not sb:
        return False
    return sorted(sa) == sorted(sb) or _zeroless(sa, "".join(db)) or _zeroless(sb, "".join(da))


def number_form(no: Column) -> Column:
    """Lower-case parts joined by blanks."""
    return F.trim(F.regexp_replace(F.lower(no), r"[^\p{L}\p{N}]+", " "))


def usable_rows(invoices: DataFrame) -> DataFrame:
    """Rows that can be cases: (id, vendor_name, form, amount, batch_no)."""
    usable = ~missing(F.col("vendor_name")) & ~missing(F.col("invoice_no")) & (F.col("amount") != 0) & F.col("batch_no").isNotNull()
    return invoices.where(usable).select("id", "vendor_name", number_form(F.col("invoice_no")).alias("form"), "amount", "batch_no")


def record_of() -> Column:
    return F.xxhash64("vendor", "form", "amount")


def _band(amount: Column) -> Column:
    return F.floor(F.log(F.abs(amount.cast("double"))) / BAND).cast("int")


def _key(vendor: str = "vendor") -> Column:
    return F.xxhash64(vendor, F.signum("amount"), "band", "h")


_CHUNKS = "array<struct<stream:int,h:bigint,n:int,total:int>>"


def _chunked(records: DataFrame) -> DataFrame:
    """Adds ``chunks``: those of all streams of ``form``."""
    names = records.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"stream": i, "h": h, "n": n, "total": total} for i, held in enumerate(streams) for total in (sum(held.values()),) for h, n in held.items()]
                for streams in chunks_of(batch.column("form").to_pylist())
            ]
            kind = pa.list_(pa.struct([("stream", pa.int32()), ("h", pa.int64()), ("n", pa.int32()), ("total", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*names, "chunks"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    return records.mapInArrow(run, f"{schema}, chunks {_CHUNKS}")


def _compared(pairs: DataFrame) -> DataFrame:
    """(record, first_batch) of the pairs (record, form, other_form, first_batch) covered enough and equal by comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = batch.column("form").to_pylist(), batch.column("other_form").to_pylist()
            forms = list(dict.fromkeys(mine + other))
            chunks = dict(zip(forms, chunks_of(forms)))
            keep = pa.array([a == b or coverage(chunks[a], chunks[b]) >= COVERAGE and same_invoice_number(a, b) for a, b in zip(mine, other)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("record").filter(keep), batch.column("first_batch").filter(keep)], names=["record", "first_batch"])

    return pairs.select("record", "form", "other_form", "first_batch").mapInArrow(run, "record bigint, first_batch int")


class ChunkIndex:
    """The persistent tables of accepted records, in ``path`` (a folder all executors share).

    ``names``: (vendor_name, vendor), the vendor's number that a name got when it was first seen and keeps;
    ``records``: (record, vendor, form, amount, first_batch); ``chunks``: (key, record); ``counts``: (key, listed), how
    many records a key got. Each batch adds a version of each, none is ever rewritten. The pointer COMMITS names the
    versions that count and is replaced in one step: a batch is in all of the tables or in none, and what a run that
    died has left behind is never read. Within a version rows lie in the order of their keys.

    Vendors may be found to be one later on: ``learn`` takes the classes of all names, each class keeps the smallest of
    its names' numbers for new records, and records accepted under any of them are found.
    """

    SCHEMAS = {
        "names": "vendor_name string, vendor bigint", "records": "record bigint, vendor bigint, form string, amount bigint, first_batch int",
        "chunks": "key bigint, record bigint", "counts": "key bigint, listed bigint",
    }

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)
        self.scratch = Scratch(spark, "lookup")
        self.vendors: DataFrame | None = None
        self.known_as: DataFrame | None = None

    def _commits(self) -> dict[str, list[str]]:
        return self.store.published("COMMITS") or {"names": [], "versions": []}

    def _table(self, name: str) -> DataFrame:
        """Committed rows of a table."""
        commits, schema = self._commits(), self.SCHEMAS[name]
        paths = [f"{self.path}/{name}/{v}" for v in commits["names" if name == "names" else "versions"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def learn(self, classes: DataFrame) -> None:
        """Take note of all names known by now: ``classes`` has each name (vendor_name) and its vendor by any label."""
        known = self._table("names").withColumnRenamed("vendor", "number")
        named = classes.select("vendor_name", "vendor").join(known, "vendor_name", "left")
        named = self.scratch.keep(named)
        held = named.where("number is not null").select("vendor", "number").distinct()
        own = named.groupBy("vendor").agg(F.coalesce(F.min("number"), F.xxhash64("vendor")).alias("own"))
        vendors = self.scratch.keep(named.join(own, "vendor").select("vendor_name", F.col("own").alias("vendor"), "number"))
        fresh, seen = vendors.where("number is null").select("vendor_name", "vendor"), uuid.uuid4().hex
        fresh.write.parquet(f"{self.path}/names/{seen}")
        commits = self._commits()
        self.store.publish("COMMITS", commits | {"names": [*commits["names"], seen]})
        self.vendors = vendors.select("vendor_name", "vendor")
        # numbers under which records of a vendor may have been accepted
        self.known_as = self.scratch.keep(held.join(own, "vendor").select(F.col("own").alias("vendor"), "number").unionByName(own.select(F.col("own").alias("vendor"), F.col("own").alias("number"))).distinct())

    def numbered(self, rows: DataFrame) -> DataFrame:
        """Rows with a vendor_name that ``learn`` has met: ``vendor`` in its place."""
        return rows.join(self.vendors, "vendor_name").drop("vendor_name")

    def batch(self, rows: DataFrame) -> tuple[DataFrame, bool]:
        """The different records of ``rows`` (vendor, form, amount, batch_no) with their chunks, kept; whether their keys
        are few enough to be broadcast."""
        distinct = rows.groupBy("vendor", "form", "amount").agg(F.min("batch_no").alias("first_batch"), F.max("batch_no").alias("last_batch"))
        kept, seen = self.scratch.measured(_chunked(distinct.withColumn("record", record_of())), n=F.sum(F.size("chunks")))
        return kept, 2 * (seen["n"] or 0) <= BROADCAST_ROWS

    def append(self, batch: DataFrame, few: bool = False) -> None:
        """Accept the records of a batch (see ``batch``) that aren't accepted yet. It costs what the batch brings in.

        A batch that is appended again adds nothing; one whose run died before the pointer moved counts as never appended.
        """
        version, commits = uuid.uuid4().hex, self._commits()
        new = batch
        if commits["versions"]:
            asked = batch.select("record")
            known = self._table("records").select("record").join(F.broadcast(asked) if few else asked, "record", "left_semi")
            new = batch.join(known, "record", "left_anti")
        path = {t: f"{self.path}/{t}/{version}" for t in ("records", "chunks", "counts")}
        new.select("record", "vendor", "form", "amount", "first_batch").write.parquet(path["records"])
        entries = new.select("record", "vendor", "amount", _band(F.col("amount")).alias("band"), F.inline("chunks"))
        entries.select(_key().alias("key"), "record").distinct().sortWithinPartitions("key").write.parquet(path["chunks"])
        added = self.spark.read.schema(self.SCHEMAS["chunks"]).parquet(path["chunks"])
        added.groupBy("key").agg(F.count(F.lit(1)).alias("listed")).sortWithinPartitions("key").write.parquet(path["counts"])
        self.store.publish("COMMITS", commits | {"versions": [*commits["versions"], version]})

    def compact(self) -> None:
        """Put all versions together into one, so that a lookup opens few files again. Readers of the old ones go on."""
        version, commits = uuid.uuid4().hex, self._commits()
        self._table("records").write.parquet(f"{self.path}/records/{version}")
        self._table("chunks").repartition("key").sortWithinPartitions("key").write.parquet(f"{self.path}/chunks/{version}")
        counts = self._table("counts").groupBy("key").agg(F.sum("listed").alias("listed"))
        counts.sortWithinPartitions("key").write.parquet(f"{self.path}/counts/{version}")
        self.store.publish("COMMITS", commits | {"versions": [version]})

    def earliest(self, batch: DataFrame, few: bool = False) -> DataFrame:
        """(record, earlier): for each record of a batch (see ``batch``) the first batch in which it or a near record was
        accepted, if that is before its own last one.

        The result reads the versions committed by now, whatever is appended later.
        """
        at = F.log(F.abs(F.col("amount").cast("double"))) / BAND
        beside = F.when(at - F.floor(at) < 0.5, _band(F.col("amount")) - 1).otherwise(_band(F.col("amount")) + 1)
        asked = batch.join(self.known_as, "vendor").select("record", "number", "amount", "chunks", F.explode(F.array(_band(F.col("amount")), beside)).alias("band"))
        entries = asked.select("record", "number", "band", "amount", F.inline("chunks")).withColumn("key", _key("number"))
        keys = entries.select("key").distinct()
        counts = self._table("counts").join(F.broadcast(keys) if few else keys, "key", "left_semi")
        listed = counts.groupBy("key").agg(F.sum("listed").alias("listed"))
        # a key that nothing was listed under stays: it is the rarest of all, and leads nowhere
        weighed = entries.join(listed, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
        rarest = F.array_sort(F.collect_list(F.struct(F.when(F.col("listed") <= SHORT_LIST, F.least("listed", F.lit(1))).otherwise(F.col("listed")).alias("listed"), "key", "n")))
        grouped = weighed.groupBy("record", "number", "band", "stream", "total").agg(rarest.alias("c"))
        onwards = F.transform("c", lambda x, i: F.struct(x["key"].alias("key"), F.aggregate(F.slice("c", i + 1, F.size("c")), F.lit(0), lambda s, y: s + y["n"]).alias("onwards"), x["listed"].alias("listed")))
        followed = grouped.select("record", "total", F.inline(onwards)).where((F.col("onwards") >= COVERAGE * F.col("total")) & (F.col("listed") > 0)).select("record", "key").distinct()
        chunks = self._table("chunks").withColumnRenamed("record", "other")
        # kept, so that its size is known when the join with the records is planned
        met = self.scratch.keep(chunks.join(F.broadcast(followed) if few else followed, "key").select("record", "other").distinct())
        others = self._table("records").select(F.col("record").alias("other"), F.col("form").alias("other_form"), F.col("amount").alias("other_amount"), "first_batch")
        pairs = others.join(met, "other").join(batch.select("record", "form", "amount", "last_batch"), "record")
        larger = F.greatest(F.abs("amount"), F.abs("other_amount"))
        close = (F.abs(F.col("amount") - F.col("other_amount")) <= TOLERANCE * larger) & (F.col("first_batch") < F.col("last_batch"))
        return _compared(pairs.where(close)).groupBy("record").agg(F.min("first_batch").alias("earlier"))


def late_duplicates(invoices: DataFrame, classes: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """(id): invoices of batches from 1 on of which an earlier batch has the same vendor, number and amount, or nearly.

    Batch after batch is looked up in the index in ``path`` and then appended to it, first all history (batches up to 0);
    batches of which the index has all records already add nothing, so a run that died can be run again.

    Vendors are compared by their classes (``variants.vendor_classes``), numbers exactly where enough of a stream is
    covered by shared chunks, amounts within one per cent of the larger. Rows in which one of the three is missing, the
    amount is 0 or the batch is null are no cases and match none. A batch never matches itself. No rows give no cases.
    """
    spark = invoices.sparkSession
    scratch = Scratch(spark, "history")
    classes = vendor_classes(invoices) if classes is None else classes
    index = ChunkIndex(spark, path or scratch.path())
    index.learn(classes)
    rows, parts = index.numbered(usable_rows(invoices)).withColumn("batch", F.greatest("batch_no", F.lit(0))), scratch.path()
    rows.write.partitionBy("batch").parquet(parts)
    rows = spark.read.schema("id string, form string, amount bigint, batch_no int, vendor bigint, batch int").parquet(parts)
    found = []
    for (number,) in sorted(rows.select("batch").distinct().collect()):  # one number for each batch
        batch, few = index.batch(rows.where(F.col("batch") == number))
        if number:
            # written round by round: one plan of all rounds would hold all their broadcasts in the driver at once
            found.append(scratch.keep(index.earliest(batch, few).select("record", F.lit(number).alias("batch"))))
        index.append(batch, few)
        index.scratch.release(batch)
    if not found:
        return rows.select("id").where("false")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return rows.where("batch >= 1").withColumn("record", record_of()).join(every, ["record", "batch"]).select("id")
