"""Command line: generate, detect, evaluate, ingest, tune."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import functions as F

from tallyline.operators import evaluation as E
from tallyline.operators import matching as M
from tallyline.operators import review as R
from tallyline.operators import tuning as L
from tallyline.plans.session import local_session
from tallyline.sources import documents, images, jsonl, synthetic
from tallyline.sources.store import Store
from tallyline.streaming import ingest


#: Tables of a workspace.
TABLES = ("invoices", "pairs", "decisions", "models", "audit")


def _config(a: argparse.Namespace) -> M.ScoringConfig:
    return M.ScoringConfig(flag_threshold=a.flag_threshold, review_threshold=a.review_threshold, reinvoice_window_days=a.reinvoice_window)


def _loaded(spark, path: str):
    return jsonl.read_invoices(spark, path).withColumn("created_at", F.lit(None).cast("timestamp"))


def _report(inv, pairs, a) -> None:
    E.evaluate(inv, pairs, a.flag_threshold, a.review_threshold).show(truncate=False)
    E.recall_by_variant(inv, pairs, a.flag_threshold).orderBy("variant").show()
    E.sweep(inv, pairs).orderBy("threshold").show()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tallyline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, scoring: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        if scoring:
            c.add_argument("--flag-threshold", type=float, default=0.90)
            c.add_argument("--review-threshold", type=float, default=0.70)
            c.add_argument("--reinvoice-window", type=int, default=14)
        return c

    for name in ("generate", "demo"):
        c = command(name, *(["out"] if name == "generate" else []), scoring=name == "demo")
        c.add_argument("-n", type=int, default=10_000)
        c.add_argument("--dup-rate", type=float, default=0.02)
        c.add_argument("--seed", type=int, default=42)
    command("run", "invoices", "out", scoring=True)
    command("evaluate", "invoices", "pairs", scoring=True)
    command("init-db", "root")
    c = command("seed-demo", "root", scoring=True)
    c.add_argument("-n", type=int, default=10_000)
    c.add_argument("--dup-rate", type=float, default=0.02)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--reset", action="store_true")
    command("simulate-feedback", "root")
    c = command("tune", "root", scoring=True)
    c.add_argument("--epochs", type=int, default=30_000)
    c.add_argument("--no-apply", action="store_true")
    c.add_argument("--reset", action="store_true")
    command("ingest", "inbox", "root", scoring=True)
    for name in ("make-pdf", "make-photo"):
        c = command(name, "out")
        for f, default in (("vendor", "Northwind Logistics, Ltd."), ("invoice-no", "INV-2024/0001"), ("date", "2024-03-14"), ("amount", "12,345.00"), ("tax-id", "12-3456789-401")):
            c.add_argument(f"--{f}", default=default)
    a = p.parse_args(argv)
    if a.command == "make-photo":
        Path(a.out).write_bytes(images.make_photo(a.vendor, a.invoice_no, a.date, a.amount, a.tax_id))
        return 0
    if a.command == "make-pdf":
        Path(a.out).write_bytes(documents.make_pdf(images.labelled(a.vendor, a.invoice_no, a.date, a.amount, a.tax_id)))
        return 0
    spark = local_session()
    if a.command == "generate":
        jsonl.write_invoices(synthetic.generate(spark, a.n, a.dup_rate, a.seed), a.out, "overwrite")
    elif a.command == "demo":
        inv = synthetic.generate(spark, a.n, a.dup_rate, a.seed)
        found = M.detect(inv, _config(a))
        found.stats.show(truncate=False)
        _report(inv, found.pairs, a)
    elif a.command == "run":
        found = M.detect(_loaded(spark, a.invoices), _config(a))
        jsonl.write_pairs(found.pairs, a.out, "overwrite")
        found.stats.show(truncate=False)
    elif a.command == "evaluate":
        _report(_loaded(spark, a.invoices), jsonl.read_pairs(spark, a.pairs), a)
    elif a.command in ("init-db", "seed-demo", "simulate-feedback", "tune"):
        return _workspace(Store(spark, a.root), a)
    elif a.command == "ingest":
        ingest.run(spark, a.inbox, a.root, once=True, config=_config(a))
    return 0


def _workspace(store: Store, a: argparse.Namespace) -> int:
    """Commands on the tables of a workspace; 1 if what a command needs isn't there."""
    if a.command == "init-db":
        store.init(*TABLES)
        return 0
    inv = store.read("invoices", f"{jsonl.INVOICE}, created_at timestamp")
    if a.command == "seed-demo":
        if a.reset:
            store.clear("invoices", "pairs", "decisions", "audit")
        elif not inv.isEmpty():
            print("there are invoices already; --reset replaces them")
            return 1
        store.append("invoices", synthetic.generate(store.spark, a.n, a.dup_rate, a.seed).select(*inv.columns))
        inv = store.read("invoices", f"{jsonl.INVOICE}, created_at timestamp")
        found = M.detect(inv, _config(a))
        store.replace("pairs", found.pairs)
        found.stats.show(truncate=False)
        return 0
    if inv.isEmpty():
        print("there are no invoices; seed-demo makes some")
        return 1
    if a.command == "simulate-feedback":
        rows = R.simulated_decisions(inv, store.read("pairs", jsonl.PAIR)).withColumn("decided_at", F.current_timestamp())
        store.append("decisions", rows)
        R.counts_by(rows, "decision").show()
        return 0
    pairs = M.detect(inv, _config(a)).pairs
    if a.reset:
        print("the model was put aside" if L.reset(store, pairs) else "no model was active")
        return 0
    try:
        done = L.tune(store, inv, pairs, R.latest_decisions(store.read("decisions", R.DECISION_LOG)), f"tune-{uuid.uuid4().hex[:8]}", not a.no_apply, a.epochs)
    except ValueError as refused:
        print(refused)
        return 1
    print(json.dumps({"model": asdict(done.model), "before": done.before, "after": done.after, "rule_fires": done.rule_fires, "no_longer_passed": done.no_longer_passed, "applied": not a.no_apply}, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
