"""Runs and reports from the command line: ``spark-submit -m tideline COMMAND --warehouse ROOT``.

``ingest`` fills the warehouse from the files that a registry declares; ``detect`` writes signals and evidence beside it; ``snapshot`` tells what was known
about a patient at an instant, ``case`` walks through a patient's decision with its evidence and history; the other commands print figures.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.config import CLINICAL, Profile, profile_of, variants
from tideline.operators.ranges import quantiles
from tideline.plans import audit, export, report, serve
from tideline.plans import sweep as plans
from tideline.plans.ingest import Layout, _files, ingest_registry
from tideline.plans.sweep import Clean
from tideline.sources import integrity
from tideline.sources.adapters import migrated, read_registry
from tideline.sources.stored import scope, stored


#: Columns that tables of older versions lack, with what they were then.
ADDED = {"observations": {"is_availability_known": True}, "signals": {"k": 0, "suppressions": ""}}


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return migrated(spark.read.parquet(f"{root.rstrip('/')}/{name}"), {c: F.lit(v) for c, v in ADDED.get(name, {}).items()})


def _warehouse(spark: SparkSession, root: str) -> plans.Clean:
    files, there = _files(spark, f"{root.rstrip('/')}/clinical_facts")
    facts = _table(spark, root, "clinical_facts") if files.exists(there) else None
    return plans.Clean(_table(spark, root, "observations"), _table(spark, root, "intervals"), facts)


def fill(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """Ingest what the registry declares, and tell each file's verdict and counts."""
    layout = Layout(args.warehouse)
    ingest_registry(spark, args.source, read_registry(args.registry), integrity.official_list(spark, args.official), layout, args.run, args.at)
    manifest = _table(spark, args.warehouse, "ingest_manifest").where(F.col("run_id") == args.run)
    quarantine = _table(spark, args.warehouse, "quarantine").groupBy("source_file", "reject_reason").agg(F.count("*").alias("n"))
    return {"files": manifest.select("source_file", "verdict", "rows_read", "rows_loaded", "rows_quarantined").orderBy("source_file"), "quarantine": quarantine.orderBy("source_file", "reject_reason")}


def known_at(clean: plans.Clean, p: Profile, patient: str, at: str) -> dict[str, DataFrame]:
    """What was known about a patient at an instant: samples by variable, intervals, facts, rows set aside, and what had happened but was not known."""
    own = Clean(*[df.where(F.col("patient_id") == patient) if df is not None else None for df in (clean.observations, clean.intervals, clean.facts)])
    instants = clean.observations.sparkSession.range(1).select(F.lit(patient).alias("patient_id"), F.lit(at).cast("timestamp_ntz").alias("t"))
    parts = plans.snapshot(own, instants, p)
    found = {"observations": parts["observations"].groupBy("variable_code").agg(F.count("*").alias("n"), F.max("event_time").alias("latest"), F.max_by("value_num", "event_time").alias("value")).orderBy("variable_code")}
    hidden = own.observations.where(F.col("event_time") <= F.lit(at).cast("timestamp_ntz")).where(F.col("available_time") > F.lit(at).cast("timestamp_ntz")).where("not is_duplicate")
    return found | {name: parts[name] for name in ("intervals", "facts", "set_aside") if name in parts} | {"hidden": hidden.select("source_file", "record_id", "variable_code", "event_time", "available_time")}


def case(clean: plans.Clean, p: Profile, root: str, patient: str, at: str | None) -> dict[str, DataFrame]:
    """A patient's decision at an instant (by default that of its gravest signal), the evidence of the signal, and the history up to then."""
    spark = clean.observations.sparkSession
    signals, evidence = _table(spark, root, "signals"), _table(spark, root, "evidence")
    own = signals.where(F.col("patient_id") == patient)
    if at is None:
        gravest = own.orderBy(F.desc("risk"), "signal_id").select(F.col("decision_time").cast("string")).first()
        if gravest is None:
            raise serve.NotFound(f"no signal of {patient}")
        at = gravest[0]
    service = serve.Service(clean, signals, evidence, p)
    decision = service.decide(patient, at)
    proof = evidence.join(own.where(F.col("decision_time") == F.lit(at).cast("timestamp_ntz")).select("signal_id"), "signal_id", "left_semi").orderBy("signal_id", "n")
    history = service.history(patient, end=at, cadence_min=60 * p.cadence_h)
    return {"decision": decision.select("t", "priority", "risk", "confidence", "k", "visible", "explanation"), "evidence": proof, "history": history.select("asked", "skipped", "peak", "transitions", "history_mode")}


def detect(clean: plans.Clean, p: Profile, root: str, out: bool) -> dict[str, DataFrame]:
    s = plans.written(plans.sweep(clean, p))
    signals = stored(plans.signals(s), "signals")
    evidence = stored(plans.evidence(s, clean), "evidence")
    if out:
        export.discard_exports(signals.sparkSession, f"{root}/results")
        export.persist(signals, evidence, root)
        export.export_csv(signals, "signals", f"{root}/results")
        export.export_csv(evidence, "evidence", f"{root}/results")
    n = F.count("*").alias("n")
    return {"signals": signals.groupBy("priority").agg(n, F.countDistinct("patient_id").alias("patients"), F.count_if(F.col("suppressions") != "").alias("suppressed")), "channels": s.assessments.groupBy("k").agg(n)}


def metrics(clean: plans.Clean, p: Profile) -> dict[str, DataFrame]:
    s = plans.written(plans.sweep(clean, p))
    signals, evidence = stored(plans.signals(s), "signals"), stored(plans.evidence(s, clean), "evidence")
    marked = audit.markers(signals, clean.observations, clean.intervals)
    hours = audit.anticipation(signals.where(F.col("priority").isin("HIGH", "CRITICAL")), evidence, clean.observations, {c.code: c.direction for c in p.channels}, 24)
    quartiles = quantiles(hours.withColumn("all", F.lit(1)), ("all",), "hours", (0.25, 0.5, 0.75), "hours").select(*[F.round(f"q{i}", 1).alias(name) for i, name in enumerate(("p25", "p50", "p75"))])
    return {"distractors": audit.distractor_impact(marked), "anticipation": quartiles, "late": audit.late_evidence(evidence), "orphans": audit.orphans(signals, evidence), "untraceable": audit.untraceable(evidence, clean.observations, clean.intervals, clean.facts)}


def ablation(clean: plans.Clean, p: Profile) -> dict[str, DataFrame]:
    urgent = F.count_if(F.col("priority").isin("HIGH", "CRITICAL")).alias("urgent")
    return {name: plans.signals(s).agg(F.count("*").alias("signals"), urgent, F.countDistinct("patient_id").alias("patients")) for name, s in plans.sweeps(clean, variants(p)).items()}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tideline")
    parser.add_argument("command", choices=["ingest", "detect", "metrics", "ablation", "report", "snapshot", "case"])
    parser.add_argument("--warehouse", required=True)
    parser.add_argument("--profile", help="a JSON file of settings; the clinical profile by default")
    parser.add_argument("--patients", type=int, help="only the first so many patients by id")
    parser.add_argument("--warmup", type=int, help="hours before the first decision")
    parser.add_argument("--no-export", action="store_true")
    parser.add_argument("--patient", help="snapshot, case: whom to look at")
    parser.add_argument("--at", help="snapshot, case: the instant; ingest: the time of the run")
    for name, what in {"source": "the folder of the files", "registry": "a JSON file that declares them", "official": "the list of their hashes", "run": "a name of the run"}.items():
        parser.add_argument(f"--{name}", help=f"ingest: {what}")
    args = parser.parse_args(argv)
    needed = {"ingest": ("source", "registry", "official", "run", "at"), "snapshot": ("patient", "at"), "case": ("patient",)}.get(args.command, ())
    if missing := [f"--{n}" for n in needed if getattr(args, n) is None]:
        parser.error(f"{args.command} needs {', '.join(missing)}")
    spark = spark or SparkSession.builder.appName("tideline").getOrCreate()
    p = CLINICAL
    if args.profile:
        with open(args.profile, encoding="utf-8") as f:
            p = profile_of(json.load(f))
    if args.warmup is not None:
        p = replace(p, warmup_h=args.warmup)
    clean = _warehouse(spark, args.warehouse) if args.command != "ingest" else None
    if args.patients and clean:
        clean = serve.cohort(clean, args.patients)
    tables = {
        "ingest": lambda: fill(spark, args),
        "snapshot": lambda: known_at(clean, p, args.patient, args.at),
        "case": lambda: case(clean, p, args.warehouse, args.patient, args.at),
        "detect": lambda: detect(clean, p, args.warehouse.rstrip("/"), not args.no_export),
        "metrics": lambda: metrics(clean, p),
        "ablation": lambda: ablation(clean, p),
        "report": lambda: report.ingest_report(clean.observations, clean.intervals),
    }[args.command]
    with scope():
        for name, df in tables().items():
            print(name)
            df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
