"""Wording of decisions as columns: findings, references, plain sentences, and the check of texts that somebody else wrote, for any number of decisions.

It says after the fact what an assessment (with its ``channels`` and their samples) found; no score depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import text
from tideline.plans.narrative import FORBIDDEN, MOST_REFS

#: What counts as a number of a text's own; codes such as SpO2 do not.
NUMBER = r"(?<![A-Za-z])\d+(?:[.,]\d+)?(?![A-Za-z])"
MOST_FINDINGS, MOST_POINTS = 5, 3


def findings(units: dict[str, str] | None = None, most: int = MOST_FINDINGS) -> Column:
    """The live channels of ``channels``, highest score first, as structs of what a page shows of them, with the records of their samples."""
    ranked = F.expr("array_sort(filter(channels, c -> c.score > 0), (a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 else a.place - b.place end)")
    of = F.create_map(*[F.lit(x) for pair in (units or {}).items() for x in pair]) if units else None

    def one(c: Column) -> Column:
        latest = F.element_at(c["evidence"], -1)["value"]
        unit = F.coalesce(of[c["variable_code"]], F.lit("")) if of is not None else F.lit("")
        direction = F.when(latest >= c["centre"], "rise").otherwise("fall")
        refs = F.array_distinct(F.transform(c["evidence"], lambda e: e["record_id"]))
        return F.struct(c["variable_code"].alias("variable"), unit.alias("unit"), c["centre"].alias("baseline"), latest.alias("latest"), direction.alias("direction"), c["score"].alias("score"), c["persistence"].alias("persistence"), c["coverage"].alias("coverage"), refs.alias("refs"))

    return F.transform(F.slice(ranked, 1, most), one)


def worded(assessments: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """``assessments(k, channels, lab_n, rules, ...)`` with ``findings``, ``allowed`` references, and the plain ``summary``, ``review`` (three points at most) and ``refs``."""
    rows = assessments.withColumn("findings", findings(units)).withColumn("allowed", F.array_distinct(F.flatten(F.transform("findings", lambda f: f["refs"]))))
    names = F.transform("findings", lambda f: f["variable"])
    summary = (
        F.when(F.col("k") >= 2, text("Several channels move together away from their own baseline: ", F.array_join(names, ", "), "."))
        .when(F.size("findings") > 0, text("One pattern stands out against its own baseline: ", F.get(names, F.lit(0)), "."))
        .otherwise("No channel leaves its own baseline.")
    )
    noted = F.array_join(F.transform("rules", lambda r: r["rule"]), ", ")
    points = F.concat(
        F.transform(names, lambda n: text("Review the course of ", n, ".")),
        F.when(F.col("lab_n") > 0, F.array(F.lit("Review the laboratory values out of range."))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("rules") > 0, F.array(text("Consider what was noted: ", noted, "."))).otherwise(F.array().cast("array<string>")),
    )
    return rows.withColumn("summary", summary).withColumn("review", F.slice(points, 1, MOST_POINTS)).withColumn("refs", F.slice("allowed", 1, MOST_REFS))


def history_worded(histories: DataFrame) -> DataFrame:
    """``histories(current, peak, transitions)``, as ``Service.history`` gives them, with the plain ``summary`` and ``review``."""
    now, peak = F.col("current.priority"), F.col("peak.priority")
    summary = F.when(now == peak, text("The course closes at its peak, ", now, ".")).otherwise(text("The course peaked at ", peak, " and closes at ", now, "."))
    moved = F.coalesce(F.size("transitions"), F.lit(0)) > 1
    return histories.withColumn("summary", summary).withColumn("review", F.when(moved, F.array(F.lit("Review the changes of priority."))).otherwise(F.array().cast("array<string>")))


def checked(decisions: DataFrame, texts: DataFrame, key: tuple[str, ...] = ("patient_id", "t"), forbidden: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """``worded`` decisions with the ``texts(*key, summary, review, refs)`` that somebody wrote where these pass, else the plain ones, and why not.

    ``fault`` is the first that holds: incomplete (no summary), forbidden (a wording that a text must not use), number (one of its own), reference (to what the
    decision does not rest on), references (too many); null where there is no text or it passes.  ``source`` is generated or plain.  A text without
    references gets the first that are allowed; of several texts for a decision the least counts.
    """
    given = F.struct("summary", F.coalesce("review", F.array().cast("array<string>")).alias("review"), F.array_distinct(F.coalesce("refs", F.array().cast("array<string>"))).alias("refs"))
    one = texts.groupBy(*key).agg(F.min(given).alias("given"))
    rows = decisions.join(one, list(key), "left")
    said = F.concat_ws(" ", F.col("given.summary"), F.array_join("given.review", " "))
    fault = (
        F.when(F.col("given").isNull(), None)
        .when(F.col("given.summary").isNull(), "incomplete")
        .when(said.rlike(r"(?i)\b(" + "|".join(forbidden) + ")"), "forbidden")
        .when(said.rlike(NUMBER), "number")
        .when(F.size(F.array_except("given.refs", "allowed")) > 0, "reference")
        .when(F.size("given.refs") > MOST_REFS, "references")
    )
    rows = rows.withColumn("fault", fault).withColumn("source", F.when(F.col("given").isNotNull() & fault.isNull(), "generated").otherwise("plain"))
    kept = F.col("source") == "generated"
    refs = F.when(kept & (F.size("given.refs") > 0), F.col("given.refs")).otherwise(F.slice("allowed", 1, MOST_REFS))
    return rows.withColumn("summary", F.when(kept, F.col("given.summary")).otherwise(F.col("summary"))).withColumn("review", F.when(kept, F.col("given.review")).otherwise(F.col("review"))).withColumn("refs", refs).drop("given")
