"""The report and the list of accepted work as Markdown: whole, written by partitions, or a bounded digest as a string."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needledrop import labels
from needledrop.plans.order import first_by
from needledrop.plans.report import Audit
from needledrop.sinks.tables import label_of, profile_url, with_choices

#: Findings of a type that are shown; the rest is counted.
SHOWN = 60


def _top(findings: DataFrame, order: list, most: int) -> list:
    """The first findings of each type by ``order``, in the report's order of types."""
    w = Window.partitionBy("type").orderBy(*order)
    first = findings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    columns = ["type", "rank", "subtype", "title", "points", "confidence", "impact", "current", "proposed", "how_to", "warning", "actionable"]
    more = [F.col("signals.text").alias("signals"), F.col("urls") if "urls" in first.columns else F.array().cast("array<string>").alias("urls")]
    types = list(labels.TYPES)
    return sorted(first.select(*columns, *more).collect(), key=lambda r: (types.index(r["type"]), r["rank"]))


def _escaped(text: str) -> str:
    return text.replace("|", "\\|").replace("\n", " ")


def _linked(findings: DataFrame, base: str | None, user: str | None) -> DataFrame:
    if not (base and user):
        return findings
    return findings.withColumn("urls", F.transform("targets", lambda t: profile_url(base, F.lit(user), t)))


def head(audit: Audit) -> str:
    """What the report begins with: the log, the summary by type and what was left out."""
    meta, summary = audit.meta.first(), audit.summary.collect()
    out = ["# Play log report", "", f"- Plays: {meta['plays']:,} ({meta['dated']:,} with a date)"]
    out += [f"- Artists: {meta['artists']:,}; tracks: {meta['tracks']:,}; albums: {meta['albums']:,}"]
    out += [f"- Plays touched by a finding: {audit.affected.count():,}", "", "| Section | Findings | Plays | High | Medium | Low | To do |", "|-|-|-|-|-|-|-|"]
    out += ["| " + " | ".join(str(r[c]) for c in ("label", "findings", "impact", "high", "medium", "low", "actionable")) + " |" for r in summary]
    out += ["", "Rules: " + ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in asdict(audit.rules).items()) + "."]
    out += ["", "Left out: " + ", ".join(f"{k.replace('_', ' ')} {v:,}" for k, v in audit.trimmed.items()) + "."]
    return "\n".join(out) + "\n"


def markdown(audit: Audit, base: str | None = None, user: str | None = None, most: int = SHOWN) -> str:
    """A digest: the head and the first findings of each type; links only with a base address and a user."""
    totals, out, section = {r["type"]: r["findings"] for r in audit.summary.collect()}, [head(audit).rstrip()], None
    for r in _top(_linked(with_choices(audit.findings), base, user), [F.col("place")], most):
        if r["type"] != section:
            section = r["type"]
            out += ["", f"## {labels.TYPES[section]}"]
            if totals[section] > most:
                out += ["", f"The first {most} of {totals[section]:,}."]
        out += ["", f"### {_escaped(r['title'])}", "", f"*{labels.SUBTYPES[section, r['subtype']]}* · {r['points']}/100 ({r['confidence']}) · {r['impact']:,} play(s)", ""]
        out += [f"- {s}" for s in r["signals"]]
        out += [f"- {r['how_to']}"] + [f"- {r['warning']}"] * bool(r["warning"]) + [f"- <{u}>" for u in r["urls"] if u]
    return "\n".join(out) + "\n"


def blocks(audit: Audit, base: str | None = None, user: str | None = None) -> DataFrame:
    """(place, value): the Markdown of every finding, under its type's heading, with its evidence, in the report's order.

    Of long evidence, as many items are shown as the rules say, tables excepted, and the rest is counted.
    """
    f = _linked(with_choices(audit.findings), base, user)
    firsts = f.groupBy("type").agg(F.min("place").alias("first"))  # one row for each type
    f = f.join(F.broadcast(firsts), "type")
    escaped = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    heading = F.when(F.col("place") == F.col("first"), F.concat(F.lit("## "), label_of(labels.TYPES, F.col("type")), F.lit("\n")))
    kinds = {f"{a}:{b}": v for (a, b), v in labels.SUBTYPES.items()}
    kind = F.concat(F.lit("*"), label_of(kinds, F.concat_ws(":", "type", "subtype")), F.lit("* · "), F.col("points").cast("string"), F.lit("/100 ("), "confidence", F.lit(") · "), F.format_number("impact", 0), F.lit(" play(s)\n"))
    why = F.when(F.col("explanation") != "", F.concat(escaped(F.col("explanation")), F.lit("\n")))
    items = lambda c, of: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), escaped(of(x)))), "\n")
    more = F.when(F.col("beyond") > 0, F.concat(F.lit("- and "), F.format_number("beyond", 0), F.lit(" more")))
    parts = [
        heading, F.concat(F.lit("### "), escaped(F.col("title")), F.lit("\n")), kind, why, items(F.col("signals"), lambda x: x["text"]),
        items(F.col("evidence"), lambda x: F.concat_ws(": ", x["a"], x["b"])), more,
        F.when(F.col("how_to") != "", F.concat(F.lit("- "), "how_to")), F.when(F.col("warning") != "", F.concat(F.lit("- "), "warning")),
        *([items(F.filter("urls", lambda u: u != ""), lambda u: F.concat(F.lit("<"), u, F.lit(">")))] if base and user else []),
    ]
    said = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n")
    return f.select("place", F.concat(said, F.lit("\n")).alias("value"))


def write_markdown(audit: Audit, path: str, base: str | None = None, user: str | None = None) -> None:
    """The whole report below ``path``: ``head`` with the summary, and ``findings`` by partitions, in order of their file names."""
    spark = audit.findings.sparkSession
    spark.createDataFrame([(head(audit),)], "value string").coalesce(1).write.text(f"{path}/head")
    blocks(audit, base, user).orderBy("place").select("value").write.text(f"{path}/findings")


def report_lines(audit: Audit) -> DataFrame:
    """(place, value): the whole report as the lines of one JSON document, a finding in each; read in order they are the document.

    The head holds meta, rules, summary and what was left out; findings come in the report's order, each written where it is.
    """
    spark, f = audit.findings.sparkSession, with_choices(audit.findings)
    n = f.count()
    meta, summary = audit.meta.first().asDict(), [r.asDict() for r in audit.summary.collect()]  # one row, and one for each type
    start = json.dumps({"meta": meta, "rules": asdict(audit.rules), "summary": summary, "trimmed": audit.trimmed}, ensure_ascii=False)
    ends = spark.createDataFrame([(-1, start[:-1] + ', "findings": ['), (n, "]}")], "place bigint, value string")
    names = {"typeLabel": label_of(labels.TYPES, F.col("type")), "actionLabel": label_of(labels.ACTIONS, F.col("action")), "howTo": F.col("how_to")}
    kept = ["id", "type", "subtype", "title", "points", "confidence", "impact", "action", "actionable", "informational", "current", "proposed", "warning", "explanation"]
    lists = ["signals", "alternatives", "variants", "targets", "evidence", "beyond"]
    whole = F.to_json(F.struct(*kept, *(c.alias(k) for k, c in names.items()), *lists), {"ignoreNullFields": "false"})
    return f.select("place", F.concat(whole, F.when(F.col("place") < n - 1, ",").otherwise("")).alias("value")).unionByName(ends)


def write_report_json(audit: Audit, path: str) -> None:
    """The whole report as one JSON document in the files of a folder, in order of their names; sorted and written by ranges."""
    report_lines(audit).orderBy("place").select("value").write.text(path)


def work_blocks(audit: Audit, decisions: DataFrame, choices: DataFrame | None = None, base: str | None = None, user: str | None = None) -> DataFrame:
    """(type_place, less, place, value): a line for each accepted finding, by type, those with most plays first."""
    accepted = audit.findings.join(decisions.where("decision = 'accept'").select("id"), "id", "left_semi")
    f = _linked(with_choices(accepted, choices), base, user)
    place = F.array_position(F.array(*map(F.lit, labels.TYPES)), F.col("type")).alias("type_place")
    order = [F.col("impact").desc(), F.col("points").desc(), F.col("place")]
    first = first_by(f.select("type", "impact", "points", "place"), ["type"], order).select("type", F.col("place").alias("first"))  # one row for each type
    f = f.join(F.broadcast(first), "type")
    heading = F.when(F.col("place") == F.col("first"), F.concat(F.lit("\n## "), label_of(labels.TYPES, F.col("type")), F.lit("\n\n"))).otherwise("")
    links = F.array_join(F.transform(F.filter("urls", lambda u: u != ""), lambda u: F.concat(F.lit("\n  <"), u, F.lit(">"))), "") if base and user else F.lit("")
    line = F.concat(heading, F.lit("- [ ] "), "current", F.lit(" → "), "proposed", F.lit(" ("), F.format_number("impact", 0), F.lit(" play(s)). "), "how_to", links)
    return f.select(place, (-F.col("impact")).alias("less"), (-F.col("points")).alias("fewer"), "place", line.alias("value"))


def write_worklist(audit: Audit, path: str, decisions: DataFrame, choices: DataFrame | None = None, base: str | None = None, user: str | None = None) -> None:
    """The whole work list as Markdown in the files of a folder, in order of their names; nothing is gathered."""
    rows = work_blocks(audit, decisions, choices, base, user)
    rows.orderBy("type_place", "less", "fewer", "place").select("value").write.text(path)


def worklist(audit: Audit, decisions: DataFrame, choices: DataFrame | None = None, base: str | None = None, user: str | None = None, most: int = SHOWN) -> str:
    """A digest: the first ``most`` accepted findings of each type, those with most plays first, and how many there are beyond.

    ``decisions`` has (id, decision). ``write_worklist`` writes all of them.
    """
    accepted = audit.findings.join(decisions.where("decision = 'accept'").select("id"), "id", "left_semi")
    rows = _top(_linked(with_choices(accepted, choices), base, user), [F.col("impact").desc(), F.col("points").desc(), F.col("place")], most)
    beyond = {r["type"]: r["count"] - most for r in accepted.groupBy("type").count().collect()}
    out, section = ["# Work list"], None
    for r in rows:
        if r["type"] != section:
            section = r["type"]
            out += ["", f"## {labels.TYPES[section]}", ""]
            if beyond.get(section, 0) > 0:
                out += [f"The first {most:,}; {beyond[section]:,} more are not shown.", ""]
        out += [f"- [ ] {r['current']} → {r['proposed']} ({r['impact']:,} play(s)). {r['how_to']}"] + [f"  <{u}>" for u in r["urls"] if u]
    return "\n".join(out if rows else [*out, "", "Nothing has been accepted."]) + "\n"
