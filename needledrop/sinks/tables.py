"""The report as tables: actions with decisions, JSON, and addresses of profile pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needledrop import labels
from needledrop.operators.findings import JOINED

COLUMNS = (
    "type;subtype;confidence;points;action;actionable;impact_scrobbles;current_value;proposed_value;alternatives;signals;decision;evidence".split(";")
)


def label_of(table: dict[str, str], c: Column) -> Column:
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in table.items()), c)


def how_to(action: Column, current: Column, proposed: Column, impact: Column) -> Column:
    """What to do about a finding, from the action's template."""

    def filled(template: str) -> Column:
        values = {"{current}": current, "{proposed}": proposed, "{impact}": F.format_number(impact, 0)}
        parts, rest = [], template
        while rest:
            found = min((k for k in values if k in rest), key=rest.index, default=None)
            if found is None:
                parts.append(F.lit(rest))
                break
            before, rest = rest.split(found, 1)
            parts += [F.lit(before), values[found]]
        return F.concat(*parts)

    return F.coalesce(*(F.when(action == k, filled(t)) for k, t in labels.HOW_TO.items()), F.lit(""))


def with_choices(findings: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """``findings`` with the alternative that ``choices`` (id, value) names in place of the default proposal.

    ``current``, ``proposed`` and ``impact`` follow the choice; a choice that is no alternative of its finding changes nothing.
    """
    if choices is None:
        joined = findings.withColumn("option", F.lit(None).cast("struct<current: string, proposed: string, impact: bigint>"))
    else:
        own = choices.select("id", F.col("value").alias("chosen"))
        joined = findings.join(own, "id", "left").withColumn("option", F.get(F.filter("alternatives", lambda a: a["value"] == F.col("chosen")), F.lit(0))).drop("chosen")
    # an option without a current value stands for all other variants; only the chosen one is written out
    rest = F.array_join(F.transform(F.filter("variants", lambda v: v["value"] != F.col("option.proposed")), lambda v: v["value"]), JOINED)
    swapped = {"current": F.coalesce(F.when(F.col("option").isNotNull(), F.coalesce(F.col("option.current"), rest)), F.col("current"))}
    swapped |= {c: F.coalesce(F.col(f"option.{c}"), F.col(c)) for c in ("proposed", "impact")}
    out = joined.withColumns(swapped).drop("option")
    return out.withColumn("how_to", how_to(F.col("action"), F.col("current"), F.col("proposed"), F.col("impact")))


def actions(findings: DataFrame, decisions: DataFrame | None = None, choices: DataFrame | None = None, omit_discarded: bool = False) -> DataFrame:
    """The table of actions, in the report's order; ``decisions`` (id, decision) defaults to pending."""
    f = with_choices(findings, choices)
    f = f.withColumn("decision", F.lit("pending")) if decisions is None else f.join(decisions.select("id", "decision"), "id", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))
    if omit_discarded:
        f = f.where("decision <> 'discard'")
    joined = lambda c, part: F.array_join(F.transform(c, lambda x: x[part]), " | ")
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(": ", e["a"], e["b"])), " | ")
    return f.select(
        "place", "type", "subtype", "confidence", "points", label_of(labels.ACTIONS, F.col("action")).alias("action"),
        F.when(F.col("actionable"), "yes").otherwise("no").alias("actionable"), F.col("impact").alias("impact_scrobbles"),
        F.col("current").alias("current_value"), F.col("proposed").alias("proposed_value"),
        joined("alternatives", "value").alias("alternatives"), joined("signals", "text").alias("signals"), "decision", evidence.alias("evidence"),
    )


def write_csv(findings: DataFrame, path: str, **options) -> None:
    """The actions as ;-separated files with a header, in the report's order."""
    rows = actions(findings, **options).orderBy("place").select(*COLUMNS)
    rows.write.csv(path, sep=";", header=True, quote='"', escape='"')


def write_json(findings: DataFrame, path: str) -> None:
    findings.drop("marks", "detector", "seen").orderBy("place").write.json(path)


def segment(c: Column) -> Column:
    """One part of an address's path: percent-encoded, spaces as +."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def profile_url(base: str, user: Column, target: Column) -> Column:
    """The page of a target (artist, track or album) in a user's library below ``base``; empty without a user or artist."""
    own = F.concat(F.lit(base.rstrip("/") + "/"), segment(user), F.lit("/library/music/"), segment(target["artist"]))
    full = (
        F.when(target["track"].isNotNull(), F.concat(own, F.lit("/_/"), segment(target["track"])))
        .when(target["album"].isNotNull(), F.concat(own, F.lit("/"), segment(target["album"])))
        .otherwise(own)
    )
    missing = (F.coalesce(user, F.lit("")) == "") | (F.coalesce(target["artist"], F.lit("")) == "")
    return F.when(missing, "").otherwise(full)


def profile_urls(findings: DataFrame, base: str, user: str) -> DataFrame:
    """(place, label, url) of every target of every finding."""
    t = findings.select("place", F.explode("targets").alias("t"))
    return t.select("place", F.concat_ws(" — ", "t.artist", F.coalesce("t.track", "t.album")).alias("label"), profile_url(base, F.lit(user), F.col("t")).alias("url"))
