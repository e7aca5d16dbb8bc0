"""The audit on small logs, one artist or pair of artists for each case, all in one run."""

import pytest
from pyspark.sql import functions as F

from needledrop import labels
from needledrop.plans.index import Index
from needledrop.plans.report import Audit
from needledrop.plans.storage import written
from needledrop.rules import Rules
from needledrop.sinks import render, tables
from needledrop.sources.plays import read_csv

BASE = 1_700_000_000
CURLY, LETTER = "\u2019", "\u02bc"


def rows():
    """(artist, album, title, offset); cases are a million seconds apart."""
    out, at = [], 0

    def case(*plays):
        nonlocal at
        out.extend((a, b, t, at + o) for a, b, t, o in plays)
        at += 1_000_000

    many = lambda a, b, t, n, o=0: [(a, b, t, o + 5_000 * i) for i in range(n)]
    case(*(("Repeat One", "X", "Song", o) for o in (0, 10, 20, 500, 510)))
    case(("Repeat Two", "X", "One", 0), ("Repeat Two", "X", "Two", 5), ("Repeat Two", "X", "One", 40))
    case(("Repeat Three", "X", "Song", 0), ("Repeat Three", "X", "Song", 60), ("Repeat Three", "X", "Song", 121))
    case(*many("Jana Burceska", "X", "Aria", 5), *many("Jana Bur\u010deska", "X", "Aria", 2, 400_000))
    case(("Badge", "X", "Melody", 0), *many("Badge", "X", "Melody (Official Video)", 2, 100_000))
    case(("Prefix", "X", "Prefix - Tune", 0), *many("Prefix", "X", "Tune", 2, 100_000))
    case(("Zo\u00eb", "Album", "Loin d'ici", 0), ("Zo\u00eb", "Album", f"Loin d{CURLY}ici", 100_000))
    case(("Letter", "Album", "Loin d'ici", 0), ("Letter", "Album", f"Loin d{LETTER}ici", 100_000))
    case(("Guns N' Roses", "X", "Ballad", 0), (f"Guns N{CURLY} Roses", "X", "Ballad", 100_000))
    case(("Albums", "Loin d'ici", "One", 0), ("Albums", f"Loin d{CURLY}ici", "Two", 100_000))
    edit = "Eurovision's Dancebreak Edit"
    case(*many("Chanel", "X", "SloMo", 10), *many("Chanel", "X", f"SloMo ({edit})", 5, 100_000), *many("Chanel", "X", f"SloMo - {edit}", 1, 200_000))
    case(*many("Swap", "X", "Road (Esc Version)", 14), *many("Swap", "X", "Road - ESC Version", 9, 200_000))
    case(*many("Ana Lima", "X", "Duet", 30), *many("Ana Lima, Bruno", "X", "Duet", 2, 300_000))
    case(*many("Holes", "Real Album", "Filled", 4), *many("Holes", "", "Filled", 3, 100_000))
    case(*many("Clash", "First", "Both", 5), *many("Clash", "Second", "Both", 4, 100_000))
    case(*many("Typist", "X", "Patata", 6), *many("Typist", "X", "Patataa", 1, 100_000), *many("Typist", "X", "Lugar I", 5, 200_000), *many("Typist", "X", "Lugar II", 1, 300_000))
    case(*many("Frequent Name", "X", "Shared", 25), *many("Frequent Nam", "X", "Shared", 1, 400_000))
    case(*many("Cris Lora", "X", "Mine", 6), *many("Cristina Lora", "X", "Mine", 4, 400_000))
    case(("Unknown Artist", "", "Lost", 0))
    return out


@pytest.fixture(scope="module")
def audit(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "log.csv"
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    lines = ["Artist;Album;Track;Date"] + [";".join([quoted(a), quoted(b), quoted(t), str(BASE + o)]) for a, b, t, o in rows()]
    path.write_text("\ufeff" + "\n".join(lines) + "\n", encoding="utf-8")
    plays, warnings = read_csv(spark, str(path))
    assert warnings == []
    return Audit(Index(written(plays, "plays")), Rules().override(minimum_confidence="low", unknown=1))


@pytest.fixture(scope="module")
def found(audit):
    return audit.findings.orderBy("place").collect()


def of(found, kind, subtype=None, text=""):
    return [f for f in found if f["type"] == kind and subtype in (None, f["subtype"]) and text in f["title"] + f["current"] + f["proposed"]]


def test_reads_all(audit, found):
    assert audit.meta.first()["plays"] == len(rows()) == audit.meta.first()["dated"]
    assert [f["place"] for f in found] == list(range(len(found)))
    assert len({f["id"] for f in found}) == len(found)
    assert all((f["type"], f["subtype"]) in labels.SUBTYPES and f["action"] in labels.ACTIONS for f in found)


def test_repeats(found):
    assert sorted(f["impact"] for f in of(found, "duplicate_scrobbles", text="Repeat One")) == [1, 2]
    assert [f["points"] for f in of(found, "duplicate_scrobbles", text="Repeat One")] == [92, 92]
    assert of(found, "duplicate_scrobbles", text="Repeat Two") == []
    three = of(found, "duplicate_scrobbles", text="Repeat Three")
    assert [(f["impact"], f["points"]) for f in three] == [(1, 74)]
    assert "3 times in a row" in of(found, "duplicate_scrobbles", text="Repeat One")[0]["title"]


def test_duplicate_artists(found):
    jana = of(found, "duplicate_artists", "identical", "Burceska")
    assert [(f["proposed"], f["impact"]) for f in jana] == [("Jana Bur\u010deska", 5)]
    assert [a["value"] for a in jana[0]["alternatives"]] == ["Jana Burceska"]
    assert (jana[0]["alternatives"][0]["current"], jana[0]["alternatives"][0]["impact"]) == (None, 2)
    assert [(v["value"], v["canonical"]) for v in jana[0]["variants"]] == [("Jana Burceska", False), ("Jana Bur\u010deska", True)]
    assert [t["artist"] for t in jana[0]["targets"]] == ["Jana Burceska"]
    assert len(of(found, "duplicate_artists", "identical", "Guns N")) == 1
    lora = of(found, "duplicate_artists", "similar_with_tracks", "Cris")
    assert len(lora) == 1 and lora[0]["action"] == "rename_artist"


def test_combined_artists(found):
    f = of(found, "combined_artists")
    assert [(x["current"], x["proposed"], x["impact"]) for x in f] == [("Ana Lima, Bruno", "Ana Lima", 2)]
    assert [a["value"] for a in f[0]["alternatives"]] == ["Bruno"]


def test_titles(found):
    assert [f["proposed"] for f in of(found, "title_variants", "platform_badge")] == ["Melody"]
    assert [f["proposed"] for f in of(found, "artist_in_title")] == ["Tune"]
    formatting = of(found, "title_variants", "formatting")
    assert sorted(f["proposed"] for f in formatting) == ["Loin d'ici", "Loin d'ici"]
    chanel = of(found, "title_variants", text="SloMo")
    assert sorted((f["subtype"], f["impact"], f["actionable"]) for f in chanel) == [("qualifier_formatting", 1, True), ("version_marker", 5, False)]
    version = next(f for f in chanel if f["subtype"] == "version_marker")
    assert version["proposed"] == "SloMo" and " - " not in version["current"]
    typos = of(found, "title_variants", "typo")
    assert [(f["current"], f["proposed"], f["points"]) for f in typos] == [("Patataa", "Patata", 74)]


def test_albums(found):
    assert [(f["proposed"], f["impact"], f["points"]) for f in of(found, "albums", "missing")] == [("Real Album", 3, 92)]
    assert [(f["proposed"], f["impact"], f["actionable"]) for f in of(found, "albums", "clash")] == [("First", 4, False)]
    assert [f["proposed"] for f in of(found, "albums", "name_variants")] == ["Loin d'ici"]


def test_long_tail(found):
    assert ("Frequent Nam", "Frequent Name") in [(f["current"], f["proposed"]) for f in of(found, "long_tail", "possible_typo")]
    assert [f["informational"] for f in of(found, "long_tail", "rare_artists")] == [True]
    hygiene = of(found, "long_tail", "hygiene")[0]
    assert any("generic artist name" in s["text"] for s in hygiene["signals"])


def test_canonical_rules(audit):
    from needledrop.operators import artists

    for rule, kept in (("frequent", "Jana Burceska"), ("recent", "Jana Bur\u010deska")):
        rules = Rules(canonical=rule)
        scored, _ = artists.merge_pairs(audit.index, rules)
        found = artists.duplicate_artists(audit.index, rules, scored, artists.resolutions(audit.index))
        assert [r["proposed"] for r in found.where("current like 'Jana%'").collect()] == [kept]
    assert Rules().canonical == "score"


def test_order_and_summary(audit, found):
    types = list(labels.TYPES)
    keys = [(types.index(f["type"]), ["high", "medium", "low"].index(f["confidence"]), -f["impact"], -f["points"]) for f in found]
    assert keys == sorted(keys)
    summary = audit.summary.collect()
    assert [r["type"] for r in summary] == [t for t in types if of(found, t)]
    assert sum(r["findings"] for r in summary) == len(found)
    strict = Audit(audit.index, Rules())
    strict.__dict__["_all"] = audit._all
    assert strict.findings.where("not informational and points < 40").isEmpty()


def test_affected(audit):
    touched = audit.index.plays.join(audit.affected, "i").groupBy("artist").count().collect()
    n = {r["artist"]: r["count"] for r in touched}
    assert n["Repeat One"] == 3 and n["Holes"] == 3 and n["Clash"] == 4 and "Repeat Two" not in n
    assert n["Chanel"] == 6  # the dash form and the five it stands beside


def test_choices_and_tables(spark, audit, found):
    swap = next(f for f in of(found, "title_variants", text="Road"))
    other = swap["alternatives"][0]
    choices = spark.createDataFrame([(swap["id"], other["value"])], "id string, value string")
    decisions = spark.createDataFrame([(swap["id"], "accept")], "id string, decision string")
    chosen = tables.with_choices(audit.findings, choices).where(F.col("id") == swap["id"]).first()
    assert (chosen["current"], chosen["proposed"], chosen["impact"]) == (other["current"], other["proposed"], other["impact"])
    plain = tables.with_choices(audit.findings).where(F.col("id") == swap["id"]).first()
    assert (plain["current"], plain["proposed"]) == (swap["current"], swap["proposed"])
    table = tables.actions(audit.findings, decisions, choices).where(F.col("place") == swap["place"]).first()
    assert table["decision"] == "accept" and table["proposed_value"] == other["value"]
    assert tables.actions(audit.findings).columns[1:] == list(tables.COLUMNS)
    text = render.worklist(audit, decisions, choices)
    assert other["value"] in text and text.count("- [ ]") == 1


def test_an_option_stands_for_the_other_variants(spark, audit, found):
    jana = of(found, "duplicate_artists", "identical", "Burceska")[0]
    choices = spark.createDataFrame([(jana["id"], "Jana Burceska")], "id string, value string")
    chosen = tables.with_choices(audit.findings, choices).where(F.col("id") == jana["id"]).first()
    assert (chosen["current"], chosen["proposed"], chosen["impact"]) == ("Jana Bur\u010deska", "Jana Burceska", 2)


def test_markdown(audit):
    text = render.markdown(audit)
    assert "## Duplicate artists" in text and "http" not in text
    assert "https://example.org/u/me/library/music/" in render.markdown(audit, "https://example.org/u", "me")


def test_csv_sink(spark, audit, tmp_path):
    tables.write_csv(audit.findings, str(tmp_path / "a"))
    back = spark.read.csv(str(tmp_path / "a"), sep=";", header=True, quote='"', escape='"')
    assert back.columns == list(tables.COLUMNS) and back.count() == audit.findings.count()


def test_urls(spark):
    t = "struct<artist: string, track: string, album: string>"
    cases = [(("A & B", None, "X/Y"), "A+%26+B/X%2FY"), (("Nina", "Song (Live)!*'~", None), "Nina/_/Song+%28Live%29%21%2A%27~"), (("Nina", None, None), "Nina")]
    df = spark.createDataFrame([(a,) for a, _ in cases], f"t {t}")
    got = [r[0] for r in df.select(tables.profile_url("https://x.org/user/", F.lit("me"), F.col("t"))).collect()]
    assert got == ["https://x.org/user/me/library/music/" + e for _, e in cases]
    assert [r[0] for r in df.select(tables.profile_url("https://x.org", F.lit(""), F.col("t"))).collect()] == [""] * 3


def test_whole_markdown(spark, audit, found, tmp_path):
    """Every finding is in the report once, in order, each type under one heading, with its evidence."""
    render.write_markdown(audit, str(tmp_path / "r"))
    text = "".join(open(f).read() for f in sorted(str(p) for p in (tmp_path / "r" / "findings").glob("part-*.txt")))
    assert [x[4:] for x in text.split("\n") if x.startswith("### ")] == [f["title"].replace("|", "\\|").replace("\n", " ") for f in sorted(found, key=lambda f: f["place"])]
    assert text.count("\n## ") + text.startswith("## ") == len({f["type"] for f in found})
    rare = next(f for f in found if f["subtype"] == "rare_artists")
    assert rare["evidence"] and all(f"- {e['a']}: {e['b']}" in text for e in rare["evidence"])
    hygiene = next(f for f in found if f["subtype"] == "hygiene")
    assert any("“" in e["b"] for e in hygiene["evidence"])
    head = "".join(open(p).read() for p in (tmp_path / "r" / "head").glob("part-*.txt"))
    assert head.startswith("# Play log report") and "Left out: " in head


def test_json(spark, audit, found, tmp_path):
    tables.write_json(audit.findings, str(tmp_path / "j"))
    back = spark.read.json(str(tmp_path / "j"))
    assert {(r["place"], r["id"], r["proposed"]) for r in back.collect()} == {(f["place"], f["id"], f["proposed"]) for f in found}


def test_one_json_document(spark, audit, found, tmp_path):
    """The files, one after the other, are one document, with all parts and every finding in order."""
    import json
    from dataclasses import asdict

    render.write_report_json(audit, str(tmp_path / "j"))
    text = "".join(open(f).read() for f in sorted(str(p) for p in (tmp_path / "j").glob("part-*.txt")))
    report = json.loads(text)
    assert report["meta"] == audit.meta.first().asDict() and report["rules"] == asdict(audit.rules) and report["trimmed"] == audit.trimmed
    assert report["summary"] == [r.asDict() for r in audit.summary.collect()]
    want = sorted(found, key=lambda f: f["place"])
    for key in ("id", "title", "points", "impact", "current", "proposed", "warning", "explanation", "confidence", "beyond"):
        assert [f[key] for f in report["findings"]] == [f[key] for f in want]
    assert [[e["a"] for e in f["evidence"]] for f in report["findings"]] == [[e["a"] for e in f["evidence"]] for f in want]
    assert all(f["typeLabel"] == labels.TYPES[f["type"]] and f["actionLabel"] == labels.ACTIONS[f["action"]] for f in report["findings"])


def test_the_whole_work_list(spark, audit, found, tmp_path):
    chosen = [f for f in found if not f["informational"]][::2]
    decisions = spark.createDataFrame([(f["id"], "accept") for f in chosen], "id string, decision string")
    render.write_worklist(audit, str(tmp_path / "w"), decisions)
    text = "".join(open(f).read() for f in sorted(str(p) for p in (tmp_path / "w").glob("part-*.txt")))
    types = list(labels.TYPES)
    want = sorted(chosen, key=lambda f: (types.index(f["type"]), -f["impact"], -f["points"], f["place"]))
    assert [x.split(" (")[0] for x in text.split("\n") if x.startswith("- [ ]")] == [f"- [ ] {f['current']} → {f['proposed']}".split(" (")[0] for f in want]
    assert [x[3:] for x in text.split("\n") if x.startswith("## ")] == [labels.TYPES[t] for t in types if any(f["type"] == t for f in chosen)]


def test_trimmed(audit):
    strict = Audit(audit.index, Rules())
    weak = audit.findings.where("not informational and points < 40").count()
    assert strict.trimmed["omitted"] == weak and audit.trimmed["omitted"] == 0
    assert strict.findings.count() == audit.findings.count() - weak


def test_command_line_leaves_nothing_behind(spark, tmp_path):
    from needledrop.__main__ import main
    from needledrop.plans import storage

    log = tmp_path / "log.csv"
    log.write_text("artist,title,album,date\n" + "".join(f"{a},Song {i},,2020-01-01 10:{i:02d}\n" for i, a in enumerate(["Nina Simone", "nina simone"] * 6)))
    before = set(storage._known)
    with storage.scratch(spark) as folder:
        pass
    root = tmp_path.__class__(folder.removeprefix("file://")).parent
    there = {p.name for p in root.iterdir()} if root.exists() else set()
    main([str(log), str(tmp_path / "out")])
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"findings", "actions", "report", "json"}
    assert {p.name for p in root.iterdir()} == there and set(storage._known) == before
