"""DuckDB SQL with the rows of the registered queries, written by other means where there are any."""

from __future__ import annotations

from needledrop.sources.orders_log import DUCKDB


class T:
    """Fixed values, written here once more and by code points where they can be, so that a slip shows on one side only."""

    DASHES = r"[\x{2010}-\x{2015}\x{2212}]"
    SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
    INVISIBLE = r"[\x{200B}-\x{200F}\x{2028}\x{2029}\x{FEFF}\x{FFFD}]"
    SINGLE_QUOTES = "".join(map(chr, (0x2018, 0x2019, 0x201B, 0x2032, 0x2B9, 0x2BB, 0x2BC, 0x2BD, 0x2BE, 0x2BF, 0x60, 0xB4)))
    DOUBLE_QUOTES = "".join(map(chr, (0x201C, 0x201D, 0x2033, 0xAB, 0xBB)))
    BADGE_CORE = "official|oficial|audio|video|lyric|lyrics|letra|letras|visual|visuals|visualizer|visualiser|mv|hd|hq|4k|8k".split("|")
    BADGE_MORE = ["clip", "music", "full"]
    VERSIONS = "|".join(
        "live/en vivo/directo/acoustic/acustico/acustica/remix/remaster/remastered/remasterizado/instrumental/karaoke/cover/version/edicion/edit/extended/reprise/"
        "demo/mono/stereo/radio edit/soundtrack/banda sonora/orchestral/orquesta/esc version/eurovision/junior/dancebreak/spanglish/spanish/english/italiano".split("/")
    )
    SEPARATORS = r"(?i)(?:,|;|\s+(?:&|y|vs\.?|feat\.?|featuring|with|\|)\s+)"
    ARTICLES, FEATURING = "el|il|la|las|le|les|lo|los|the", "featuring|feat|ft|con"
    ROMAN = "x{0,1}(?:ix|iv|v?i{1,3}|v)|x{1,2}"
    BRACKETS, TAIL = r"[(\[{]([^)\]}]*)[)\]}]", r"\s+-\s+(.{2,})$"


TYPES = {
    "duplicate_artists": "Duplicate artists", "combined_artists": "Combined artists", "title_variants": "Inconsistent track titles", "artist_in_title": "Artist repeated in title",
    "albums": "Albums", "duplicate_scrobbles": "Duplicate scrobbles", "long_tail": "Long tail and oddities",
}
ACTIONS = {
    "rename_artist": "Rename artist", "split_combined": "Review combined artist", "rename_track": "Merge track title", "strip_artist_from_title": "Remove artist from title",
    "fill_album": "Fill in album", "merge_album": "Merge album name", "review_album": "Review album", "review_capitalisation": "Review capitalisation",
    "delete_duplicate": "Delete duplicate", "review_artist": "Review artist name", "review_track": "Review track title", "review": "Review",
}
ODD_SPACES = "[" + "".join(map(chr, (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))) + "]"
_WHITE = "".join(map(chr, (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
UNSEEN = "[" + "".join(map(chr, (*range(0x200B, 0x2010), 0xFEFF))) + "]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    for pattern, by in ((T.DASHES, "-"), (T.SPACES, " "), (T.INVISIBLE, ""), (r"\s+", " ")):
        x = f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"
    return f"trim({x})"


def key(x: str) -> str:
    return rf"trim(regexp_replace(translate(lower(strip_accents({norm(x)})), {q(T.SINGLE_QUOTES)}, {q(' ' * len(T.SINGLE_QUOTES))}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def unfeatured(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '\b(?:{T.FEATURING})\b\.?', ' ', 'g'), '\s+', ' ', 'g'))"


def badge(k: str) -> str:
    core, words = "|".join(T.BADGE_CORE), "|".join(T.BADGE_CORE + T.BADGE_MORE)
    return f"(regexp_matches({k}, '^(?:{words})(?: (?:{words}))*$') AND regexp_matches({k}, '(?:^| )(?:{core})(?: |$)'))"


def artist_key(x: str) -> str:
    bare = rf"regexp_replace({norm(x)}, '[(\[{{][^)\]}}]*[)\]}}]', ' ', 'g')"
    return rf"coalesce(nullif(regexp_replace({key(unfeatured(bare))}, '^(?:{T.ARTICLES})\s+', ''), ''), {key(x)})"


def contains(h: str, n: str) -> str:
    return f"({n} <> '' AND {h} <> {n} AND contains(' ' || {h} || ' ', ' ' || {n} || ' '))"


def num(x: str) -> str:
    return "format('{:,}', " + x + ")"


def said(*each: tuple[str, str]) -> str:
    """The texts whose condition holds, as one."""
    cases = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in each)
    return f"coalesce(array_to_string(list_filter([{cases}], lambda v: v IS NOT NULL), ' | '), '')"


def day(ms: str) -> str:
    return f"coalesce(replace(strftime(make_timestamp({ms} * 1000), '%d %b %Y'), ' Sep ', ' Sept '), '—')"


def days(first: str, last: str) -> str:
    return f"CASE WHEN {first} IS NULL THEN 'no date' ELSE {day(first)} || ' to ' || {day(last)} END"


def points(x: str) -> str:
    return f"least(greatest(floor({x} + 0.5), 0), 100)::INTEGER"


def target(artist: str, track: str = "NULL::VARCHAR", album: str = "NULL::VARCHAR") -> str:
    return f"struct_pack(artist := {artist}, track := {track}, album := {album})"


def strip_badges(x: str) -> str:
    """On a column ``x`` that is in normal form."""
    pattern = r"[(\[]([^)\]]*)[)\]]"
    gaps, found = f"string_split_regex({x}, {q(pattern)})", f"regexp_extract_all({x}, {q(pattern)})"
    flat = f"list_aggregate(list_transform({gaps}, lambda g, j: g || CASE WHEN j > len({found}) THEN '' WHEN {badge(key(f'{found}[j]'))} THEN ' ' ELSE {found}[j] END), 'string_agg', '')"
    tail = f"regexp_extract({flat}, {q(T.TAIL)}, 1)"
    return norm(f"CASE WHEN {badge(key(tail))} THEN regexp_replace({flat}, {q(T.TAIL)}, '') ELSE {flat} END")


VERSION = rf"regexp_matches({{}}, '\b(?:{T.VERSIONS})\b')"
BASE = rf"""
raw AS ({DUCKDB}),
placed AS (SELECT (row_number() OVER (ORDER BY ts_ms NULLS LAST, k1, k2, k3, k4) - 1)::BIGINT AS i, * FROM raw),
names AS (SELECT DISTINCT title FROM raw),
flat AS (SELECT title, {norm('title')} AS nt, {key('title')} AS strict FROM names),
flatter AS (SELECT *, regexp_replace(nt, {q(T.BRACKETS)}, ' ', 'g') AS open, regexp_extract_all(nt, {q(T.BRACKETS)}, 1) AS inner_parts FROM flat),
tails AS (SELECT *, {key(f"regexp_extract(open, {q(T.TAIL)}, 1)")} AS tail FROM flatter),
parts AS (
  SELECT *, trim(regexp_replace(CASE WHEN tail = '' THEN open ELSE regexp_replace(open, {q(T.TAIL)}, '') END, '\s+', ' ', 'g')) AS base,
         list_filter(list_append(list_transform(inner_parts, lambda p: {key('p')}), tail), lambda p: p <> '') AS q FROM tails),
spelled AS (
  SELECT title, nt, strict, base, q, coalesce(array_to_string(q, ' | '), '') AS qualifiers, coalesce(nullif({key(unfeatured('base'))}, ''), strict) AS track_key,
         {VERSION.format('strict')} AS version, len(list_filter(q, lambda p: {badge('p')})) > 0 AS badge FROM parts),
plays AS (SELECT i, artist, title, album, ts_ms, track_key FROM placed JOIN spelled USING (title)),
whole AS (SELECT * FROM plays WHERE artist <> '' OR title <> ''),
split AS (
  SELECT artist, {artist_key('artist')} AS key,
         list_filter(list_transform(string_split_regex({norm('artist')}, {q(T.SEPARATORS)}),
           lambda p: trim(regexp_replace(regexp_replace(p, '^[\s\-]+|[\s\-]+$', '', 'g'), '^[(\[{{]|[)\]}}]$', '', 'g'))), lambda p: {key('p')} <> '') AS found
  FROM (SELECT DISTINCT artist FROM raw)),
titles AS (SELECT artist, track_key, title, count(*) AS n, min(i) AS seen, any_value(strict) AS strict, any_value(qualifiers) AS qualifiers,
         any_value(version) AS version, any_value(badge) AS badge FROM whole JOIN spelled USING (title, track_key) GROUP BY artist, track_key, title),
tracks AS (SELECT artist, track_key, sum(n)::BIGINT AS n, arg_max(title, (n, -seen)) AS title, bool_or(version) AS versioned FROM titles GROUP BY artist, track_key),
artists AS (
  SELECT a.*, s.key, CASE WHEN len(s.found) > 1 THEN s.found ELSE [] END AS parts, t.n_tracks FROM (
    SELECT artist, count(*) AS n, min(ts_ms) AS first, max(ts_ms) AS last, count(ts_ms) AS dated FROM whole GROUP BY artist) a
  JOIN split s USING (artist) JOIN (SELECT artist, count(*) AS n_tracks FROM tracks GROUP BY artist) t USING (artist)),
track_albums AS (SELECT artist, track_key, album, count(*) AS n, min(i) AS seen FROM plays WHERE album <> '' GROUP BY artist, track_key, album),
albums AS (SELECT artist, album, count(*) AS n, min(i) AS seen, {key('album')} AS album_key FROM whole WHERE album <> '' GROUP BY artist, album)
"""
SCORE = "least(1.0::DOUBLE, log10(1 + {n}) / 2) * 1.5::DOUBLE + least(1.0::DOUBLE, length({v}) / 24) * 0.5::DOUBLE"


def ms_score(v: str, n: str, last: str, newest: str, oldest: str) -> str:
    recent = f"CASE WHEN {last} IS NULL THEN 0.0::DOUBLE WHEN {newest} - {oldest} > 0 THEN 2 * (1 - ({newest} - {last}) / ({newest} - {oldest})) ELSE 2.0::DOUBLE END"
    return f"({recent} + {SCORE.format(n=n, v=v)})"


def titles_of(name: str) -> str:
    """Shared titles as evidence for the pairs (id, x, y) of ``name``: {name}_items (id, items, total)."""
    return f"""
{name}_common AS (
  SELECT p.id, a.title AS a, max(struct_pack(t := a.n + b.n, n := a.n, m := b.n)) AS t FROM {name} p JOIN tracks a ON a.artist = p.x JOIN tracks b ON b.artist = p.y AND b.track_key = a.track_key GROUP BY p.id, a.title),
{name}_items AS (SELECT id, count(*) AS total, list(a || ': ' || {num('t.n')} || ' + ' || {num('t.m')} || ' plays' ORDER BY t.t DESC, a)[1:14] AS items FROM {name}_common GROUP BY id)"""


NO_MORE = "'' AS alternatives, 0::BIGINT AS beyond"
IDENTICAL = """
same AS (
  SELECT a.artist AS x, b.artist AS y FROM artists a JOIN artists b ON a.key = b.key AND a.key <> '' AND (a.n > b.n OR (a.n = b.n AND a.artist < b.artist)))"""
INSIDE = f"""
single AS (SELECT artist, key, list_filter(string_split(key, ' '), lambda w: length(w) >= 2) AS ws FROM artists WHERE key <> '' AND len(parts) < 2),
inside AS (
  SELECT a.artist AS x, b.artist AS y FROM single a JOIN single b ON {contains('b.key', 'a.key')} AND len(a.ws) > 0)"""
SHARED = """
{name}_shared AS (
  SELECT p.x, p.y, count(*) AS shared FROM {name} p JOIN tracks a ON a.artist = p.x JOIN tracks b ON b.artist = p.y AND a.track_key = b.track_key GROUP BY p.x, p.y)"""
MIX = """
{name}_sides AS (
  SELECT p.x, p.y, CASE WHEN b.dated < a.dated THEN p.y ELSE p.x END AS few, CASE WHEN b.dated < a.dated THEN p.x ELSE p.y END AS many
  FROM {name} p JOIN artists a ON a.artist = p.x JOIN artists b ON b.artist = p.y),
{name}_times AS (SELECT artist, ts_ms, unnest([ts_ms // 600000 - 1, ts_ms // 600000, ts_ms // 600000 + 1]) AS slot FROM (SELECT DISTINCT artist, ts_ms FROM whole WHERE ts_ms IS NOT NULL)),
{name}_mix AS (
  SELECT s.x, s.y, count(DISTINCT w.i) AS mix FROM {name}_sides s JOIN whole w ON w.artist = s.few
  JOIN {name}_times t ON t.artist = s.many AND t.slot = w.ts_ms // 600000 AND abs(t.ts_ms - w.ts_ms) <= 600000 GROUP BY s.x, s.y)"""
MERGE = f"""
merge_all AS (SELECT x, y, 'identical' AS relation FROM same UNION ALL SELECT x, y, 'containment' FROM inside),
{SHARED.format(name='merge_all')},
merged AS (SELECT m.*, coalesce(s.shared, 0) AS shared FROM merge_all m LEFT JOIN merge_all_shared s USING (x, y) WHERE relation = 'identical' OR s.shared > 0),
{MIX.format(name='merged')},
scored AS (
  SELECT *, 40 * (shared + 0.5::DOUBLE) / (min_tracks + 1) + 15 * (least(shared, 20) / 20) + CASE relation WHEN 'identical' THEN 20 ELSE 15 END
            + 15 * (least(mix, 10) / 10) + 10 * (least(min_tracks, 8) / 8) AS points,
         relation = 'identical' OR (shared >= 1 AND shared / min_tracks >= 0.6::DOUBLE AND min_tracks >= 2) AS strong
  FROM (SELECT m.*, least(a.n_tracks, b.n_tracks) AS min_tracks, coalesce(z.mix, 0) AS mix FROM merged m JOIN artists a ON a.artist = m.x
        JOIN artists b ON b.artist = m.y LEFT JOIN merged_mix z ON z.x = m.x AND z.y = m.y))"""
COMPONENTS = """
links AS (SELECT x AS a, y AS b FROM scored WHERE strong UNION SELECT y, x FROM scored WHERE strong),
reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
labels AS (SELECT node, min(other) AS label FROM reach GROUP BY node)"""
RESOLVE = f"""
pieces AS (SELECT artist, n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM artists WHERE len(parts) > 1),
hits AS (
  SELECT p.artist, p.n, p.pos, p.part, o.artist AS base, o.key AS base_key, o.n AS base_n FROM pieces p JOIN artists o ON o.key = {artist_key('p.part')} AND o.artist <> p.artist
  QUALIFY row_number() OVER (PARTITION BY p.artist, p.pos ORDER BY o.n DESC, o.artist) = 1),
based AS (SELECT artist, any_value(n) AS n, arg_min(part, pos) AS part, arg_min(base, pos) AS base, arg_min(base_key, pos) AS base_key, arg_min(base_n, pos) AS base_n, count(*) AS bases, list('“' || base || '” (' || {num('base_n')} || ')' ORDER BY pos)[2:] AS more_bases FROM hits GROUP BY artist),
resolved AS (SELECT * FROM based WHERE base_n >= 2 AND base_n >= 0.05::DOUBLE * n)"""
SIMILAR = f"""
eligible AS (SELECT artist, n, key, left(key, 1) AS initial FROM artists WHERE length(key) >= 5 AND len(parts) < 2),
alike_ratio AS (
  SELECT a.artist AS x, b.artist AS y, levenshtein(a.key, b.key) AS apart, 1 - levenshtein(a.key, b.key) / greatest(length(a.key), length(b.key)) AS strength,
         a.key AS xk, b.key AS yk
  FROM eligible a JOIN eligible b ON a.initial = b.initial AND a.key <> b.key AND (a.n > b.n OR (a.n = b.n AND a.artist < b.artist))
  WHERE NOT {contains('a.key', 'b.key')} AND NOT {contains('b.key', 'a.key')}),
shortened AS (
  SELECT x, y, list_filter(list_zip(string_split(xk, ' '), string_split(yk, ' ')), lambda p: p[1] IS DISTINCT FROM p[2]) AS differ, len(string_split(xk, ' ')) = len(string_split(yk, ' ')) AS even FROM alike_ratio),
abbreviated AS (
  SELECT x, y, CASE WHEN length(differ[1][1]) <= length(differ[1][2]) THEN differ[1][1] ELSE differ[1][2] END AS short,
         CASE WHEN length(differ[1][1]) <= length(differ[1][2]) THEN differ[1][2] ELSE differ[1][1] END AS long
  FROM shortened WHERE even AND len(differ) = 1),
alike AS (
  SELECT x, y, CASE WHEN r THEN 'ratio' ELSE 'abbreviation' END AS kind, CASE WHEN r THEN strength ELSE 0.9::DOUBLE + 0.1::DOUBLE * length(short) / length(long) END AS strength,
         CASE WHEN r THEN apart END::INTEGER AS apart
  FROM (SELECT a.*, b.short, b.long, a.apart <= 2 AND a.strength >= 0.875::DOUBLE AS r,
               coalesce(length(short) >= 4 AND starts_with(long, short) AND length(long) - length(short) >= 2, false) AS s
        FROM alike_ratio a LEFT JOIN abbreviated b USING (x, y)) WHERE r OR s)"""
NEAREST = """
nearest AS (
  SELECT a.artist AS x, arg_min(b.artist, (d, -b.n, b.artist)) AS y, min(d)::INTEGER AS apart FROM (
    SELECT a, b, CASE WHEN levenshtein(a.key, b.key) > m THEN m + 1 ELSE levenshtein(a.key, b.key) END AS d FROM (
      SELECT a, b, CASE WHEN length(b.key) > 10 THEN 3 ELSE 2 END AS m FROM artists a JOIN artists b ON left(a.key, 1) = left(b.key, 1) AND a.artist <> b.artist AND a.key <> b.key
      WHERE a.n <= 2 AND b.n >= 20 AND a.key <> '' AND b.key <> '')) GROUP BY a.artist)"""
TRACKED = f"""
of_track AS (
  SELECT artist, track_key, arg_max(title, (n, -seen)) AS title, sum(n)::BIGINT AS n, sum(missing)::BIGINT AS missing, min(seen) AS seen FROM (
    SELECT artist, track_key, title, count(*) AS n, min(i) AS seen, count(*) FILTER (WHERE album = '') AS missing FROM plays GROUP BY ALL) GROUP BY artist, track_key),
on_albums AS (
  SELECT t.*, a.albums, a.album, a.album_n, a.all_albums, {key('a.album')} = s.track_key AS after_title FROM of_track t JOIN (
    SELECT artist, track_key, count(*) AS albums, arg_max(album, (n, -seen)) AS album, max(n) AS album_n, list(album || ': ' || {num('n')} || ' play(s)' ORDER BY n DESC, seen) AS all_albums FROM track_albums GROUP BY artist, track_key) a USING (artist, track_key)
  JOIN spelled s ON s.title = t.title)"""
REPEATED = f"""
after AS (SELECT title, artist, CASE WHEN length(ak) >= 3 AND starts_with(strict, ak || ' ') AND regexp_matches(rest, '^\\s*[-–—:]\\s*\\S')
            THEN nullif({norm("regexp_replace(rest, '^\\s*[-–—:]\\s*', '')")}, '') END AS rest
  FROM (SELECT w.artist, w.title, a.key AS ak, s.strict, substr(s.nt, length(w.artist) + 1) AS rest FROM (SELECT DISTINCT artist, title FROM plays) w JOIN split a USING (artist) JOIN spelled s USING (title)))"""
RUNS = """
lagged AS (SELECT *, lag(artist) OVER w AS pa, lag(track_key) OVER w AS pk, ts_ms - lag(ts_ms) OVER w AS gap FROM plays WINDOW w AS (ORDER BY i)),
marked AS (SELECT *, CASE WHEN coalesce(pa = artist AND pk = track_key AND gap <= 60000, false) THEN 0 ELSE 1 END AS starts FROM lagged),
run_of AS (SELECT *, sum(starts) OVER (ORDER BY i) AS run FROM marked),
runs AS (
  SELECT any_value(artist) AS artist, any_value(track_key) AS track_key, arg_min(title, i) AS title, count(*) AS plays, min(gap) FILTER (WHERE starts = 0) AS gap_ms, min(i) AS start, min(ts_ms) AS since
  FROM run_of GROUP BY run HAVING count(*) > 1)"""
VARIANTS = f"""
forms AS (
  SELECT *, count(*) OVER (PARTITION BY artist, track_key) AS forms, count(*) OVER (PARTITION BY artist, track_key, qualifiers) AS in_version,
         row_number() OVER (PARTITION BY artist, track_key, qualifiers ORDER BY n DESC, seen) AS place FROM titles WHERE track_key <> '' AND NOT badge),
variants AS (
  SELECT *, qualifiers AS bucket FROM forms WHERE forms > 1 AND in_version > 1 UNION ALL
  SELECT *, NULL AS bucket FROM forms WHERE forms > 1 AND place = 1 AND in_version < forms),
described AS (
  SELECT v.*, {SCORE.format(n='v.n', v='v.title')} AS wanted, v.qualifiers = '' AS plain,
         {key('s.base')} || '|' || coalesce(array_to_string(list_filter(s.q, lambda p: NOT regexp_matches(p, '^\\s*(?:feat|featuring|ft|with|con)\\b')), ','), '') AS signature,
         regexp_matches(v.strict, '\\b(?:feat|featuring|ft|with)\\b') AS featured
  FROM variants v JOIN spelled s USING (title)),
judged AS (
  SELECT artist, track_key, bucket, count(*) AS k, sum(n)::BIGINT AS total,
         CASE WHEN count(DISTINCT signature) = 1 AND bool_or(featured) AND count(DISTINCT strict) > 1 THEN 'featuring'
              WHEN count(DISTINCT lower(title)) = 1 THEN 'case_only'
              WHEN count(DISTINCT qualifiers) = 1 AND NOT bool_or(plain) THEN 'qualifier_formatting'
              WHEN count(DISTINCT strict) = 1 THEN 'formatting'
              WHEN bool_or(plain) AND NOT bool_and(plain) AND bool_or(version AND NOT plain) THEN 'version_marker'
              WHEN bool_or(plain) AND NOT bool_and(plain) THEN 'one_qualified' ELSE 'different_qualifiers' END AS subtype,
         arg_max(title, (wanted, n, -seen)) AS preferred, arg_max(title, (plain::INTEGER, n, -seen)) AS plainest, min(seen) AS seen
  FROM described GROUP BY artist, track_key, bucket),
kept AS (SELECT *, CASE subtype WHEN 'version_marker' THEN plainest ELSE preferred END AS proposed FROM judged),
varied AS (
  SELECT k.artist, k.subtype, k.proposed, k.seen, k.k, list({target('k.artist', 'v.title')} ORDER BY v.seen) AS targets, string_agg(v.title, '  /  ' ORDER BY v.seen) AS current, sum(v.n)::BIGINT AS impact,
    array_to_string(list(v.title ORDER BY v.n DESC, v.seen)[1:3], ' | ') AS alternatives, any_value(l.evidence) AS evidence
  FROM kept k JOIN variants v ON v.artist = k.artist AND v.track_key = k.track_key AND v.bucket IS NOT DISTINCT FROM k.bucket AND v.title <> k.proposed
  JOIN (SELECT artist, track_key, bucket, array_to_string(list(title || ': ' || {num('n')} || ' play(s)' ORDER BY seen)[1:14], ' | ') AS evidence FROM variants GROUP BY artist, track_key, bucket) l
    ON l.artist = k.artist AND l.track_key = k.track_key AND l.bucket IS NOT DISTINCT FROM k.bucket
  GROUP BY k.artist, k.track_key, k.bucket, k.subtype, k.proposed, k.seen, k.k)"""


def select(select_sql: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([BASE, *ctes]) + select_sql


def log_points(x: str, times: int, most: int) -> str:
    return f"least({most}.0::DOUBLE, log10(1 + {x}) * {times}.0::DOUBLE)"



def album_variants() -> str:
    spelled = f"lower(strip_accents(translate(album, {q(T.SINGLE_QUOTES + T.DOUBLE_QUOTES)}, {q(chr(39) * len(T.SINGLE_QUOTES) + chr(34) * len(T.DOUBLE_QUOTES))})))"
    return select(f"""
SELECT '' AS alternatives, greatest(forms - 14, 0)::BIGINT AS beyond, array_to_string(all_forms[1:14], ' | ') AS evidence,
  {said(("capitals", "'The spellings differ in capitals only'"), ("NOT capitals", "'One album, written with different capitals, accents, quotes or spaces'"), ("true", "'Both are of one artist, “' || artist || '”'"))} AS signals,
  seen, 'Album in ' || forms || ' forms: “' || artist || ' — ' || kept || '”' AS title, '' AS warning, targets, CASE WHEN capitals THEN 'case_only' ELSE 'name_variants' END AS subtype, current, kept AS proposed, impact,
  {points(f"CASE WHEN capitals THEN 44 + {log_points('impact', 6, 8)} ELSE 74 + {log_points('impact', 8, 10)} END")} AS points
FROM (SELECT g.capitals, g.kept, g.seen, g.artist, g.forms, any_value(g.all_forms) AS all_forms, list({target('g.artist', album='a.album')} ORDER BY a.n DESC, a.seen) AS targets, string_agg(a.album, '  /  ' ORDER BY a.n DESC, a.seen) AS current, sum(a.n)::BIGINT AS impact FROM (
    SELECT artist, album_key, count(*) AS forms, count(DISTINCT lower(album)) = 1 AS capitals, arg_max(album, (n, -seen)) AS kept, min(seen) AS seen, list(album || ': ' || {num('n')} || ' play(s)' ORDER BY n DESC, seen) AS all_forms FROM albums GROUP BY artist, album_key
    HAVING count(*) > 1 AND count(DISTINCT {spelled}) = 1) g
  JOIN albums a ON a.artist = g.artist AND a.album_key = g.album_key AND a.album <> g.kept GROUP BY g.artist, g.album_key, g.forms, g.capitals, g.kept, g.seen)""")


_RAW_TITLES = "SELECT title, {} FROM spelled"
STRIPPED_ROMAN = rf"array_to_string(list_filter(string_split(regexp_replace(track_key, '[0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT regexp_matches(w, '^(?:{T.ROMAN})$')), ' ')"
ORACLES = {
    "b_normalise_text": select(_RAW_TITLES.format("nt AS normal")),
    "b_key": select(_RAW_TITLES.format("strict AS key")),
    "b_loose_title_key": select(_RAW_TITLES.format("track_key AS key")),
    "b_title_parts": select(_RAW_TITLES.format("base, qualifiers")),
    "b_badge": select(_RAW_TITLES.format(f"badge, {strip_badges('nt')} AS stripped")),
    "b_version_marker": select(_RAW_TITLES.format("version")),
    "b_ordinals": select(f"SELECT DISTINCT track_key, coalesce({STRIPPED_ROMAN}, '') AS stripped FROM spelled"),
    "b_artist_key": select("SELECT artist, key FROM split"),
    "b_split_artist": select("SELECT artist, CASE WHEN len(found) > 1 THEN coalesce(array_to_string(found, ' | '), '') ELSE '' END AS parts FROM split"),
    "b_edit_distance": select("SELECT a.key AS a, b.key AS b, CASE WHEN levenshtein(a.key, b.key) > 2 THEN 3 ELSE levenshtein(a.key, b.key) END::INTEGER AS distance FROM (SELECT DISTINCT key FROM split) a JOIN (SELECT DISTINCT key FROM split) b ON left(a.key, 1) = left(b.key, 1) AND length(a.key) = length(b.key) AND a.key < b.key"),
    "c_artist_index": select("SELECT artist, n, first AS first_ms, last AS last_ms, key, n_tracks FROM artists"),
    "c_track_index": select("SELECT artist, track_key, n, title, versioned FROM tracks"),
    "c_album_index": select("SELECT artist, album, album_key, n, seen FROM albums"),
    "c_most_frequent": select("SELECT artist, track_key, arg_max(album, (n, -seen)) AS album, max(n) AS n FROM track_albums GROUP BY artist, track_key"),
    "c_canonical": select(f"SELECT key, arg_max(artist, (wanted, n, artist)) AS canonical FROM (SELECT *, {ms_score('artist', 'n', 'last', 'newest', 'oldest')} AS wanted FROM (SELECT *, max(last) OVER (PARTITION BY key) AS newest, min(last) OVER (PARTITION BY key) AS oldest FROM artists)) GROUP BY key"),
    "c_runs": select("SELECT artist, track_key, title, plays, gap_ms, start FROM runs", RUNS),
    "d_same_key_pairs": select("SELECT x, y FROM same", IDENTICAL),
    "d_containment_pairs": select("SELECT x, y FROM inside", INSIDE),
    "d_similar_pairs": select("SELECT x, y, kind, round(strength, 9) AS strength, apart FROM alike", SIMILAR),
    "d_shared_tracks": select("SELECT x, y, coalesce(shared, 0) AS shared FROM inside LEFT JOIN inside_shared USING (x, y)", INSIDE, SHARED.format(name="inside")),
    "d_temporal_mix": select("SELECT x, y, coalesce(mix, 0) AS mix FROM inside LEFT JOIN inside_mix USING (x, y)", INSIDE, MIX.format(name="inside")),
    "d_nearest_artist": select("SELECT x, y, apart FROM nearest", NEAREST),
    "d_components": select("SELECT node, label FROM labels", IDENTICAL, INSIDE, MERGE, COMPONENTS),
    "e_similar_names": select(f"""
SELECT *, -impact AS seen, '“' || current || '” → “' || proposed || '”' || CASE subtype WHEN 'similar_names' THEN '?' ELSE '' END AS title,
  CASE subtype WHEN 'similar_names' THEN 'Alike names can be different artists, and these share no track.' ELSE '' END AS warning, [{target('current')}] AS targets,
  current AS alternatives, greatest(coalesce(total, 0) - 14, 0)::BIGINT AS beyond,
  CASE WHEN shared > 0 THEN array_to_string(items, ' | ') ELSE '“' || x || '”: ' || {num('x_n')} || ' play(s), ' || {days('x_first', 'x_last')} || ' | “' || y || '”: ' || {num('y_n')} || ' play(s), ' || {days('y_first', 'y_last')} || ' | Tracks in common: 0' END AS evidence,
  {said(("kind = 'ratio'", "'The names are ' || apart || ' character(s) apart'"), ("kind = 'abbreviation'", "'One word is the beginning of the other''s, the rest is equal'"),
        ("shared > 0", "'They share ' || " + num('shared') + " || ' track(s)'"), ("mix > 0", num('mix') + " || ' play(s) of one fall within minutes of plays of the other'"),
        ("renamed", "CASE WHEN x_last <= y_first THEN '“' || x || '” ends on ' || " + day('x_last') + " || ' and “' || y || '” begins on ' || " + day('y_first') + " ELSE '“' || y || '” ends on ' || " + day('y_last') + " || ' and “' || x || '” begins on ' || " + day('x_first') + " END || ', as after a rename'"),
        ("true", "'“' || x || '” has ' || " + num('x_n') + " || ' play(s), “' || y || '” ' || " + num('y_n')), ("shared > 0 AND shared = fewest", "'Every track of one also exists under the other'"))} AS signals
FROM (SELECT x, y, kind, apart, shared, mix, renamed, fewest, x_n, y_n, x_first, x_last, y_first, y_last, items, total, CASE WHEN shared > 0 THEN 'similar_with_tracks' ELSE 'similar_names' END AS subtype, CASE WHEN keep_x THEN y ELSE x END AS current, CASE WHEN keep_x THEN x ELSE y END AS proposed,
  {points('''CASE WHEN shared > 0 THEN 18 + 30 * ((shared + 0.5::DOUBLE) / (fewest + 1)) + 12 * (least(shared, 20) / 20) + 12 * (least(mix, 10) / 10) + 12 * strength
    + CASE WHEN renamed THEN 6 ELSE 0 END + CASE WHEN shared = fewest THEN 12 ELSE 0 END
    ELSE 22 + 26 * strength + 10 * (least(mix, 10) / 10) + CASE WHEN renamed THEN 8 ELSE 0 END END''')} AS points,
  CASE WHEN keep_x THEN y_n ELSE x_n END AS impact, CASE WHEN keep_x THEN x_n ELSE y_n END AS other_n
FROM (SELECT *, {ms_score('x', 'x_n', 'x_last', 'greatest(x_last, y_last)', 'least(x_last, y_last)')} >= {ms_score('y', 'y_n', 'y_last', 'greatest(x_last, y_last)', 'least(x_last, y_last)')} AS keep_x
  FROM (SELECT p.x, p.y, p.kind, p.apart, p.strength, coalesce(s.shared, 0) AS shared, coalesce(z.mix, 0) AS mix, a.n AS x_n, b.n AS y_n, a.last AS x_last, b.last AS y_last, a.first AS x_first, b.first AS y_first, e.items, e.total,
          least(a.n_tracks, b.n_tracks) AS fewest, a.last <= b.first OR b.last <= a.first AS renamed
        FROM alike p JOIN artists a ON a.artist = p.x JOIN artists b ON b.artist = p.y LEFT JOIN alike_shared s ON s.x = p.x AND s.y = p.y LEFT JOIN alike_mix z ON z.x = p.x AND z.y = p.y LEFT JOIN alike_pairs_items e ON e.id = p.x || chr(31) || p.y)))""",
        SIMILAR, SHARED.format(name="alike"), MIX.format(name="alike"), "alike_pairs AS (SELECT x || chr(31) || y AS id, x, y FROM alike)", titles_of("alike_pairs")),
    "e_combined_artists": select(f"""
SELECT '' AS subtype, array_to_string(list_prepend(x, coalesce(siblings, [])), '  /  ') AS current, y AS proposed,
  {points('''55 + CASE WHEN leads THEN 0 ELSE -8 END + CASE WHEN bases > 1 THEN -6 ELSE 0 END + CASE WHEN n <= 5 THEN 12 ELSE 0 END + CASE WHEN base_n >= 20 THEN 8 ELSE 0 END
    + CASE WHEN near THEN 8 ELSE 0 END + CASE WHEN shared > 0 THEN 12 ELSE 0 END + CASE WHEN siblings IS NOT NULL THEN 4 ELSE 0 END''')} AS points,
  (n + coalesce(more, 0))::BIGINT AS impact, -n AS seen, '“' || x || '” → “' || y || '”' AS title,
  CASE WHEN leads THEN '' ELSE 'The name starts with “' || first_part || '”, which is no artist of its own here: check before renaming.' END AS warning,
  list_transform(list_prepend(x, coalesce(siblings, [])), lambda v: {target('v')}) AS targets,
  coalesce(array_to_string(list_filter(parts, lambda v: v <> part), ' | '), '') AS alternatives, coalesce(array_to_string(items, ' | '), '') AS evidence, greatest(coalesce(total, 0) - 14, 0)::BIGINT AS beyond,
  {said(("true", "'The name joins several artists by “' || CASE WHEN contains(x, ',') THEN ',' WHEN regexp_matches(x, '\\s&\\s') THEN '&' ELSE 'several' END || '”'"),
        ("true", "'“' || y || '” exists on its own with ' || " + num('base_n') + " || ' plays'"), ("NOT leads", "'The first artist of the name, “' || first_part || '”, is not there on its own'"),
        ("bases > 1", "'More of its artists are there on their own: ' || array_to_string(more_bases, ', ')"), ("n <= 5", "'Only ' || " + num('n') + " || ' play(s) under the joined name'"),
        ("near", "'Its plays fall close in time to those of the proposed artist'"), ("shared > 0", num('shared') + " || ' track(s) also exist under “' || y || '”'"),
        ("siblings IS NOT NULL", "'The same name is also written as ' || array_to_string(list_transform(siblings, lambda v: '“' || v || '”'), ', ') || ', ' || " + num('more::BIGINT') + " || ' play(s)'"))} AS signals
FROM (SELECT a.parts, r.part, e.items, e.total, r.more_bases, a.parts[1] AS first_part, p.x, p.y, r.n, r.base_n, r.bases, {artist_key('a.parts[1]')} = r.base_key AS leads, coalesce(s.shared, 0) AS shared,
        abs(coalesce(a.last, 0) - coalesce(b.first, 0)) < 604800000 OR coalesce(z.mix, 0) > 0 AS near, g.siblings, g.more
      FROM pairs_of p JOIN resolved r ON r.artist = p.x JOIN artists a ON a.artist = p.x JOIN artists b ON b.artist = p.y
      LEFT JOIN pairs_of_shared s ON s.x = p.x AND s.y = p.y LEFT JOIN pairs_of_mix z ON z.x = p.x AND z.y = p.y
      LEFT JOIN (SELECT c.artist, list(o.artist ORDER BY o.n DESC, o.artist) AS siblings, sum(o.n) AS more FROM artists c JOIN artists o ON o.key = c.key AND o.artist <> c.artist WHERE len(c.parts) > 1 GROUP BY c.artist) g ON g.artist = p.x LEFT JOIN pairs_of_items e ON e.id = p.x)""",
        RESOLVE, "pairs_of AS (SELECT artist AS id, artist AS x, base AS y FROM resolved)", titles_of("pairs_of"), SHARED.format(name="pairs_of"), MIX.format(name="pairs_of")),
    "e_duplicate_artists": select(f"""
SELECT subtype, current, proposed, points, impact, seen, title, warning, targets, alternatives, coalesce(array_to_string(items, ' | '), '') AS evidence, greatest(coalesce(total, 0) - 14, 0)::BIGINT AS beyond,
  array_to_string(list_append(sentences, CASE WHEN proposed <> canonical THEN '“' || canonical || '” itself joins several artists, so every form goes to “' || proposed || '”'
    WHEN latest <> canonical THEN 'The latest play is under “' || latest || '” (' || {day('latest_ms')} || '), the most plays under “' || most || '” (' || {num('most_n')} || ')'
    ELSE 'The latest play is under the form to keep, “' || canonical || '”' END), ' | ') AS signals
FROM (SELECT id, canonical, CASE WHEN pairs > 1 THEN 'group' ELSE relation END AS subtype, string_agg(name, '  /  ' ORDER BY n DESC, name) AS current, target AS proposed, {points('points')} AS points, sum(n)::BIGINT AS impact, -sum(n)::BIGINT AS seen,
    CASE WHEN count(*) = 1 THEN '“' || any_value(name) || '”' ELSE count(*) || ' forms of the same artist' END || ' → “' || target || '”' AS title, '' AS warning,
    list({target('name')} ORDER BY n DESC, name) AS targets, string_agg(name, ' | ' ORDER BY n DESC, name) AS alternatives
  FROM (SELECT c.*, m.name, a.n FROM targets c JOIN members m USING (id) JOIN artists a ON a.artist = m.name) WHERE name <> target GROUP BY id, canonical, target, pairs, relation, points)
JOIN spoken USING (id) JOIN extremes USING (id) LEFT JOIN case_pairs_items USING (id)""",
        IDENTICAL, INSIDE, MERGE, COMPONENTS, RESOLVE, f"""
at_label AS (SELECT s.*, coalesce(l.label, s.x) AS grp FROM scored s LEFT JOIN labels l ON l.node = s.x),
counted AS (SELECT *, count(*) FILTER (WHERE strong) OVER (PARTITION BY grp) AS strongs FROM at_label),
grouped AS (SELECT DISTINCT grp, name FROM (SELECT grp, x AS name FROM counted WHERE strongs > 1 UNION ALL SELECT grp, y FROM counted WHERE strongs > 1)),
alone AS (SELECT * FROM counted WHERE strongs <= 1 AND x NOT IN (SELECT name FROM grouped) AND y NOT IN (SELECT name FROM grouped)),
cases AS (SELECT 'g:' || grp AS id, count(*) AS pairs, max(points) AS points, max(relation) AS relation FROM counted WHERE strongs > 1 GROUP BY grp
  UNION ALL SELECT 'p:' || x || '|' || y, 1, points, relation FROM alone),
members AS (SELECT 'g:' || grp AS id, name, 0 AS place FROM grouped UNION ALL SELECT 'p:' || x || '|' || y, x, 0 FROM alone UNION ALL SELECT 'p:' || x || '|' || y, y, 1 FROM alone),
ranked AS (SELECT m.*, a.n, a.last, max(a.last) OVER (PARTITION BY id) AS newest, min(a.last) OVER (PARTITION BY id) AS oldest FROM members m JOIN artists a ON a.artist = m.name),
chosen AS (SELECT id, arg_max(name, ({ms_score('name', 'n', 'last', 'newest', 'oldest')}, -place, n, name)) AS canonical FROM ranked GROUP BY id),
extremes AS (
  SELECT id, arg_max(name, (coalesce(last, 0), n, name)) AS latest, arg_max(last, (coalesce(last, 0), n, name)) AS latest_ms, arg_max(name, (n, name)) AS most, max(n) AS most_n FROM ranked GROUP BY id),
case_pairs AS (SELECT 'g:' || grp AS id, * FROM counted WHERE strongs > 1 UNION ALL SELECT 'p:' || x || '|' || y, * FROM alone),
{titles_of('case_pairs')},
pair_texts AS (
  SELECT p.id, p.points, p.x, p.y, row_number() OVER (PARTITION BY p.id ORDER BY p.points DESC, p.x, p.y) AS place, list_filter([
    CASE p.relation WHEN 'identical' THEN 'Only capitals, accents or punctuation tell “' || p.x || '” from “' || p.y || '”' ELSE '“' || p.y || '” has all words of “' || p.x || '”' END,
    'They share ' || {num('p.shared')} || ' of ' || {num('p.min_tracks')} || ' track(s), ' || floor(p.shared / p.min_tracks * 100 + 0.5::DOUBLE)::BIGINT || '%',
    CASE WHEN p.shared = p.min_tracks AND p.shared > 0 THEN CASE WHEN a.n_tracks <= b.n_tracks THEN 'Every track of “' || p.x || '” is also under “' || p.y || '”' ELSE 'Every track of “' || p.y || '” is also under “' || p.x || '”' END END,
    CASE WHEN p.mix > 0 THEN {num('p.mix')} || ' play(s) of one fall within minutes of plays of the other' END,
    CASE WHEN p.min_tracks < 3 THEN 'A small sample: “' || CASE WHEN a.n_tracks <= b.n_tracks THEN p.x ELSE p.y END || '” has ' || {num('p.min_tracks')} || ' track(s)' END,
    CASE WHEN least(a.last, b.last) > greatest(a.first, b.first) AND a.first IS NOT NULL AND b.first IS NOT NULL
      THEN 'Both were played between ' || {day('greatest(a.first, b.first)')} || ' and ' || {day('least(a.last, b.last)')} END], lambda v: v IS NOT NULL) AS texts
  FROM case_pairs p JOIN artists a ON a.artist = p.x JOIN artists b ON b.artist = p.y),
pair_text AS (SELECT id, t, min(100 * place + k) AS nth FROM (SELECT id, place, unnest(texts) AS t, generate_subscripts(texts, 1) AS k FROM pair_texts WHERE place <= 9) GROUP BY id, t),
spoken AS (SELECT id, list(t ORDER BY nth)[1:9] AS sentences FROM pair_text GROUP BY id),
targets AS (
  SELECT c.*, h.canonical, CASE WHEN r.base IS NOT NULL AND NOT EXISTS (SELECT 1 FROM members m WHERE m.id = h.id AND m.name = r.base) THEN r.base ELSE h.canonical END AS target
  FROM cases c JOIN chosen h USING (id) LEFT JOIN resolved r ON r.artist = h.canonical)"""),
    "e_title_variants": select(f"""
SELECT alternatives, evidence, greatest(k - 14, 0)::BIGINT AS beyond, CASE subtype WHEN 'featuring' THEN 'One form has the featuring credit, the other has not' WHEN 'case_only' THEN 'The forms differ in capitals only' WHEN 'qualifier_formatting' THEN 'The same qualifier, in brackets in one form and after a dash in the other' WHEN 'formatting' THEN 'Equal but for accents, quotes or spaces' WHEN 'version_marker' THEN 'One form says that it is another recording' WHEN 'one_qualified' THEN 'One form has a qualifier, the other has none' WHEN 'different_qualifiers' THEN 'The qualifiers differ' END AS signals, subtype, current, proposed, impact, seen, '“' || artist || '” — ' || k || ' forms of one title' AS title, targets,
  CASE WHEN subtype IN ('version_marker', 'different_qualifiers') THEN 'These may be different recordings: compare them before merging.' ELSE '' END AS warning,
  {points("CASE subtype WHEN 'featuring' THEN 55 WHEN 'case_only' THEN 44 WHEN 'qualifier_formatting' THEN 78 WHEN 'formatting' THEN 85 WHEN 'version_marker' THEN 40 WHEN 'one_qualified' THEN 52 ELSE 38 END + " + log_points('impact', 6, 8))} AS points
FROM varied""", VARIANTS),
    "e_title_typos": select(f"""
SELECT {NO_MORE}, rare || ': ' || {num('n')} || ' play(s), the rarer form | ' || common || ': ' || {num('m')} || ' play(s), the proposed form' AS evidence,
  {said(("true", "'The titles are ' || apart || ' character(s) apart'"), ("shared", "'Both are on the album “' || on_album || '”'"))} AS signals, 'typo' AS subtype, rare AS current, common AS proposed, -n AS seen, 'Is “' || rare || '” really “' || common || '”?' AS title, '' AS warning, [{target('artist', 'rare')}] AS targets, {points("38 + CASE WHEN apart = 1 THEN 14 ELSE 7 END + CASE WHEN shared THEN 16 ELSE 0 END + CASE WHEN shared AND n = 1 THEN 6 ELSE 0 END")} AS points, n AS impact
FROM (SELECT a.artist, a.n, b.n AS m, (SELECT arg_min(p.album, p.seen) FROM track_albums p JOIN track_albums r ON r.artist = p.artist AND r.album = p.album WHERE p.artist = a.artist AND p.track_key = a.track_key AND r.track_key = b.track_key) AS on_album, a.title AS rare, b.title AS common, levenshtein(a.track_key, b.track_key) AS apart,
        EXISTS (SELECT 1 FROM track_albums p JOIN track_albums r ON r.artist = p.artist AND r.album = p.album WHERE p.artist = a.artist AND p.track_key = a.track_key AND r.track_key = b.track_key) AS shared
      FROM fit a JOIN fit b ON a.artist = b.artist AND left(a.track_key, 1) = left(b.track_key, 1) AND a.n < b.n AND a.n <= 3 AND a.track_key <> b.track_key AND a.stripped <> b.stripped
      WHERE levenshtein(a.track_key, b.track_key) <= 2) WHERE apart <= 1 OR shared""",
        f"fit AS (SELECT *, {STRIPPED_ROMAN} AS stripped FROM tracks WHERE length(track_key) >= 4 AND NOT versioned AND NOT {VERSION.format('track_key')})"),
    "e_platform_badges": select(f"""
SELECT '' AS alternatives, greatest(count(*) + count(DISTINCT p.title) - 14, 0)::BIGINT AS beyond, 'The title carries a video page''s badge' AS signals,
  array_to_string(list_concat(list(g.title || ': ' || {num('g.n')} || ' play(s), with a badge' ORDER BY g.n DESC, g.seen), CASE WHEN any_value(p.title) IS NULL THEN [] ELSE [g.clean || ': ' || {num('any_value(p.n)')} || ' play(s)'] END)[1:14], ' | ') AS evidence,
  'platform_badge' AS subtype, min(g.seen) AS seen, count(*) || ' video-page form(s) of “' || g.clean || '”' AS title, 'If the video was played on purpose, leave it.' AS warning,
  list({target('g.artist', 'g.title')} ORDER BY g.n DESC, g.seen) AS targets, string_agg(g.title, '  /  ' ORDER BY g.n DESC, g.seen) AS current, g.clean AS proposed, sum(g.n)::BIGINT AS impact,
  {points(f"55 + {log_points('sum(g.n)', 9, 12)} + CASE WHEN bool_or(p.title IS NOT NULL) THEN 0 ELSE 6 END")} AS points
FROM (SELECT t.*, {strip_badges('s.nt')} AS clean FROM titles t JOIN spelled s ON s.title = t.title JOIN after r ON r.artist = t.artist AND r.title = t.title WHERE r.rest IS NULL AND t.badge) g
LEFT JOIN (SELECT t.* FROM titles t JOIN after r ON r.artist = t.artist AND r.title = t.title WHERE r.rest IS NULL AND NOT t.badge) p ON p.artist = g.artist AND p.track_key = g.track_key AND p.title = g.clean
WHERE g.clean <> '' AND g.clean <> g.title GROUP BY g.artist, g.track_key, g.clean""", REPEATED),
    "e_artist_in_title": select(f"""
SELECT {NO_MORE}, title || ': ' || {num('n')} || ' play(s)' AS evidence,
  {said(("true", "'The title begins with the artist''s name'"), ("CASE WHEN stripped = '' THEN rest ELSE stripped END <> rest", "'It also ends with a video page''s badge'"), ("true", num('n') + " || ' play(s) with this form'"))} AS signals,
  '' AS subtype, seen, 'Title repeats the artist: “' || title || '”' AS title, '' AS warning, [{target('artist', 'title')}] AS targets, artist || ' — ' || title AS current, CASE WHEN stripped = '' THEN rest ELSE stripped END AS proposed, n AS impact, {points(f"62 + {log_points('n', 12, 20)} + CASE WHEN n > 5 THEN 6 ELSE 0 END")} AS points
FROM (SELECT p.artist, p.title, r.rest, {strip_badges('r.rest')} AS stripped, count(*) AS n, min(p.i) AS seen FROM plays p JOIN after r ON r.artist = p.artist AND r.title = p.title WHERE r.rest IS NOT NULL GROUP BY ALL)""", REPEATED),
    "e_album_missing": select(f"""
SELECT '' AS alternatives, greatest(albums + 1 - 14, 0)::BIGINT AS beyond, array_to_string(list_append(all_albums, '(no album): ' || {num('missing')} || ' play(s)')[1:14], ' | ') AS evidence,
  {said(("true", num('missing') + " || ' play(s) of this track have no album'"), ("true", num('n - missing') + " || ' have one, most often “' || album || '”'"), ("after_title", "'The album is named after the track'"))} AS signals, 'missing' AS subtype, seen, 'No album: “' || artist || ' — ' || title || '”' AS title,
  CASE WHEN after_title THEN 'An album named after its track is often a wrong tag: check before filling it in.' ELSE '' END AS warning, [{target('artist', 'title')}] AS targets, title AS current, album AS proposed, missing AS impact,
  {points("CASE WHEN after_title THEN 52 ELSE 78 + CASE WHEN missing >= 3 THEN 8 ELSE 0 END + CASE WHEN album_n / (n - missing) >= 0.8::DOUBLE THEN 6 ELSE 0 END END")} AS points
FROM on_albums WHERE missing > 0""", TRACKED),
    "e_album_clash": select(f"""
SELECT '' AS alternatives, greatest(albums - 14, 0)::BIGINT AS beyond, array_to_string(all_albums[1:14], ' | ') AS evidence,
  {said(("true", "'The title is on ' || " + num('albums') + " || ' albums'"), ("true", "'The most frequent one is “' || album || '”'"))} AS signals,
  'clash' AS subtype, seen, 'Several albums: “' || artist || ' — ' || title || '”' AS title, CASE WHEN after_title THEN 'An album named after its track is often a wrong tag: check which one is right.' ELSE '' END AS warning, [{target('artist', 'title')}] AS targets, title AS current, album AS proposed, impact, {points(f"CASE WHEN after_title THEN least({{0}}, 44.0::DOUBLE) ELSE {{0}} END".format('(48 + ' + log_points('impact', 6, 10) + ')'))} AS points
FROM (SELECT *, n - album_n - missing AS impact FROM on_albums WHERE albums > 1) WHERE impact >= 3""", TRACKED),
    "e_album_name_variants": album_variants(),
    "e_duplicate_plays": select(f"SELECT '' AS alternatives, greatest(plays - 14, 0)::BIGINT AS beyond, 'The closest two are ' || CASE WHEN gap_ms < 59500 THEN floor(gap_ms / 1000.0::DOUBLE + 0.5::DOUBLE)::BIGINT || ' sec' ELSE '1.0 min' END || ' apart' AS signals, (SELECT string_agg(replace(strftime(make_timestamp(p.ts_ms * 1000), '%d %b %Y, %H:%M'), ' Sep ', ' Sept ') || ': ' || CASE p.album WHEN '' THEN '(no album)' ELSE p.album END || CASE WHEN p.i = start THEN ', to keep' ELSE '' END, ' | ' ORDER BY p.i) FROM plays p WHERE p.i BETWEEN start AND start + least(runs.plays, 14) - 1) AS evidence, '' AS subtype, start AS seen, since, plays || ' times in a row: “' || artist || ' — ' || title || '”' AS finding_title, '' AS warning, [{target('artist', 'title')}] AS targets, plays || ' consecutive plays' AS current, 'keep 1' AS proposed, plays - 1 AS impact, CASE WHEN gap_ms <= 15000 THEN 92 ELSE 74 END::INTEGER AS points, artist, title FROM runs", RUNS),
    "e_longtail_typo": select(f"""
SELECT {NO_MORE}, '“' || x || '”: ' || {num('n')} || ' play(s), ' || {days('x_first', 'x_last')} || ' | “' || y || '”: ' || {num('y_n')} || ' play(s), ' || {days('y_first', 'y_last')} || ' | Tracks in common: ' || {num('shared')} AS evidence,
  {said(("inner_name", "'The name is part of “' || y || '”'"), ("NOT inner_name", "'It is ' || apart || ' character(s) from “' || y || '”'"), ("shared > 0", "'They share ' || " + num('shared') + " || ' track(s)'"),
        ("mix > 0", num('mix') + " || ' play(s) fall within minutes of plays of the other'"), ("length(xk) <= 4 AND apart > 0 AND NOT inner_name", "'The name is very short'"), ("garbled", "'The name holds unusual characters'"), ("true", "'Only ' || " + num('n') + " || ' play(s)'"))} AS signals,
  'possible_typo' AS subtype, x AS current, y AS proposed, n AS impact, -n AS seen, 'Is “' || x || '” really “' || y || '”?' AS title, '' AS warning, [{target('x')}] AS targets,
  {points("25 + CASE WHEN inner_name THEN 20 WHEN apart = 1 THEN 15 ELSE 8 END + CASE WHEN shared > 0 THEN 20 ELSE 0 END + CASE WHEN mix > 0 THEN 15 ELSE 0 END - CASE WHEN length(xk) <= 4 AND apart > 0 AND NOT inner_name THEN 10 ELSE 0 END + CASE WHEN garbled THEN 20 ELSE 0 END")} AS points
FROM (SELECT p.x, p.y, p.apart, a.n, b.n AS y_n, a.first AS x_first, a.last AS x_last, b.first AS y_first, b.last AS y_last, a.key AS xk, coalesce(s.shared, 0) AS shared, coalesce(z.mix, 0) AS mix, {contains('b.key', 'a.key')} AS inner_name, regexp_matches(p.x, '[^\\p{{L}}\\p{{N}}\\s''&.,\\-]') AS garbled
      FROM nearest p JOIN artists a ON a.artist = p.x JOIN artists b ON b.artist = p.y LEFT JOIN nearest_shared s ON s.x = p.x AND s.y = p.y LEFT JOIN nearest_mix z ON z.x = p.x AND z.y = p.y)
WHERE (apart <= 2 OR inner_name) AND (shared > 0 OR garbled)""", NEAREST, SHARED.format(name="nearest"), MIX.format(name="nearest")),
    "e_hygiene": select("SELECT problem, count(*) AS n FROM (" + " UNION ALL ".join(
        [f"SELECT '{name} the {f}' AS problem FROM plays WHERE {f} <> '' AND {test.format(f)}" for f in ("artist", "title", "album") for name, test in (
            ("leading or trailing spaces in", f"{{0}} <> trim({{0}}, '{_WHITE}')"), ("double spaces in", f"regexp_matches({{0}}, '[{_WHITE}][{_WHITE}]')"), ("unusual (non-breaking) spaces in", f"regexp_matches({{0}}, '{ODD_SPACES}')"), ("invisible characters in", f"regexp_matches({{0}}, '{UNSEEN}')"))]
        + [f"SELECT 'scrobbles with no {f}' FROM plays WHERE {f} = ''" for f in ("artist", "title", "album")]) + ") GROUP BY problem"),
    "e_empty_albums": select("SELECT artist, title, n FROM (SELECT artist, title, count(*) AS n, min(i) AS seen FROM plays WHERE album = '' GROUP BY artist, title) ORDER BY n DESC, seen LIMIT 40"),
    "e_rare_artists": select("SELECT artist, n, first AS first_ms, last AS last_ms FROM artists WHERE n <= 2"),
    "f_meta": select(f"SELECT count(*) AS plays, count(ts_ms) AS dated, min(ts_ms) AS from_ms, max(ts_ms) AS to_ms, (SELECT count(*) FROM artists) AS artists, (SELECT count(*) FROM (SELECT DISTINCT artist, track_key FROM plays)) AS tracks, (SELECT count(DISTINCT {key('album')}) FROM plays WHERE album <> '') AS albums FROM plays"),
}

UNTIDY = select("SELECT problem, sum(n)::BIGINT AS n, list(value ORDER BY seen, value)[1:8] AS examples FROM (SELECT problem, value, count(*) AS n, min(i) AS seen FROM (" + " UNION ALL ".join(
        [f"SELECT i, '{name} the {f}' AS problem, translate(regexp_replace(regexp_replace({f}, '^[{_WHITE}]+', '␣'), '[{_WHITE}]+$', '␣'), '{_WHITE.replace(' ', '')}', '{'␣' * (len(_WHITE) - 1)}') AS value FROM plays WHERE {f} <> '' AND {test.format(f)}" for f in ("artist", "title", "album") for name, test in (
            ("leading or trailing spaces in", f"{{0}} <> trim({{0}}, '{_WHITE}')"), ("double spaces in", f"regexp_matches({{0}}, '[{_WHITE}][{_WHITE}]')"), ("unusual (non-breaking) spaces in", f"regexp_matches({{0}}, '{ODD_SPACES}')"), ("invisible characters in", f"regexp_matches({{0}}, '{UNSEEN}')"))]
        + [f"SELECT i, 'scrobbles with no {f}', '(empty)' FROM plays WHERE {f} = ''" for f in ("artist", "title", "album")]) + ") GROUP BY problem, value) GROUP BY problem")
EMPTY = select("SELECT artist, title, n, seen FROM (SELECT artist, title, count(*) AS n, min(i) AS seen FROM plays WHERE album = '' GROUP BY artist, title) ORDER BY n DESC, seen LIMIT 40")

#: The detectors' SQL with all that the report shows, in the order in which equal findings are listed, and the type of each.
KINDS = {
    "e_duplicate_artists": (1, "duplicate_artists"), "e_similar_names": (2, "duplicate_artists"), "e_combined_artists": (3, "combined_artists"),
    "e_title_variants": (4, "title_variants"), "e_platform_badges": (5, "title_variants"), "e_title_typos": (6, "title_variants"), "e_artist_in_title": (7, "artist_in_title"),
    "e_album_missing": (8, "albums"), "e_album_clash": (8, "albums"), "e_album_name_variants": (9, "albums"), "e_duplicate_plays": (10, "duplicate_scrobbles"), "e_longtail_typo": (11, "long_tail"),
}
DETAILED = {name: ORACLES[name] for name in KINDS}
ORACLES |= {name: f"SELECT subtype, current, proposed, points, impact FROM ({sql})" for name, sql in DETAILED.items()}
ORACLES["e_duplicate_plays"] = f"SELECT subtype, current, proposed, points, impact, targets[1].artist AS artist, targets[1].track AS title FROM ({DETAILED['e_duplicate_plays']})"


def _report() -> str:
    """The report's findings from the detectors' SQL: what joined names cover is left out, as are weak ones and album spellings past the cap."""
    columns = "subtype, current, proposed, points, impact, seen, title, warning, targets, alternatives, signals, evidence, beyond, {} AS since"
    named = DETAILED | {"e_duplicate_plays": f"SELECT * EXCLUDE (title, finding_title), finding_title AS title FROM ({DETAILED['e_duplicate_plays']})"}
    named["e_album_name_variants"] = f"SELECT * FROM ({named['e_album_name_variants']}) ORDER BY impact DESC, seen LIMIT 60"
    parts = [f"SELECT {n} AS detector, '{kind}' AS type, {columns.format('since' if name == 'e_duplicate_plays' else 'NULL::BIGINT')} FROM ({named[name]})" for name, (n, kind) in KINDS.items()]
    messy, commas = "problem <> 'scrobbles with no album'", "format('{:,}', n)"
    note = "SELECT {} AS detector, 'long_tail' AS type, '{}' AS subtype, {} AS current, {} AS proposed, {} AS points, {} AS impact, 0 AS seen, {} AS title, '' AS warning, [] AS targets, '' AS alternatives, {} AS signals, {} AS evidence, 0::BIGINT AS beyond, NULL::BIGINT AS since FROM ({}) WHERE n > 0"
    shown = f"array_to_string(list(problem || ': ' || {num('n')} || ': ' || array_to_string(list_transform(examples, lambda v: '“' || v || '”'), ', ') ORDER BY n DESC, problem), ' | ')"
    notes = [
        note.format(12, "hygiene", "'various tags'", "'(normalise)'", 70, "n", f"'Untidy text: ' || {commas} || ' plays'", "said", "shown",
                    f"SELECT sum(n)::BIGINT AS n, {shown} AS shown, array_to_string(list({num('n')} || ' × ' || problem ORDER BY n DESC, problem)[1:6], ' | ') AS said FROM ({UNTIDY}) WHERE {messy}"),
        note.format(13, "empty", f"{commas} || ' scrobbles with no album'", "'(only if you know which one)'", 45, 0, f"{commas} || ' scrobbles with no album'", "'A missing album need not be a mistake'",
                    f"(SELECT string_agg(CASE WHEN artist = '' THEN ' — ' || title ELSE artist || ' — ' || title END || ': ' || {num('n')}, ' | ' ORDER BY n DESC, seen) FROM ({EMPTY}))", f"SELECT n FROM ({ORACLES['e_hygiene']}) WHERE NOT {messy}"),
        note.format(14, "rare_artists", f"{commas} || ' artists'", "'(review by hand)'", 0, 0, f"{commas} || ' artists with 2 scrobble(s) or fewer'", "'Misspellings often hide here'",
                    f"(SELECT string_agg(artist || ': ' || {num('n')}, ' | ' ORDER BY n DESC, artist) FROM (SELECT * FROM ({ORACLES['e_rare_artists']}) ORDER BY n DESC, artist LIMIT 400))", f"SELECT count(*) AS n FROM ({ORACLES['e_rare_artists']})"),
    ]
    order = ", ".join(f"'{t}'" for t in TYPES)
    return f"""
WITH every AS MATERIALIZED ({' UNION ALL '.join(parts)}),
absorbed AS (SELECT DISTINCT unnest(string_split(current, '  /  ')) AS name, proposed FROM every WHERE type = 'combined_artists'),
names AS (SELECT row_number() OVER () AS no, * FROM every WHERE type = 'duplicate_artists'),
uncovered AS (
  SELECT DISTINCT n.no FROM (SELECT no, proposed, unnest(string_split(current, '  /  ')) AS name FROM names) n
  LEFT JOIN absorbed a ON a.name = n.name AND a.proposed = n.proposed WHERE a.name IS NULL),
standing AS (SELECT * FROM every WHERE type <> 'duplicate_artists' UNION ALL SELECT * EXCLUDE (no) FROM names WHERE no IN (SELECT no FROM uncovered)),
listed AS (SELECT *, false AS informational FROM standing WHERE points >= 40 UNION ALL SELECT *, true FROM ({' UNION ALL '.join(notes)})),
graded AS (
  SELECT *, CASE WHEN points >= 60 THEN 'high' WHEN points >= 40 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN type = 'combined_artists' THEN 'split_combined' WHEN type = 'artist_in_title' THEN 'strip_artist_from_title' WHEN type = 'duplicate_scrobbles' THEN 'delete_duplicate'
         WHEN subtype = 'similar_names' THEN 'review_artist' WHEN type = 'duplicate_artists' OR subtype = 'possible_typo' THEN 'rename_artist' WHEN type = 'long_tail' THEN 'review'
         WHEN subtype = 'case_only' THEN 'review_capitalisation' WHEN subtype IN ('version_marker', 'different_qualifiers') THEN 'review_track' WHEN type = 'title_variants' THEN 'rename_track'
         WHEN subtype = 'missing' THEN 'fill_album' WHEN subtype = 'clash' THEN 'review_album' ELSE 'merge_album' END AS action
  FROM listed),
digested AS (
  SELECT *, left(sha256(concat_ws(chr(31), type, subtype, proposed, coalesce(since::VARCHAR, ''),
    coalesce(array_to_string(list_transform(targets, lambda t: concat_ws(chr(31), t.artist, coalesce(t.track, ''), coalesce(t.album, ''))), chr(31)), ''))), 16) AS content FROM graded),
findings AS (
  SELECT *, row_number() OVER (ORDER BY list_position([{order}], type), list_position(['high', 'medium', 'low'], confidence), impact DESC, points DESC, detector, seen, current, proposed, title, content) - 1 AS place,
    NOT starts_with(action, 'review') AS actionable, row_number() OVER (PARTITION BY content ORDER BY seen, current) AS again
  FROM digested)
"""


_REPORT = _report()
_LABELS = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in TYPES.items())
#: What each finding touches, by what kind of thing its targets are.
_TOUCHED = f"""
aims AS (SELECT detector, subtype, proposed, seen, impact, unnest(targets) AS t FROM findings),
aimed AS (SELECT detector, subtype, proposed, seen, impact, t.artist AS artist, t.track AS track, t.album AS album FROM aims),
log AS MATERIALIZED ({select("SELECT *, CASE WHEN album <> '' THEN " + key("album") + " END AS album_key FROM plays")})"""
_ENCODED = "replace(url_encode({}), '%20', '+')"
ORACLES |= {
    "f_findings": _REPORT + """
SELECT place, type || ':' || subtype || '|' || current || '|' || proposed || '#' || content || CASE WHEN again > 1 THEN '-' || again ELSE '' END AS id, type, subtype, title, points::INTEGER AS points, confidence, impact::BIGINT AS impact, action, actionable, informational,
       current, proposed, warning FROM findings""",
    "f_summary_by_type": _REPORT + f"""
SELECT type, CASE type {_LABELS} END AS label, count(*) AS findings, sum(impact)::BIGINT AS impact, count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'medium') AS medium,
       count(*) FILTER (WHERE confidence = 'low') AS low, count(*) FILTER (WHERE actionable) AS actionable
FROM findings GROUP BY type""",
    "f_trimmed": _REPORT + f"""
SELECT 'omitted' AS counter, count(*) AS n FROM standing WHERE points < 40
UNION ALL SELECT 'covered_by_stronger', (SELECT count(*) FROM names) - (SELECT count(*) FROM uncovered)
UNION ALL SELECT 'album_name_variants_beyond_cap', greatest(count(*) - 60, 0) FROM ({DETAILED['e_album_name_variants']})
UNION ALL SELECT 'album_clashes_below_threshold', count(*) FROM ({select('SELECT 1 FROM on_albums WHERE albums > 1 AND n - album_n - missing < 3', TRACKED)})
UNION ALL SELECT 'artist_pairs_without_shared_track', count(*) FROM ({select('SELECT 1 FROM inside LEFT JOIN inside_shared USING (x, y) WHERE coalesce(shared, 0) = 0', INSIDE, SHARED.format(name='inside'))})""",
    "f_affected_rows": _REPORT + "," + _TOUCHED + """
SELECT DISTINCT i FROM (
  SELECT l.i FROM aimed a JOIN log l ON l.artist = a.artist WHERE a.detector IN (1, 2, 3, 11)
  UNION ALL SELECT l.i FROM aimed a JOIN log l ON l.artist = a.artist AND l.title = a.track WHERE a.detector IN (4, 5, 6, 7)
  UNION ALL SELECT l.i FROM aimed a JOIN (SELECT DISTINCT title, track_key FROM log) s ON s.title = a.track JOIN log l ON l.artist = a.artist AND l.track_key = s.track_key
    WHERE a.detector = 8 AND CASE a.subtype WHEN 'missing' THEN l.album = '' ELSE l.album NOT IN ('', a.proposed) END
  UNION ALL SELECT l.i FROM aimed a JOIN (SELECT DISTINCT album, album_key FROM log) s ON s.album = a.album JOIN log l ON l.artist = a.artist AND l.album_key = s.album_key WHERE a.detector = 9
  UNION ALL SELECT unnest(generate_series(seen + 1, seen + impact)) FROM aimed WHERE detector = 10)""",
    "g_actions_csv": _REPORT + f"""
SELECT place, type, subtype, confidence, points::INTEGER AS points, CASE action {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())} END AS action, CASE WHEN actionable THEN 'yes' ELSE 'no' END AS actionable, impact::BIGINT AS impact_scrobbles,
  current AS current_value, proposed AS proposed_value, alternatives, signals, 'pending' AS decision, evidence FROM findings""",
    "e_evidence": _REPORT + "SELECT place, type, subtype, current, proposed, evidence, beyond FROM findings",
    "e_signals": _REPORT + "SELECT place, type, subtype, current, proposed, signals FROM findings",
    "g_profile_urls": _REPORT + f"""
SELECT place, concat_ws(' — ', t.artist, coalesce(t.track, t.album)) AS label, CASE WHEN t.artist = '' THEN '' ELSE 'https://example.org/user/someone/library/music/' || {_ENCODED.format('t.artist')}
       || CASE WHEN t.track IS NOT NULL THEN '/_/' || {_ENCODED.format('t.track')} WHEN t.album IS NOT NULL THEN '/' || {_ENCODED.format('t.album')} ELSE '' END END AS url
FROM (SELECT place, unnest(targets) AS t FROM findings)""",
    "f_choices": f"""
WITH own AS ({DETAILED['e_similar_names']})
SELECT subtype, proposed AS current, current AS proposed, other_n AS impact, CASE subtype
  WHEN 'similar_with_tracks' THEN 'Change the artist of ' || format('{{:,}}', other_n) || ' play(s) from “' || proposed || '” to “' || current || '”; look at one of them first.'
  ELSE '“' || proposed || '” and “' || current || '” look alike but share no track: make sure before changing ' || format('{{:,}}', other_n) || ' play(s).' END AS how_to FROM own""",
    "c_canonical_rules": select("SELECT key, arg_max(artist, (coalesce(last, 0), n, artist)) AS recent, arg_max(artist, (n, artist)) AS frequent FROM artists GROUP BY key"),
    "e_hygiene_examples": f"SELECT problem, n, array_to_string(examples, ' | ') AS examples FROM ({UNTIDY})",
    "b_display": select("""
SELECT i, format('{:,}', ts_ms) AS number, floor((i % 1000) / 1000.0::DOUBLE * 100 + 0.5::DOUBLE)::BIGINT || '%' AS percent, upper(left(title, 1)) || substr(title, 2) AS capitalised,
  replace(strftime(make_timestamp(ts_ms * 1000), '%d %b %Y'), ' Sep ', ' Sept ') AS day, replace(strftime(make_timestamp(ts_ms * 1000), '%d %b %Y, %H:%M'), ' Sep ', ' Sept ') AS minute,
  CASE WHEN s < 60 THEN s || ' sec' WHEN s < 600 THEN ((s * 10 + 30) // 60 // 10) || '.' || ((s * 10 + 30) // 60 % 10) || ' min' WHEN s < 3600 THEN ((s + 30) // 60) || ' min'
       WHEN s < 36000 THEN ((s * 10 + 1800) // 3600 // 10) || '.' || ((s * 10 + 1800) // 3600 % 10) || ' h' WHEN s < 86400 THEN ((s + 1800) // 3600) || ' h'
       WHEN s < 864000 THEN ((s * 10 + 43200) // 86400 // 10) || '.' || ((s * 10 + 43200) // 86400 % 10) || ' days' WHEN s < 5184000 THEN ((s + 43200) // 86400) || ' days'
       ELSE floor(s / 86400.0::DOUBLE / 30.44::DOUBLE + 0.5::DOUBLE)::BIGINT || ' months' END AS duration
FROM (SELECT *, i * 17 AS s FROM plays)"""),
    "a_csv_folder": select(f"""
SELECT {norm('artist')} AS artist, {norm('album')} AS album, {norm("title || CASE WHEN i % 9 = 0 THEN ' \"a; b, c\" 2' ELSE '' END")} AS title, ts_ms // 1000 * 1000 AS ts_ms FROM plays"""),
    "a_csv_plays": select(f"""
SELECT {norm('artist')} AS artist, {norm('album')} AS album, 'id-' || i % 5 AS album_id, {norm("title || CASE WHEN i % 7 = 0 THEN ' \"take; 2\"' WHEN i % 11 = 0 THEN chr(10) || 'part' ELSE '' END")} AS title,
  CASE WHEN i % 10 = 3 THEN NULL WHEN i % 3 = 2 THEN ts_ms // 60000 * 60000 WHEN i % 3 = 0 THEN ts_ms // 1000 * 1000 ELSE ts_ms END AS ts_ms FROM plays"""),
}
