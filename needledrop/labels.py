"""Finding types in report order, their sub-cases, and the actions with what to do about them."""

from __future__ import annotations

TYPES = {
    "duplicate_artists": "Duplicate artists",
    "combined_artists": "Combined artists",
    "title_variants": "Inconsistent track titles",
    "artist_in_title": "Artist repeated in title",
    "albums": "Albums",
    "duplicate_scrobbles": "Duplicate scrobbles",
    "long_tail": "Long tail and oddities",
}
SUBTYPES = {
    ("duplicate_artists", "identical"): "Identical names bar formatting",
    ("duplicate_artists", "containment"): "One name contained in the other",
    ("duplicate_artists", "group"): "Several forms of the same artist",
    ("duplicate_artists", "similar_with_tracks"): "Very similar names that share tracks",
    ("duplicate_artists", "similar_names"): "Very similar names with no shared track",
    ("combined_artists", ""): "Name joining several artists",
    ("title_variants", "case_only"): "Capitalisation only",
    ("title_variants", "formatting"): "Formatting only",
    ("title_variants", "qualifier_formatting"): "Qualifier written differently",
    ("title_variants", "featuring"): "Featuring credit in one form only",
    ("title_variants", "typo"): "Probably a typo in the title",
    ("title_variants", "platform_badge"): "Titles carrying a platform badge",
    ("title_variants", "version_marker"): "Probably a different version (live, remix…)",
    ("title_variants", "one_qualified"): "With and without a qualifier",
    ("title_variants", "different_qualifiers"): "Different qualifiers",
    ("artist_in_title", ""): "Artist repeated inside the title",
    ("albums", "missing"): "No album (another scrobble has one)",
    ("albums", "name_variants"): "Album name written in several ways",
    ("albums", "case_only"): "Capitalisation only",
    ("albums", "clash"): "Several albums for the same title",
    ("duplicate_scrobbles", ""): "Consecutive repeats of the same track",
    ("long_tail", "possible_typo"): "Probably a typo in the artist name",
    ("long_tail", "hygiene"): "Formatting details inside tags",
    ("long_tail", "empty"): "Scrobbles with no album",
    ("long_tail", "rare_artists"): "Artists with two scrobbles or fewer",
}
ACTIONS = {
    "rename_artist": "Rename artist",
    "split_combined": "Review combined artist",
    "rename_track": "Merge track title",
    "strip_artist_from_title": "Remove artist from title",
    "fill_album": "Fill in album",
    "merge_album": "Merge album name",
    "review_album": "Review album",
    "review_capitalisation": "Review capitalisation",
    "delete_duplicate": "Delete duplicate",
    "review_artist": "Review artist name",
    "review_track": "Review track title",
    "review": "Review",
}
#: Actions that may well need nothing done: they don't count as work.
ADVISORY = ("review_album", "review_capitalisation", "review_artist", "review_track", "review")
#: What to do, with {current}, {proposed} and {impact}.
HOW_TO = {
    "rename_artist": "Change the artist of {impact} play(s) from “{current}” to “{proposed}”; look at one of them first.",
    "split_combined": "“{current}” seems to join several artists. Unless it is a real group, file its {impact} play(s) under “{proposed}”.",
    "rename_track": "Change the title of {impact} play(s) from “{current}” to “{proposed}”.",
    "strip_artist_from_title": "The title repeats the artist: change it to “{proposed}”.",
    "fill_album": "Fill in “{proposed}” as the album of {impact} play(s) of “{current}”.",
    "merge_album": "Settle on one spelling of the album, most likely “{proposed}”, for {impact} play(s).",
    "review_album": "{impact} play(s) of this title sit on other albums; a single beside an album is fine.",
    "review_capitalisation": "Optional: “{current}” and “{proposed}” differ in capitals only ({impact} play(s)).",
    "delete_duplicate": "Delete the {impact} extra play(s) if they were logged by accident.",
    "review_artist": "“{current}” and “{proposed}” look alike but share no track: make sure before changing {impact} play(s).",
    "review_track": "“{current}” may be another recording than “{proposed}”: compare before changing {impact} play(s).",
    "review": "Nothing to do automatically.",
}
