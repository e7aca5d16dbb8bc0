"""Every threshold of the audit in one immutable object; a run takes overrides, nothing is changed globally."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Rules:
    """The defaults of all thresholds."""

    canonical: str = "score"  # or "recent", "frequent"
    high_threshold: int = 60
    medium_threshold: int = 40
    minimum_confidence: str = "medium"
    require_shared_track: bool = True
    similar_name_threshold: float = 0.875
    similar_name_distance: int = 2
    similar_name_length: int = 5
    abbreviation_length: int = 4
    abbreviation_extension: int = 2
    repeat_window_ms: int = 60_000
    repeat_certain_ms: int = 15_000
    sitting_window_ms: int = 600_000
    album_clash_impact: int = 3
    rare_artist_plays: int = 2
    frequent_artist_plays: int = 20
    typo_distance: int = 2
    album_variants_listed: int = 60
    title_typo_distance: int = 1
    title_typo_distance_with_album: int = 2
    rare_title_plays: int = 3
    title_typo_length: int = 4
    evidence_items: int = 14
    table_rows: int = 400

    def override(self, **changes) -> Rules:
        """These rules with some changed; unknown names are ignored."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in changes.items() if k in known})

    @property
    def minimum_points(self) -> int:
        return {"high": self.high_threshold, "low": 0}.get(self.minimum_confidence, self.medium_threshold)
