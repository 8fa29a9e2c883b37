"""Search filters: one description, applied to documents before candidates are cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchFilters:
    """What a found document must satisfy; None and empty values ask nothing.

    languages: one of them; tags: at least one in common, or all with ``all_tags``; hidden_sources:
    none of them; source: this one; created: from and to, either may be None; least_chars, least_score,
    has_code, accepted, section as named; searchable: only active or outdated, chunked and unique documents.
    """

    languages: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    all_tags: bool = False
    hidden_sources: tuple[str, ...] = ()
    created: tuple[object, object] = (None, None)
    least_chars: int | None = None
    has_code: bool | None = None
    accepted: bool | None = None
    source: str | None = None
    section: str | None = None
    least_score: int | None = None
    searchable: bool = False

    def column(self, names: dict[str, str | Column]) -> Column:
        """The condition over a table whose columns ``names`` maps: language, tags, source, created, chars, code, accepted, section, score, status, processing, deduplication."""
        c = {k: F.col(v) if isinstance(v, str) else v for k, v in names.items()}
        asked: list[Column] = []
        if self.languages:
            asked.append(c["language"].isin(*self.languages))
        if self.tags:
            wanted = F.array(*map(F.lit, self.tags))
            asked.append(F.size(F.array_except(wanted, c["tags"])) == 0 if self.all_tags else F.arrays_overlap(c["tags"], wanted))
        if self.hidden_sources:
            asked.append(~F.coalesce(c["source"].isin(*self.hidden_sources), F.lit(False)))
        first, last = self.created
        if first is not None:
            asked.append(c["created"] >= F.lit(first))
        if last is not None:
            asked.append(c["created"] <= F.lit(last))
        asked += [c[k] >= least for k, least in (("chars", self.least_chars), ("score", self.least_score)) if least is not None]
        if self.searchable:
            asked += [c["status"].isin("ACTIVE", "OUTDATED"), c["processing"] == "CHUNKED", c["deduplication"] == "UNIQUE"]
        asked += [c[k] == F.lit(v) for k, v in (("code", self.has_code), ("accepted", self.accepted), ("source", self.source), ("section", self.section)) if v is not None]
        out = F.lit(True)
        for condition in asked:
            out = out & condition
        return F.coalesce(out, F.lit(False))
