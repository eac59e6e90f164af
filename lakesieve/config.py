"""The policy of a run."""

from __future__ import annotations

from dataclasses import dataclass, field

from lakesieve import fixed

ALL_TYPES = frozenset(fixed.PRIORITIES)
SCOPES, IMAGE_POLICIES = ("all", "parties", "none"), ("sensitive", "all", "none")


@dataclass(frozen=True)
class Config:
    """types: kinds to look for; company_scope: all companies, known parties alone, or none; seed: of the substitutes;
    use_ner: whether findings of a named-entity model are used; image_policy: which pictures are replaced; force: also packages
    that are marked as done; known_sections: inclusive paragraph ranges of the main part that list parties; per_document:
    whether a value has one substitute a document, or one everywhere."""

    types: frozenset[str] = ALL_TYPES
    company_scope: str = "all"
    seed: int = 42
    use_ner: bool = True
    image_policy: str = "sensitive"
    force: bool = False
    known_sections: tuple[tuple[int, int], ...] = ()
    protected_from: int = 0
    per_document: bool = False
    allowlist: tuple[str, ...] = field(default=fixed.ALLOWLIST, repr=False)

    def __post_init__(self) -> None:
        if unknown := set(self.types) - ALL_TYPES:
            raise ValueError(f"unknown types: {', '.join(sorted(unknown))}")
        if self.company_scope not in SCOPES:
            raise ValueError(f"company_scope must be one of {', '.join(SCOPES)}")
        if self.image_policy not in IMAGE_POLICIES:
            raise ValueError(f"image_policy must be one of {', '.join(IMAGE_POLICIES)}")
        if self.company_scope == "none":
            object.__setattr__(self, "types", frozenset(self.types) - {"COMPANY"})
