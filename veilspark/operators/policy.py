"""What to mask: profiles and explicit choices."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from veilspark.functions.labels import CONTEXT_ENTITIES, PATTERN_ENTITIES
from veilspark.functions.text import EDGES


@dataclass(frozen=True)
class Policy:
    entities: tuple[str, ...]
    min_masked_age: int = 0
    mask_providers: bool = True
    min_score: float = 0.4
    allowlist: tuple[str, ...] = ()
    #: How a tag is written, and whether entities have their short names in it.
    tag_template: str = "<{entity}#{index}>"
    short_names: bool = True

    @property
    def allowed(self) -> tuple[str, ...]:
        """The allowlist as values are compared: normalized phrases."""
        return tuple(sorted({k for a in self.allowlist if (k := normalized(a))}))


def normalized(value: str) -> str:
    """What functions.text.normalize gives for a value."""
    return " ".join(re.sub(r"[,;|]+", " ", value).split()).strip(EDGES).casefold()


PROFILES = {
    "general": Policy(PATTERN_ENTITIES + CONTEXT_ENTITIES),
    "hipaa-safe-harbor": Policy(tuple(e for e in PATTERN_ENTITIES + CONTEXT_ENTITIES if e != "GENERIC_ID"), 90, False),
}


def policy(profile: str = "general", entities: tuple[str, ...] | None = None, mask_organizations: bool = False, **chosen) -> Policy:
    """A profile with explicit choices on top; an explicit empty list of entities stays empty. Unknown profile: ValueError."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; there are {', '.join(PROFILES)}")
    base = PROFILES[profile]
    if entities is not None:
        base = replace(base, entities=tuple(entities))
    elif mask_organizations:
        base = replace(base, entities=(*base.entities, "ORGANIZATION"))
    return replace(base, **{k: tuple(v) if k == "allowlist" else v for k, v in chosen.items() if v is not None})
