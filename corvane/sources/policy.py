"""A repository's policy: which documents belong, which header fields and values they may have; strict reading and cross-checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .header_yaml import HeaderError, parse_header

MAX_BYTES = 64 * 1024

# Sections with their keys, lists of documents in the order of their classes, and classes of coverage.
SECTIONS = {
    "frontmatter": ["required", "optional", "allowed", "preserved_canonical_keys", "canonical_docs_frontmatter_state"],
    "document_coverage": ["roots", "native_bundle", "canonical_documents", "legacy_documents", "excluded_documents", "bridge_targets"],
    "source_links": ["require_prefix"],
    "tags": ["allowed"],
    "status": ["allowed"],
    "public_boundary": ["values", "path_allowlist", "exact_allowlist"],
}
DOCUMENT_CLASSES = ["native_bundle", "canonical_documents", "legacy_documents", "bridge_targets", "excluded_documents"]
COVERAGE = ["canonical", "legacy", "excluded", "unclassified"]
MIGRATIONS = ["legacy_baseline", "strict"]


class PolicyError(ValueError):
    """Why a policy isn't taken."""


@dataclass(frozen=True)
class Policy:
    """Sections by name; a section that the policy lacks is absent, and checks that need it don't run."""

    sections: dict[str, dict] = field(default_factory=dict)
    coverage: tuple[str, ...] = ()

    def has(self, section: str) -> bool:
        """Whether the policy has a section."""
        return section in self.sections

    def get(self, section: str, key: str, default=()):
        """A value of a section, the default if the section or the key is absent."""
        return self.sections.get(section, {}).get(key, default)

    @property
    def excluded(self) -> list[str]:
        """Documents that are left out, whatever the reason."""
        return sorted(self.get("document_coverage", "excluded_documents", {}))

    @property
    def classified(self) -> list[str]:
        """Documents that the policy names as native, canonical or legacy."""
        return sorted({p for name in DOCUMENT_CLASSES[:3] for p in self.get("document_coverage", name)})

    def fields(self, canonical_only: bool = False) -> list[str]:
        """Header fields that are allowed: required, optional and allowed ones, and for documents that are canonical only the preserved ones too."""
        keys = ["required", "optional", "allowed", *["preserved_canonical_keys"] * canonical_only]
        return sorted({x for key in keys for x in self.get("frontmatter", key)})


def safe_path(path: str) -> bool:
    """Whether a path is relative to its root and doesn't leave it."""
    drive = re.match(r"[A-Za-z]:", path)
    return bool(path) and "\0" not in path and not drive and not path.startswith(("/", "\\")) and ".." not in path.split("/")


def _strings(value: object, name: str) -> list[str]:
    if not isinstance(value, list) or any(isinstance(x, dict | list) or x is None for x in value):
        raise PolicyError(f"{name} must be a sequence of values")
    return [str(x).lower() if isinstance(x, bool) else str(x) for x in value]


def _paths(paths: list[str], name: str) -> None:
    if not all(map(safe_path, paths)):
        raise PolicyError(f"{name} holds an unsafe path")
    if len(set(paths)) < len(paths):
        raise PolicyError(f"{name} holds a path twice")


def parse_policy(text: str) -> Policy:
    """The policy in a text; raises PolicyError for unknown keys, wrong shapes, unsafe or doubled paths and documents of several classes."""
    if len(text.encode()) > MAX_BYTES:
        raise PolicyError("too large")
    try:
        raw = parse_header(text)
    except HeaderError as reason:
        raise PolicyError(f"malformed: {reason}") from None
    if str(raw.get("schema_version")) != "1":
        raise PolicyError("schema_version must be 1")
    unknown = set(raw) - {*SECTIONS, "schema_version", "coverage"}
    if unknown:
        raise PolicyError(f"unknown field {sorted(unknown)[0]}")
    coverage = _strings(raw.get("coverage", []), "coverage")
    if set(coverage) - set(COVERAGE):
        raise PolicyError("an unknown class of coverage")
    sections: dict[str, dict] = {}
    for name, keys in SECTIONS.items():
        if name not in raw:
            continue
        if not isinstance(raw[name], dict):
            raise PolicyError(f"{name} must be a mapping")
        if set(raw[name]) - set(keys):
            raise PolicyError(f"unknown field in {name}")
        own = {}
        for key, value in raw[name].items():
            if key in ("require_prefix", "canonical_docs_frontmatter_state"):
                if not isinstance(value, str):
                    raise PolicyError(f"{name}.{key} must be a string")
                own[key] = value
            elif key in ("excluded_documents", "exact_allowlist"):
                if not isinstance(value, dict):
                    raise PolicyError(f"{name}.{key} must be a mapping")
                own[key] = value
            else:
                own[key] = _strings(value, f"{name}.{key}")
        sections[name] = own
    if sections.get("frontmatter", {}).get("canonical_docs_frontmatter_state", MIGRATIONS[0]) not in MIGRATIONS:
        raise PolicyError("an unknown state of migration")
    covered = sections.get("document_coverage", {})
    _paths(covered.get("roots", []), "roots")
    _paths(sections.get("public_boundary", {}).get("path_allowlist", []), "path_allowlist")
    seen: dict[str, str] = {}
    for name in DOCUMENT_CLASSES:
        paths = list(covered.get(name, []))
        _paths(paths, name)
        for path in paths:
            if path in seen:
                raise PolicyError(f"{path} is in {seen[path]} and in {name}")
            seen[path] = name
    if any(not str(reason or "").strip() for reason in covered.get("excluded_documents", {}).values()):
        raise PolicyError("an exclusion without a reason")
    if set(sections.get("public_boundary", {}).get("exact_allowlist", {})) - set(covered.get("bridge_targets", [])):
        raise PolicyError("an exact allowlist for a path that is no bridge target")
    return Policy(sections, tuple(coverage))
