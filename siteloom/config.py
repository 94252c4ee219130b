"""Run settings: a TOML file held against a table of what may stand in it."""

from __future__ import annotations

import hashlib
import tomllib
from collections.abc import Iterator
from pathlib import Path

from siteloom.functions import vocab as v

# The keys of a configuration. A path is read by a run ("read"), written by it ("made"), or only named.
PATHS = {
    "pairs_master": "read", "homology_qc": "read", "uniprot_tsv": "read", "structure_manifest": "read", "structure_dir": "read",
    "proteins_master": "named", "existing_structural_context": "named", "cache_dir": "made", "results_dir": "made",
}
# The other sections with the value that a key has when it isn't given. An empty text is "none".
DEFAULTS = {
    "layers": {"uniprot": True, "glygen": False, "glyconnect": False, "structure": False},
    "policy": {
        "qualifying_uniprot_tiers": ["manual_experimental", "manual_combinatorial"], "qualifying_glygen_tiers": ["glygen_reported_with_glycan", "glygen_reported_independent"],
        "qualifying_structure_tiers": ["structure_linked_glycan"], "glyconnect_qualifies": False, "observed_unmodified_from_internal_control": True,
        "curator_inferred_sensitivity": True, "require_analysis_ready": True, "strict_buckets": ["strict_ortholog_like"], "plausible_buckets": ["plausible_ortholog_like"],
    },
    "api": {
        "glygen_url": "", "glyconnect_search_url": "", "glyconnect_detail_url": "", "uniprot_search_url": "", "structure_url": "",
        "delay_seconds": 0.4, "timeout_seconds": 60, "max_retries": 3, "structures_per_accession": 20,
    },
}
# What a list of tiers may hold.
TIERS = {"qualifying_uniprot_tiers": v.ANNOTATION_TIERS, "qualifying_glygen_tiers": v.GLYCAN_TIERS, "qualifying_structure_tiers": tuple(v.STRUCTURE_RANK)}


def leaves(tree: dict, above: str = "") -> Iterator[tuple[str, object]]:
    """Dotted names and values of nested tables."""
    for name, value in tree.items():
        if isinstance(value, dict):
            yield from leaves(value, f"{above}{name}.")
        else:
            yield above + name, value


def digest(tree: dict) -> str:
    """SHA-256 over the sorted lines "name=value": layout, comments and order of the file don't count."""
    lines = sorted(f"{name}={value!r}" for name, value in leaves(tree))
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def read_text(text: str, folder: str | Path = ".") -> dict:
    """SRC19: the settings of a TOML text; relative paths start from ``folder``, missing keys get their defaults."""
    given = tomllib.loads(text)
    out = {section: known | given.get(section, {}) for section, known in DEFAULTS.items()}
    out["paths"] = {name: Path(folder, place).resolve() for name, place in given.get("paths", {}).items()}
    return out | {"given": given, "digest": digest(given)}


def read(path: str | Path) -> dict:
    path = Path(path).resolve()
    return read_text(path.read_text(), path.parent)


def _kind(value: object) -> type:
    return float if isinstance(value, int | float) and not isinstance(value, bool) else type(value)


def problems(settings: dict) -> list[str]:
    """What is wrong with the settings, sorted: sections and keys that nothing reads, values of the wrong kind, inputs that aren't there.

    A misspelt key would change nothing in silence, so it is an error.
    """
    found, given = [], settings["given"]
    found += [f"[{s}] is no section" for s in given if s != "paths" and s not in DEFAULTS]
    found += [f"[paths] {k} is no key" for k in given.get("paths", {}) if k not in PATHS]
    for section, known in DEFAULTS.items():
        for key, value in given.get(section, {}).items():
            if key not in known:
                found.append(f"[{section}] {key} is no key")
            elif _kind(value) is not _kind(known[key]):
                found.append(f"[{section}] {key} should be like {known[key]!r}")
            elif key in TIERS:
                found += [f"[{section}] {key} has no tier {t}" for t in value if t not in TIERS[key]]
    found += [f"[paths] {k}: {p} does not exist" for k, p in settings["paths"].items() if PATHS.get(k) == "read" and not p.exists()]
    return sorted(found)


def variant_suffix(variant: str = "") -> str:
    """FN34, FN40: "_x" for "x", " _x" or "x "; nothing for nothing."""
    name = variant.strip().strip("_")
    return f"_{name}" if name else ""


def variant_path(root: str, table: str, variant: str = "") -> str:
    """FN34: every output of a variant has its own name."""
    return f"{root.rstrip('/')}/{table}{variant_suffix(variant)}"
