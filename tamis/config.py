"""Settings of a scan; all become literals of the plan."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field

MB = 1 << 20


@dataclass(frozen=True)
class Limits:
    max_mb: int = 10
    max_pages: int = 1000
    max_docx_parts: int = 1500
    max_total_uncompressed_mb: int = 100
    max_single_part_mb: int = 8
    max_expansion_ratio: float = 200.0
    pdf_bytes_scan_mb: int = 8
    fast_pdf_token_scan_mb: int = 2


@dataclass(frozen=True)
class Thresholds:
    flag: float = 0.35
    block: float = 0.70
    deep_scan_trigger: float = 0.20


# The presets of the profiles; any other name means balanced.
PROFILES = {
    "balanced": (Thresholds(), Limits()),
    "strict": (Thresholds(0.15, 0.50, 0.05), Limits(max_docx_parts=1000, max_mb=10)),
    "lenient": (Thresholds(0.35, 0.80, 0.40), Limits(max_docx_parts=3000, max_mb=25)),
}


@dataclass(frozen=True)
class Config:
    profile: str = "balanced"
    limits: Limits = field(default_factory=Limits)
    thresholds: Thresholds = field(default_factory=Thresholds)
    enable_pdf: bool = True
    enable_docx: bool = True
    enable_active_content: bool = True
    enable_prompt_injection: bool = True
    enable_ranking_abuse: bool = True
    enable_hidden_text: bool = False
    enable_obfuscation: bool = False
    enable_dos: bool = True
    enable_embedded: bool = True
    enable_metadata: bool = True
    enable_ats: bool = True
    enable_pii: bool = False
    enable_secrets: bool = False
    enable_rules: bool = False
    enable_semantic: bool = True
    enable_docx_dos: bool = False
    allow_watermarks: bool = True

    def with_profile(self, name: str) -> "Config":
        thresholds, limits = PROFILES.get(name, PROFILES["balanced"])
        return dataclasses.replace(self, profile=name, thresholds=thresholds, limits=limits)

    @staticmethod
    def of(values: dict) -> "Config":
        """From a nested mapping; a profile's preset wins over single values."""
        values = dict(values)
        profile = values.pop("profile", None)
        for key, kind in (("limits", Limits), ("thresholds", Thresholds)):
            if isinstance(values.get(key), dict):
                known = {f.name for f in dataclasses.fields(kind)}
                values[key] = kind(**{k: v for k, v in values[key].items() if k in known})
        known = {f.name for f in dataclasses.fields(Config)}
        made = Config(**{k: v for k, v in values.items() if k in known})
        return made.with_profile(profile) if profile else made

    @staticmethod
    def from_yaml(path: str) -> "Config":
        import yaml  # optional

        with open(path, encoding="utf-8") as f:
            return Config.of(yaml.safe_load(f) or {})

    @staticmethod
    def from_env(prefix: str = "TAMIS_", env: dict | None = None) -> "Config":
        values: dict = {}
        for key, raw in (os.environ if env is None else env).items():
            if key.startswith(prefix):
                *outer, last = key[len(prefix) :].lower().split("__")
                at = values
                for name in outer:
                    at = at.setdefault(name, {})
                low = raw.lower()
                at[last] = low == "true" if low in ("true", "false") else float(raw) if raw.replace(".", "", 1).isdigit() else raw
        return Config.of(values)
