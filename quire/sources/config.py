"""Settings: defaults, a file over them, the environment over both, field by field."""

from __future__ import annotations

import copy
import os
from typing import Any

#: Defaults; fixed values.
DEFAULTS: dict[str, Any] = {
    "limits": {"max_file_mb": 200, "max_pages": 300, "max_pixels_per_page": 40_000_000, "max_dimension_px": 12_000},
    "text_layer": {"min_text_length": 20, "min_expected_script_ratio": 0.35, "max_control_ratio": 0.05, "max_replacement_ratio": 0.01, "max_mixed_script_word_ratio": 0.25},
    "figures": {"min_width_px": 32, "min_height_px": 32, "min_area_ratio": 0.001},
    "render": {"headers_footers": "keep", "docx_enabled": False, "unreadable_as_image": False, "unreadable_min_confidence": 0.7},
    "review": {"llm_enabled": False, "batch_chars": 10_000, "max_calls": 40, "call_timeout_seconds": 45, "stage_timeout_seconds": 180, "visual_max_pages": 20, "company_domains": []},
    "api": {"workers": 1, "queue_size": 16, "max_jobs": 1000, "job_ttl_seconds": 3600, "batch_files": 16, "batch_mb": 200, "sync_timeout_seconds": 600},
    "default_dpi": 300,
    "offline": True,
}


def _value(text: str, like: Any) -> Any:
    if isinstance(like, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, int) and not isinstance(like, bool):
        return int(text)
    if isinstance(like, float):
        return float(text)
    if isinstance(like, list):
        return [x.strip() for x in text.split(",") if x.strip()]
    return text


def merged(base: dict, over: dict, path: str = "") -> dict:
    """base with the fields of over; unknown fields are an error."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        if k not in base:
            raise ValueError(f"unknown setting {path}{k}")
        out[k] = merged(base[k], v, f"{path}{k}.") if isinstance(base[k], dict) else v
    return out


def load(path: str | None = None, environment: dict[str, str] | None = None, prefix: str = "QUIRE_") -> dict:
    """Settings. QUIRE_REVIEW__BATCH_CHARS=800 sets review.batch_chars, whatever the file says, and nothing else."""
    out = copy.deepcopy(DEFAULTS)
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            out = merged(out, yaml.safe_load(f) or {})
    for name, text in (os.environ if environment is None else environment).items():
        if not name.startswith(prefix):
            continue
        at, (*parents, leaf) = out, name[len(prefix) :].lower().split("__")
        for p in parents:
            at = at.get(p) if isinstance(at, dict) else None
        if isinstance(at, dict) and leaf in at and not isinstance(at[leaf], dict):
            at[leaf] = _value(text, at[leaf])
    return out
