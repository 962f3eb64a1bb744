"""Whether what this package needs is there: Python, packages, Java, settings, folders."""

from __future__ import annotations

import importlib.util
import os
import platform
import shutil
import sys
import tempfile
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path
from typing import Any

#: Module -> distribution, and whether nothing works without it.
PACKAGES = {"pyspark": ("pyspark", True), "pyarrow": ("pyarrow", True), "numpy": ("numpy", True), "pandas": ("pandas", True), "xxhash": ("xxhash", False), "tiktoken": ("tiktoken", False), "sentencepiece": ("sentencepiece", False), "yaml": ("PyYAML", False)}


def _version(name: str) -> str | None:
    try:
        return version(name)
    except PackageNotFoundError:
        return None


def examine(settings: dict[str, Any], folder: str | None = None) -> dict[str, Any]:
    """A report: ok, and checks that each pass, warn or fail."""
    checks: list[dict[str, str]] = []

    def add(name: str, good: bool, detail: str, otherwise: str = "FAIL") -> None:
        checks.append({"check": name, "status": "PASS" if good else otherwise, "detail": detail})

    add("python", sys.version_info >= (3, 10), platform.python_version())
    for module, (name, needed) in PACKAGES.items():
        found = importlib.util.find_spec(module) is not None
        add(f"package {name}", found, _version(name) or ("there" if found else "not installed"), "FAIL" if needed else "WARN")
    java = shutil.which("java") or (os.environ.get("JAVA_HOME") and str(Path(os.environ["JAVA_HOME"], "bin", "java")))
    add("java", bool(java), java or "not found")
    folder = folder or tempfile.gettempdir()
    try:
        Path(folder).mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile(dir=folder):
            add("folder", True, folder)
    except OSError as e:
        add("folder", False, f"{folder}: {e.strerror}")
    add("offline", bool(settings.get("offline")), f"offline={settings.get('offline')}", "WARN")
    limits = settings.get("limits", {})
    bad = sorted(k for k, v in limits.items() if not isinstance(v, (int, float)) or v <= 0)
    add("limits", not bad, "all above zero" if not bad else "not above zero: " + ", ".join(bad))
    return {"ok": all(c["status"] != "FAIL" for c in checks), "python": platform.python_version(), "offline": settings.get("offline"), "workers": settings.get("api", {}).get("workers"), "checks": checks}
