"""Sinks by name. A sink makes files of stored models (doc_id, json); its module is imported when it is asked for."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Name of an output -> (file, module, function, column of its content).
SINKS = {
    "pdf_flow": ("document-flow.pdf", "pdf", "flow_pdf", "pdf"),
    "pdf_positional": ("document-positional.pdf", "pdf", "positional_pdf", "pdf"),
    # The positional file's text is painted, so it is the searchable one too.
    "pdf_searchable": ("document-searchable.pdf", "pdf", "positional_pdf", "pdf"),
    "docx": ("document.docx", "docx", "docx", "docx"),
}


def sink(name: str) -> tuple[str, Callable, str]:
    """File name, function and content column of an output."""
    from ..errors import InputError

    if name not in SINKS:
        raise InputError(f"unknown output {name}; there are {', '.join(sorted(SINKS))}")
    file, module, function, column = SINKS[name]
    return file, getattr(import_module(f".{module}", __name__), function), column
