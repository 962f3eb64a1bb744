"""Errors by whose fault they are, and what of them is shown to whoever asked for the work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class QuireError(Exception):
    """Any error of this package."""


class InputError(QuireError):
    """A file that can't be taken, or is beyond a limit."""


class DependencyError(QuireError):
    """Something that isn't installed."""


class ModelError(QuireError):
    """A model that can't be loaded, or fails."""


class PageError(QuireError):
    """A page that can't be worked on."""


class QualityError(QuireError):
    """A result that doesn't pass its checks; its text is written for the reader."""


MASKED = "processing failed"


def shown(error: BaseException) -> str:
    """The text of an error for the user: only what was written for them; anything else could give away paths or texts."""
    return str(error) if isinstance(error, QualityError) else MASKED


def shown_error(kind: Column, text: Column) -> Column:
    """The same for tables of errors, by the name of the class."""
    return F.when(kind == QualityError.__name__, text).when(kind.isNotNull(), MASKED)
