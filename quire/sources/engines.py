"""Recognition engines as plug-ins over pages, and one that needs no model: bands of ink.

An engine gets the pages of a task one by one and yields rows of recognised lines. It is made once a task, so a model
is loaded once; a page that fails is tried again, and an engine may be reset before the next try. Reading text
from pixels needs models that are no part of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Event, Thread
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession

LINES = "doc_id long, page_index int, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, attempts int, error string"


class Engine(Protocol):
    def analyze(self, page: dict) -> list[tuple[str, float, tuple[float, float, float, float]]]:
        """(text, confidence, box in points) of the lines of a page (doc_id, page_index, image, width_pt, height_pt, dpi)."""

    def reset(self) -> None:
        """Free what a failed page may have left."""


def is_memory_failure(error: BaseException | None) -> bool:
    """Whether the error, or one that caused it, is about memory."""
    from ..functions.text import MEMORY_PHRASES

    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        if isinstance(error, MemoryError) or any(p in str(error).lower() for p in MEMORY_PHRASES):
            return True
        error = error.__cause__ or error.__context__
    return False


def analyze_page(engine: Engine, page: dict, attempts: int = 3, shrink: float = 0.7) -> tuple[list, int, str | None]:
    """(lines, attempts, error). After a failure of memory the engine is reset; the last attempt takes a lower resolution."""
    for n in range(1, attempts + 1):
        try:
            return engine.analyze(page if n < attempts or n == 1 else {**page, "dpi": page["dpi"] * shrink}), n, None
        except Exception as e:  # noqa: BLE001  a page that fails is a row with its error
            if n == attempts or not is_memory_failure(e):
                return [], n, f"{type(e).__name__}: {e}"[:500]
            engine.reset()
    return [], attempts, None


@contextmanager
def progress(spark: SparkSession, total: int, report: Callable[[int, int], None], seconds: float = 1.0) -> Iterator[Accumulator]:
    """A counter for ``recognize``; while it is open, report(done, total) is called from time to time, and once at the end.

    Tasks that are run again count again, so what is reported is held at total.
    """
    done, over = spark.sparkContext.accumulator(0), Event()

    def watch() -> None:
        last = -1
        while not over.wait(seconds):
            if (now := min(done.value, total)) != last:
                last = now
                report(now, total)

    thread = Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield done
    finally:
        over.set()
        thread.join()
        report(min(done.value, total), total)


def recognize(pages: DataFrame, make: Callable[[], Engine], attempts: int = 3, counter: Accumulator | None = None) -> DataFrame:
    """Rows of LINES for pages (doc_id, page_index, image, width_pt, height_pt, dpi); a failed page is one row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for part in parts:
            rows = []
            for page in part.to_dict("records"):
                lines, n, error = analyze_page(engine, page, attempts)
                at = (page["doc_id"], page["page_index"])
                rows += [(*at, i, text, conf, *box, n, None) for i, (text, conf, box) in enumerate(lines)]
                if error:
                    rows.append((*at, -1, None, None, None, None, None, None, n, error))
                if counter is not None:
                    counter.add(1)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")])

    return pages.mapInPandas(run, LINES)


def bands(mask: np.ndarray, least: int = 1, gap: int = 1) -> list[tuple[int, int]]:
    """Runs of rows with at least ``least`` dark pixels; runs up to ``gap`` rows apart are one."""
    rows = np.flatnonzero(mask.sum(1) >= least)
    if not len(rows):
        return []
    cuts = np.flatnonzero(np.diff(rows) > gap) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(rows, cuts)]


def tight(mask: np.ndarray, margin: int = 2) -> tuple[int, int, int, int] | None:
    """Left, top, right and bottom of the ink with a margin; None without ink, or if nothing would be cut."""
    ys, xs = np.where(mask)
    if not len(xs):
        return None
    h, w = mask.shape
    left, top, right, bottom = max(0, xs.min() - margin), max(0, ys.min() - margin), min(w, xs.max() + margin + 1), min(h, ys.max() + margin + 1)
    return None if bottom - top >= h - 2 and right - left >= w - 2 else (int(left), int(top), int(right), int(bottom))


def has_ink(gray: np.ndarray, dark: int = 150, least: int = 20, share: float = 0.02) -> bool:
    """Whether the inside of a crop, without its rim, has visible ink."""
    h, w = gray.shape
    rim = min(2, w // 6, h // 6)
    inner = gray[rim : h - rim, rim : w - rim]
    return int((inner < dark).sum()) > max(least, inner.size * share)


def read_pgm(data: bytes) -> np.ndarray:
    """A binary grayscale PGM image."""
    parts, at = [], 0
    while len(parts) < 4:
        end = at
        while end < len(data) and data[end : end + 1] not in (b" ", b"\n", b"\t", b"\r"):
            end += 1
        if end == len(data):
            raise ValueError("the header of the image is cut off")
        if end > at:
            parts.append(data[at:end])
        at = end + 1
    if parts[0] != b"P5":
        raise ValueError("not a binary PGM image")
    return np.frombuffer(data, np.uint8, int(parts[1]) * int(parts[2]), at).reshape(int(parts[2]), int(parts[1]))


class InkEngine:
    """Finds lines of ink and reads nothing: texts are empty, confidence is the share of ink."""

    def analyze(self, page: dict) -> list:
        gray = read_pgm(bytes(page["image"]))
        mask = gray < 170
        mask[:, mask.sum(0) > gray.shape[0] * 0.9] = False
        scale = page["width_pt"] / gray.shape[1]
        out = []
        for top, bottom in bands(mask, gap=2):
            xs = np.flatnonzero(mask[top:bottom].any(0))
            box = (xs[0] * scale, top * scale, (xs[-1] + 1) * scale, bottom * scale)
            out.append(("", float(mask[top:bottom, xs[0] : xs[-1] + 1].mean()), tuple(map(float, box))))
        return out

    def reset(self) -> None:
        pass
