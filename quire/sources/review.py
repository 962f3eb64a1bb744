"""Review clients. One answers from a table of prepared findings; transports over a network are left to others."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any, Protocol

from ..errors import InputError, ModelError
from ..operators.service import ANSWER_BYTES, IMAGE_CHARS, IMAGES


class Client(Protocol):
    def request(self, instruction: str, payload: dict, images: list[str]) -> dict[str, Any]:
        """The answer to a payload, as an object."""


class Prepared:
    """Answers by the payload's unit_id or page; what wasn't prepared has no findings."""

    def __init__(self, answers: dict[str, dict]):
        self.answers = answers

    def request(self, instruction: str, payload: dict, images: list[str]) -> dict[str, Any]:
        return self.answers.get(str(payload.get("unit_id", payload.get("page"))), {"issues": []})


class Bounded:
    """Any client within the limits of a review: pictures, answers, calls and time. Errors never carry what was sent or answered."""

    def __init__(self, client: Client, calls: int = 40, seconds: float = 180.0, clock: Callable[[], float] = time.monotonic):
        self.client, self.left, self.clock = client, calls, clock
        self.deadline = clock() + seconds

    def request(self, instruction: str, payload: dict, images: list[str] = ()) -> dict[str, Any]:
        if len(images) > IMAGES or not all(x.startswith(("data:image/jpeg;base64,", "data:image/png;base64,")) for x in images) or sum(map(len, images)) > IMAGE_CHARS:
            raise InputError("the pictures of a review are too many, too large or not embedded")
        if self.left <= 0 or self.clock() >= self.deadline:
            raise TimeoutError("the budget of the review is spent")
        self.left -= 1
        try:
            answer = self.client.request(instruction, payload, list(images))
            size = len(json.dumps(answer, ensure_ascii=False).encode("utf-8", "replace"))
        except Exception as e:  # noqa: BLE001  whatever failed, its text may hold the document's
            raise ModelError(f"the review failed: {type(e).__name__}") from None
        if size > ANSWER_BYTES:
            raise ModelError("the answer of the review is too large")
        return answer
