"""Python twins of a few text functions, for replies on the driver and inside providers."""

from __future__ import annotations

import json
import math
from typing import Any


def strip_fences(text: str) -> str:
    body = text.strip()
    if not body.startswith("```"):
        return body
    return "\n".join(x for x in body.split("\n") if not x.strip().startswith("```"))


def parse_object(text: str) -> dict[str, Any]:
    found = json.loads(strip_fences(text))
    if not isinstance(found, dict):
        raise ValueError("not a JSON object")
    return found


def parse_objects(text: str) -> list[dict[str, Any]]:
    found = json.loads(strip_fences(text))
    found = [found] if isinstance(found, dict) else found
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise ValueError("not a JSON array of objects")
    return found


def tokens(text: str | None) -> int:
    return math.ceil(len(text or "") / 4)
