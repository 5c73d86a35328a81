"""Small helpers of the tests."""

from __future__ import annotations

import re


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
