"""The rules for file names on the reader's side, where there are no columns yet."""

from __future__ import annotations

from pathlib import PurePosixPath

from tessera.schemas import EXTENSIONS, IGNORED


def supported(name: str) -> bool:
    return PurePosixPath(name).suffix.lower() in EXTENSIONS


def skipped(name: str) -> bool:
    return name in IGNORED


def universal(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")
