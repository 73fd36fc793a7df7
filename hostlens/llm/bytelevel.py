"""The byte alphabet of byte-level vocabularies."""

from __future__ import annotations


def byte_of_char() -> dict[str, int]:
    """Byte-level files write visible Latin-1 characters as themselves and the other bytes, in order, from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
