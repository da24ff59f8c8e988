"""Words of letters and digits, as the operators on items and features take them."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a word stay (0-9, a-z, all that isn't ASCII), A-Z become a-z, all others separate words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain_words(data: bytes) -> bytes:
    """data, byte by byte, with a space in place of whatever separates words."""
    return data.translate(_PLAIN)


def word_parts(data: bytes, part: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of data in lists of about part bytes each, so that a long text is never one list. No word is cut."""
    plain, at = plain_words(data), 0
    while at < len(plain):
        end = plain.find(b" ", at + part) if at + part < len(plain) else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end
