"""Places of the public tokenizers' vocabulary files."""

from __future__ import annotations


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
