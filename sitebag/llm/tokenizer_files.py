"""Where the public vocabulary files are; a caller may pass any other path to the operators."""

from __future__ import annotations


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
