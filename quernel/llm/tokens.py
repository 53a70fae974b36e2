"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches; the tokenizer's file is a parameter."""

from __future__ import annotations

import base64

#: Splitting pattern of byte-level BPE files, as their users publish it: fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def encoding(path: str = TOKENIZER):  # noqa: ANN201
    """The encoding of a file of ranks; loaded once per worker.

    It is kept with its library, since this function itself travels with each task and would begin anew.
    """
    import tiktoken

    kept = vars(tiktoken).setdefault("_kept_encodings", {})
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        kept[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def _encode(text: str, path: str) -> list[int]:
    try:
        return encoding(path).encode_ordinary(text)
    except UnicodeEncodeError:  # lone surrogates
        return encoding(path).encode_ordinary(text.encode("utf-8", "replace").decode())


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """How many tokens a text has; 0 for a null or empty one."""
    return len(_encode(text, path)) if text else 0


def cut_tokens(text: str | None, most: int, path: str = TOKENIZER) -> list[tuple[int, int, int]]:
    """(start_char, end_char, tokens) of the pieces of a text, none over most tokens: the whole text if it fits.

    A longer text is cut after as many tokens as fit, at a character's end. Each piece is counted as a text of its own, since
    tokens at a cut can come out otherwise; where that makes it too long, it is cut a little earlier.
    """
    if not text:
        return []
    ids = _encode(text, path)
    if len(ids) <= most:
        return [(0, len(text), len(ids))]
    enc, out, at, k = encoding(path), [], 0, 0
    while at < len(text):
        take = most
        while True:
            part = enc.decode_bytes(ids[k : k + take]).decode("utf-8", "ignore")
            n = len(_encode(part, path)) if part else most + 1
            if part and n <= most or take <= 1:
                break
            take -= max(1, n - most) if part else 1
        if not part:  # one character of several tokens, more than fit
            part = text[at]
            n = len(_encode(part, path))
        out.append((at, at + len(part), n))
        at += len(part)
        used = len(enc.decode_bytes(ids[k : k + take]).decode("utf-8", "ignore").encode())
        done = 0
        while done < used and k < len(ids):
            done += len(enc.decode_single_token_bytes(ids[k]))
            k += 1
        if done != used:  # the cut lies within a token: count the rest anew
            ids, k = _encode(text[at:], path), 0
    return out
