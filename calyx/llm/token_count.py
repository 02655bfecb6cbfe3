"""Token counts with overlap resynchronisation (operator 8).

Texts of at most ``chunk`` characters are encoded whole. A longer text is
encoded in overlapping chunks with character offsets. Two neighbouring chunks
are spliced at a common boundary inside their overlap: a character position
after white space at which a token starts in both encodings. White space ends
every pre-token of this vocabulary and no normalisation step reaches across it,
so the tokens before and after such a position are those of the whole text.
Without a common boundary the overlap is doubled, up to the rest of the text.
A normalisation step that changes no token is left out of the tokenizer.

Null and empty texts have 0 tokens. Nothing is truncated. Repeated rows are
counted each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk and of the first overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Positions after these are boundaries that no token or normalisation crosses.
STABLE = frozenset(" \t\n\r\x0b\x0c")

#: Fixed values (of the tokenizer files): the step that makes white space one space, steps that may stand beside it, and a
#: pattern of pre-tokens that holds no white space.
ONE_SPACE = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
BESIDE = frozenset(("NFC", "NFD", "Lowercase"))
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LOADED: dict = {}


def without_idle_steps(spec: dict) -> dict:
    """A tokenizer file without the step that makes runs of white space one space, where it changes no token.

    That is so where pre-tokens are the matches of ``WORDS``: all white space lies between them, is dropped whatever it is, and
    separates them as one space would. No other step reaches across it, and no added token is looked for in normalised text.
    """
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = norm.get("normalizers") or []
    first = (pre.get("pretokenizers") or [pre])[0]
    words = first.get("type") == "Split" and first["pattern"] == {"Regex": WORDS} and first["behavior"] == "Removed" and first["invert"]
    rest = [s for s in steps if s != ONE_SPACE]
    if not words or any(s["type"] not in BESIDE for s in rest) or any(t["normalized"] for t in spec.get("added_tokens") or []):
        return spec
    return {**spec, "normalizer": {**norm, "normalizers": rest}} if steps else spec


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per Python process."""
    if path not in _LOADED:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            t = Tokenizer.from_str(json.dumps(without_idle_steps(json.load(f))))
        t.no_padding()
        t.no_truncation()
        _LOADED[path] = t
    return _LOADED[path]


def starts(tok, text: str, at: int) -> list[int]:
    """Where the tokens of ``text`` start, in characters, moved by ``at``."""
    return [at + s for s, _ in tok.encode(text, add_special_tokens=False).offsets]


def common_boundary(text: str, left: list[int], right: list[int], low: int, high: int) -> int | None:
    """The stable position nearest the middle of (low, high) at which a token
    starts in both encodings, or None."""
    both = {p for p in left if low < p < high and text[p - 1] in STABLE}
    both.intersection_update(right)
    return min(both, key=lambda p: (abs(2 * p - low - high), p)) if both else None


def count_spliced(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, encoded chunk by chunk."""
    total, own, end = 0, 0, min(chunk, len(text))
    left = starts(tok, text[:end], 0)
    while end < len(text):
        wide, cut = overlap, None
        while cut is None:
            low = max(own, end - wide)
            stop = min(len(text), max(end, low) + chunk)
            right = starts(tok, text[low:stop], low)
            cut = common_boundary(text, left, right, low, end)
            if cut is None and low == own:
                # no boundary in the whole chunk: encode it together with the next
                end = min(len(text), end + max(chunk, end - own))
                left = starts(tok, text[own:end], own)
                if end == len(text):
                    break
                wide = overlap
                continue
            wide *= 2
        if cut is None:
            break
        total += sum(own <= p < cut for p in left)
        left, own, end = right, cut, stop
    return total + sum(p >= own for p in left)


def n_tokens(text: Column, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """The number of tokens of a text column."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer(path)
        for texts in parts:
            out = [0] * len(texts)
            short = [(i, t) for i, t in enumerate(texts) if t and len(t) <= chunk]
            for at in range(0, len(short), 256):
                some = short[at:at + 256]
                for (i, _), e in zip(some, tok.encode_batch_fast([t for _, t in some], add_special_tokens=False)):
                    out[i] = len(e)
            for i, t in enumerate(texts):
                if t and len(t) > chunk:
                    out[i] = count_spliced(tok, t, chunk, overlap)
            yield pd.Series(out, dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, whatever other columns it has."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"),
                      n_tokens(text, path, chunk, overlap).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
