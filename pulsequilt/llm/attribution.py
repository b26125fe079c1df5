"""Token counts by section: offsets of tokens joined to offsets of sections.

Each document is encoded once, whole. Its tokens tile its bytes; its sections
(by default lines, each with its line end) tile its characters. The interval
join runs inside each document on sorted bounds. A token that crosses a
boundary goes whole to the section that holds most of its bytes, at a tie to
the earlier one (``rule="most"``), or to that of its first byte
(``rule="first"``); so the counts of a document's sections add up to its
tokens.

A null text is empty; an empty text has one empty section with no tokens.
Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import by_batch, texts


@lru_cache
def byte_encoding(path: str, pattern: str):
    """tiktoken's encoding of a rank file, and the byte length of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        lengths[i] = len(piece)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def line_ends(data: bytes) -> np.ndarray:
    """Byte ends of the lines, each with its line feed; one empty line for an empty text."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if ends.size and ends[-1] == len(data) else np.append(ends, len(data))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int]:
    """The section of each token, and how many tokens cross a boundary. Both arrays hold ascending ends of intervals that tile the same range."""
    starts = np.concatenate([[0], token_ends[:-1]]) if token_ends.size else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    crossing = np.flatnonzero(last > first)
    if rule == "most":
        for i in crossing:
            lo, hi = first[i], last[i]
            edges = np.clip(np.concatenate([[starts[i]], section_ends[lo : hi + 1]]), starts[i], token_ends[i])
            first[i] = lo + int(np.argmax(np.diff(edges)))
    elif rule != "first":
        raise ValueError(rule)
    return first, crossing.size


def section_tokens(docs: DataFrame, *, rule: str = "most", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """A row for each section: doc_id, section, start, end (code points), n_tokens, n_crossing (tokens that only partly lie in it and were given to it)."""
    path, pattern = tokenizer or default_tokenizer()

    def make():
        encoding, lengths = byte_encoding(path, pattern)

        def run(x):
            out = {k: [] for k in ("doc_id", "section", "start", "end", "n_tokens", "n_crossing")}
            for doc_id, text in zip(x["doc_id"], x["text"], strict=True):
                data = text.encode()
                ends = line_ends(data)
                token_ends = np.cumsum(lengths[encoding.encode_to_numpy(text, disallowed_special=())])
                owner, crossing = attribute(token_ends, ends, rule)
                counts = np.bincount(owner, minlength=ends.size)
                crossed = np.zeros(ends.size, np.int64)
                if crossing:
                    starts = np.concatenate([[0], token_ends[:-1]])
                    s = np.concatenate([[0], ends[:-1]])
                    crossed = np.bincount(owner[(starts < s[owner]) | (token_ends > ends[owner])], minlength=ends.size)
                if len(data) > len(text):  # code points up to each byte
                    ends = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[ends]
                n = ends.size
                out["doc_id"] += [doc_id] * n
                out["section"] += range(n)
                out["start"] += [0, *ends[:-1].tolist()]
                out["end"] += ends.tolist()
                out["n_tokens"] += counts.tolist()
                out["n_crossing"] += crossed.tolist()
            return out

        return run

    return by_batch(texts(docs), make, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")
