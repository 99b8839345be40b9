"""Token counts of sections, from one encoding of each whole document.

Encoding sections on their own gives other tokens than the document has, since
a token may cross their boundary. Here the document is encoded once; token
lengths in bytes give token spans, and a merge of the sorted token spans with
the sorted section spans attributes each token. A token that crosses a boundary
goes, by the rule given, to the section of its first character, of its last,
or to the one that holds most of its characters (the first of equals).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import bytes_
from driftwood.sources.workspace import shipped

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before byte pairs are merged; a fixed value of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most")
#: Runs of white space (what the pattern takes for it) that are too long for the pattern's backtracking.
LONG_GAP = re.compile(r"[^\S\x1c-\x1f]{10000,}")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        size[i] = len(piece)
    own, whole = (tiktoken.Encoding("own", pat_str=x, mergeable_ranks=ranks, special_tokens={}) for x in (PATTERN, "(?s).+"))
    return own, whole, size


def token_ids(encoders: tuple, text: str) -> np.ndarray:
    """The ids of a text. Of a run of white space before a word the pattern takes all but the last character as one part, and so are long runs cut."""
    own, whole, _ = encoders
    parts, at = [], 0
    for gap in LONG_GAP.finditer(text):
        end = gap.end() - (gap.end() < len(text))
        parts += [own.encode_to_numpy(text[at : gap.start()], disallowed_special=()), whole.encode_to_numpy(text[gap.start() : end], disallowed_special=())]
        at = end
    return np.concatenate([*parts, own.encode_to_numpy(text[at:], disallowed_special=())])


def attribute(token_ends: np.ndarray, section_starts: np.ndarray, points: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token. Token spans tile the bytes and end at token_ends; points: characters that start before each byte."""
    starts = np.concatenate([[0], token_ends[:-1]])
    char_at = lambda x: np.searchsorted(points, points[x + 1], "left") - 1  # noqa: E731  the byte at which the character of byte x starts
    a = np.searchsorted(section_starts, char_at(starts), "right") - 1
    if rule == "first":
        return a
    b = np.searchsorted(section_starts, token_ends - 1, "right") - 1
    if rule == "last":
        return b
    for i in np.flatnonzero(a != b).tolist():
        cuts = np.concatenate([[points[char_at(starts[i])]], points[section_starts[a[i] + 1 : b[i] + 1]], [points[token_ends[i]]]])
        a[i] += int(np.argmax(np.diff(cuts)))
    return a


def _counted(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoder(path)
        size = encoders[2]
        for batch, data, off in bytes_.slices(batches):
            sections = bytes_.lines(data, off)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            counts = np.zeros(len(sections.starts), np.int64)
            for d, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    ends = np.cumsum(size[token_ids(encoders, text)])
                    a, b = sections.first[d], sections.first[d + 1]
                    own = points[off[d] : off[d + 1] + 1] - points[off[d]]
                    counts[a:b] = np.bincount(attribute(ends, sections.starts[a:b] - off[d], own, rule), minlength=b - a)
            doc = bytes_.owners(sections.first)
            base = points[off[:-1]][doc]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(np.arange(len(doc)) - sections.first[:-1][doc]), pa.array(points[sections.starts] - base), pa.array(points[sections.ends] - base), pa.array(counts)],
                ["doc_id", "section", "start", "end", "n_tokens"],
            )

    return run


def section_tokens(docs: DataFrame, ranks: str = RANKS, rule: str = "first") -> DataFrame:
    """Tokens of every line of every whole text.

    docs: ``doc_id`` bigint, ``text``; other columns are ignored. Returns one
    row per line (split at \\n; null and empty texts have one empty line):
    doc_id, section (from 0), start and end (code points of the text, without
    the \\n, which counts to the line that it ends), n_tokens. The counts of a
    document add up to the tokens of its whole text. Repeated rows are each
    counted; an empty table gives no rows. A very long text is encoded as a
    whole, its tokens as an array of numbers. With rule "most" a token that two
    sections hold equally goes to the first. ``ranks`` is a vocabulary file that
    every executor can open.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    rows = shipped(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_counted(ranks, rule), "doc_id long, section long, start long, end long, n_tokens long")
