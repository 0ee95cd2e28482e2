"""Secrets in text: fixed patterns, and random strings by their token efficiency.

A run of key characters, or a stretch of it between joints (= / + _ -), that takes many tokens of a tiktoken
vocabulary for its length (few characters a token) is a random string, unless it is a digest of a known
length (in hex, or in base64 after its function's name), a UUID, a hardware address, a piece of the alphabet, or
lies in a pattern's span.

Spans are half-open ranges of code points. Null text counts as empty; repeated rows and ids are scanned row
by row; other columns are ignored unless kept. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from groundloom.llm.batches import pieces

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these stands in every text that ASSIGN matches.
HEADS = ("password", "passwd", "secret", "token", "api")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
PART = re.compile(r"[A-Za-z0-9]+")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Identifiers within runs: UUIDs, hardware addresses, and digests in base64 after the name of their function.
KNOWN_PART = re.compile(
    rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|[0-9A-Fa-f]{{2}}(?:-[0-9A-Fa-f]{{2}}){{5}}|sha1-[A-Za-z0-9+/]{{27}}=|sha256-[A-Za-z0-9+/]{{43}}=|sha384-[A-Za-z0-9+/]{{64}}|sha512-[A-Za-z0-9+/]{{86}}==)(?![A-Za-z0-9+/=])"
)

_ENCODINGS: dict = {}


def _encoding(path: str, pattern: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches; kind as a place in KINDS."""
    found = []
    low = text.lower()
    if any(h in low for h in HEADS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_identifier(run: str) -> bool:
    """Digests of known length and UUIDs, whose randomness is no secret, and characters in the order of their codes."""
    if len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return True
    return len(run) > 8 and all(ord(y) - ord(x) == 1 for x, y in zip(run, run[1:]))


def _uncovered(a: int, b: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted spans leave of the range from a to b."""
    out = []
    for s, e in spans:
        if s < b and a < e:
            out.append((a, s))
            a = max(a, e)
    return [(x, y) for x, y in [*out, (a, b)] if y - x >= LEAST]


def _allowed(part: str, ratio: float) -> float:
    """Characters a token below which a part looks random; fewer distinct characters make longer tokens.

    Runs of digits and short parts keep the ratio. Long words of letters alone take few tokens, shorter ones
    more, so these get a smaller margin.
    """
    if len(part) < 8 or part.isdigit():
        return ratio
    if not part.isalpha():
        return ratio + 0.6
    return ratio + (0.5 if len(part) >= 20 else 0.2)


def _stretches(text: str, a: int, b: int, encoding, ratio: float) -> list[tuple[int, int]]:
    """The stretches of whole parts, joints between them, whose tokens outweigh their characters the most."""
    out, total, most, start, end = [], 0.0, 0.0, a, a
    for m in [*PART.finditer(text, a, b), None]:
        gain = None if m is None or is_identifier(m[0]) else _allowed(m[0], ratio) * len(encoding.encode_ordinary(m[0])) - len(m[0])
        if gain is None or total + gain <= 0:
            if most > 0 and end - start >= LEAST:
                out.append((start, end))
            total = most = 0.0
            continue
        if not total:
            start = m.start()
        total += gain
        if total > most:
            most, end = total, m.end()
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of sorted spans, without overlaps."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def random_spans(text: str, taken: list[tuple[int, int, int]], encoding, ratio: float) -> list[tuple[int, int, int]]:
    """Spans of random strings outside the sorted spans `taken`; runs and taken spans are swept together."""
    found, covered, at = [], _merged([(s, e) for s, _, e in taken]), 0
    for m in RUN.finditer(text):
        a, b = m.span()
        if is_identifier(m[0]):
            continue
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        skip, k = [u.span() for u in KNOWN_PART.finditer(text, a, b)], at
        while k < len(covered) and covered[k][0] < b:
            skip.append(covered[k])
            k += 1
        for x, y in _uncovered(a, b, sorted(skip)):
            found += [(s, 3, e) for s, e in _stretches(text, x, y, encoding, ratio)]
    return found


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, tokenizer_path: str, pattern: str, ratio: float = 1.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_assign, n_access, n_hex, n_random, base_sha256 (of the patterns' spans) and spans (kind:start:end of all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer_path, pattern)
        for batch in pieces(batches):
            counts, digests, shown = [[], [], [], []], [], []
            for text in batch.column(1).to_pylist():
                base = pattern_spans(text or "")
                spans = sorted(base + random_spans(text or "", base, encoding, ratio))
                for k, n in enumerate(counts):
                    n.append(sum(s[1] == k for s in spans))
                digests.append(hashlib.sha256(show(base).encode()).hexdigest())
                shown.append(show(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests), pa.array(shown)], names=names)

    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")
