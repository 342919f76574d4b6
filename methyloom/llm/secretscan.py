"""Secret scan: three fixed forms, and novelty against zstandard dictionaries.

**Forms.** Assignments of a value to a secret's usual names, access keys and long hex strings, each
matched leftmost without overlaps and dropped if too short.

**Novelty.** A candidate is a string of 12 or more code characters, with a digit and a letter, in a
sensitive context: one of ``CONTEXT_WORDS`` stands in the ``NEAR`` characters before it, or before it on
its line, however long. Its novelty is the marginal size of its compressed form: compressed bytes of the
surrounding text with the candidate less those without it, the compressor being primed with a
dictionary of usual identifiers. Words, paths and identifiers repeat what the dictionary or the
surroundings hold and add little; random strings can't be coded in less than the logarithm of the
number of characters they choose from. Candidates that add ``MIN_SHARE`` of that or more are reported
as kind ``novel``, unless a form's span covers them whole.

Null texts count as empty, without spans. Spans are code points, ends exclusive. Equal texts have equal
spans; rows that repeat a doc_id each have their own.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .common import chunks, over_texts

# fixed values: the forms of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

NEAR = 48
MIN_SHARE = 1.0
LEVEL = 19
CONTEXT_WORDS = ("key", "secret", "token", "passw", "auth", "credential", "private", "bearer", "signature", "session", "login", "pwd", "salt", "cert")
_context = re.compile("|".join(CONTEXT_WORDS), re.ASCII | re.IGNORECASE)
_candidate = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{12,}")

#: What surrounds secrets in code and settings: dictionary content, most usual last.
IDENTIFIERS = " ".join(
    f"{a}{join}{b}"
    for join in ("_", "-", "", ".")
    for a in ("client", "server", "user", "access", "account", "service", "database", "session", "request", "response", "config", "default", "public", "private", "secret", "api", "auth")
    for b in ("id", "key", "name", "token", "password", "secret", "value", "path", "host", "port", "url", "type", "version", "index", "count", "size")
)
PATHS = " ".join(f"/{a}/{b}/" for a in ("usr", "var", "etc", "opt", "home", "tmp", "srv", "mnt") for b in ("lib", "local", "bin", "share", "data", "log", "user", "config", "cache"))
CODE = "import from return class function const let var public static void string int null true false self this new http https www com org json xml html src lib usr bin etc home data test main index 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ password=\"\" token: '' api_key= Authorization: Bearer "

_compressor: list[zstandard.ZstdCompressor] = []


def compressed(text: str) -> int:
    """Bytes of a text after the dictionary, without frame headers that vary."""
    if not _compressor:
        primer = zstandard.ZstdCompressionDict((PATHS + IDENTIFIERS + CODE).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        _compressor.append(zstandard.ZstdCompressor(dict_data=primer, compression_params=params))
    # CODE before it, from the dictionary too, keeps short texts from being stored as they are
    return len(_compressor[0].compress((CODE + text).encode("utf-8", "surrogatepass")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed forms, in order."""
    spans, low = [], text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def novelty(text: str, start: int, end: int) -> float:
    """Compressed bytes that the candidate adds to its surroundings, per character."""
    before, after = text[max(0, start - 200) : start], text[end : end + 100]
    return (compressed(before + after + text[start:end]) - compressed(before + after)) / (end - start)


def entropy(text: str) -> float:
    """Bytes a character that a random string over the same kinds of characters takes."""
    if all(c in "0123456789abcdef" for c in text) or all(c in "0123456789ABCDEF" for c in text):
        return 0.5
    kinds = (26 * any(c.islower() for c in text), 26 * any(c.isupper() for c in text), 10 * any(c.isdigit() for c in text), 2 * any(c in "+/_=-" for c in text))
    return math.log2(sum(kinds)) / 8


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates in sensitive contexts that the fixed forms don't cover and that don't compress."""
    words = [m.span() for m in _context.finditer(text)]
    if not words:
        return []
    ends, spans = [end for _, end in words], []
    for m in _candidate.finditer(text):
        a, b = m.span()
        last = bisect.bisect_right(ends, a) - 1  # of the context words before the candidate
        if last < 0 or any(s <= a and b <= e for s, _, e in base):
            continue
        at = words[last][0]
        if (at >= a - NEAR or "\n" not in text[at:a]) and novelty(text, a, b) >= MIN_SHARE * entropy(text[a:b]):
            spans.append((a, 3, b))
    return spans


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "text"):
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"]):
                base = base_spans(text or "")
                more = novel_spans(text or "", base)
                kinds = [kind for _, kind, _ in base]
                rows.append((doc_id, *(kinds.count(k) for k in range(3)), len(more), hashlib.sha256(named(base).encode()).hexdigest(), named(base + more)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])
            yield out.astype({"doc_id": "Int64"})

    return over_texts(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
