"""Secret scan by token efficiency.

A byte-pair vocabulary spells text it has seen in few tokens and random strings in many. A candidate is a
long run of key characters; known digests and identifiers, the host and plain path of a URL and e-mail addresses are excluded
(user-info, queries, fragments and what follows a key word are not); what is left and takes one token for every few characters is a secret.
A run of letters of one case may be a long word, which takes more tokens than a short one: without a key word before it, its longest piece
counts, against a lower limit.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.session import small_batches, unused

#: Folder of the vocabulary files; the vocabulary; the most characters a token of a random string, and of random letters of one case.
TOKENIZERS, VOCABULARY, MOST, MOST_WORD = "/opt/tokenizers", "byte_bpe_50k.tiktoken", 2.4, 1.8

_CHARS = r"A-Za-z0-9+/_\-"
#: A run of 16 key characters or more.
CANDIDATE = rf"(?<![{_CHARS}])[{_CHARS}]{{16,}}={{0,2}}"
_NAMES = r"(?:token|secret|passw(?:or)?d|pwd|credential|auth|bearer|(?:api|access|private)[_-]?key)"
_NAME_END = re.compile(rf"(?i){_NAMES}\Z")
_PATH_KEY = re.compile(rf"(?i){_NAMES}s?[=:/]+")
#: A URL with what follows its scheme; the rest of its user-info; a domain after ``@``; the rest of a domain.
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://([^\s\"'<>`]*)")
_INFO = re.compile(r"[^\s\"'<>`/?#@]*@")
_AT = re.compile(r"@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_DOMAIN = re.compile(r"(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
#: A well-known kind of key that may have no digit.
_FIXED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}")
_DIGEST = re.compile(r"(?i)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_PART = re.compile(r"[A-Z]?[a-z]{1,15}\d{0,4}|[A-Z]{1,8}\d{0,4}|\d{1,8}|")
_RUN = re.compile(CANDIDATE)


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _named(text: str, start: int, sign: bool = False) -> bool:
    """Whether a key word stands before a place, with quotes, white space and ``:`` or ``=`` between them (``sign``: there must be one)."""
    i, signed = start, False
    if text[i - 1 : i] in ("'", '"'):
        i -= 1
    while text[i - 1 : i].isspace():
        i -= 1
    if text[i - 1 : i] in (":", "="):
        i, signed = i - 1, True
        while text[i - 1 : i].isspace():
            i -= 1
    if text[i - 1 : i] in ("'", '"'):
        i -= 1
    return (signed or not sign) and bool(_NAME_END.search(text[max(0, i - 16) : i]))  # no key word is longer


def _urls(text: str) -> list[tuple[int, int]]:
    """Where what follows the scheme of each URL begins and ends."""
    return [m.span(1) for m in _URL.finditer(text)] if "://" in text else []


def _span(text: str, start: int, end: int, urls: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The part of a run that may be a secret by where it stands; None for the host or plain path of a URL and for e-mail addresses."""
    if text.startswith("//", start) and text[start - 1 : start] == ":":
        start += 2
    k = bisect.bisect_right(urls, (start, len(text) + 1)) - 1
    if k >= 0 and start <= urls[k][1]:
        first, before = urls[k][0], text[urls[k][0] : start]
        if "?" not in before and "#" not in before:
            if "/" not in before and "@" not in before and (":" in before or "/" not in text[start:end]) and _INFO.match(text, end):
                return start, end
            keys = [m.end() for m in _PATH_KEY.finditer(text, first, end)]
            if not keys or keys[-1] < start:
                return None
            stop = text.find("/", keys[-1], end)
            return keys[-1], end if stop < 0 else stop
    if _AT.match(text, end) and not _named(text, start, True):
        return None
    if text[start - 1 : start] == "@" and re.match(r"[\w.%+\-]", text[max(0, start - 2) : start]) and _DOMAIN.match(text, end):
        return None
    return start, end


def _excluded(text: str, start: int, end: int, known: frozenset[str]) -> bool:
    s = text[start:end]
    if s in known or s.isdigit() or _UUID.fullmatch(s):
        return True
    if _DIGEST.fullmatch(s):  # a digest, unless the text says that it is a key
        return not _named(text, start)
    words = re.split(r"[_\-/+]|(?<=[a-z])(?=[A-Z])", s.rstrip("="))
    return len(words) < len(s) / 3 and all(_PART.fullmatch(w) for w in words)


def _one_case(s: str) -> bool:
    """Whether all pieces are of letters only, each upper, lower or capitalised."""
    return all(w.isupper() or w[1:].islower() or len(w) < 2 for w in re.split(r"[_\-/+=]", s)) and not re.search(r"\d", s)


def find_secrets(text: str | None, path: str, most: float = MOST, known: frozenset[str] = frozenset()) -> list[tuple[int, int, float]]:
    """``(start, end, characters a token)`` of each secret of a text, in characters."""
    out, urls = [], None
    for m in _RUN.finditer(text or ""):
        urls = _urls(text) if urls is None else urls
        span = _span(text, m.start(), m.end(), urls)
        if not span or span[1] - span[0] < 16 or _excluded(text, *span, known):
            continue
        s, limit = text[span[0] : span[1]], most
        if _one_case(s) and not _FIXED.fullmatch(s) and not _named(text, span[0], True):
            s, limit = max(re.split(r"[_\-/+=]", s), key=len), min(most, MOST_WORD)
            if len(s) < 16:
                continue
        rate = len(s) / len(encoding(path).encode_ordinary(s))
        if rate < limit:
            out.append((*span, rate))
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, most: float = MOST, known: frozenset[str] = frozenset()) -> DataFrame:
    """One row per secret: ``(doc_id, start, end, secret, chars_per_token)``; offsets in characters, end exclusive.

    A candidate has at least 16 key characters; it may be of any length. Rows without one never reach Python. Null and empty texts have no secrets; a null id stays null; repeated rows are
    reported once each; texts are scanned whole; an empty table gives an empty result; further columns are ignored.
    ``known``: strings, such as published digests, that are never secrets.
    """
    small_batches(docs.sparkSession)
    path = os.path.join(tokenizers, vocabulary)

    def scan(batches):
        for b in batches:
            rows = [(i, s, e, t[s:e], r) for i, t in zip(b["doc_id"], b["text"]) for s, e, r in find_secrets(t, path, most, known)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "secret", "chars_per_token"]).astype({"doc_id": "Int64"})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(CANDIDATE))
    return slim.mapInPandas(scan, "doc_id long, start int, end int, secret string, chars_per_token double")


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, most: float = MOST, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with each secret replaced by ``mark`` and ``n_chars`` (if there is such a column) counted anew.

    All documents are kept. Edge cases are those of :func:`scan_secrets`; a null text stays null.
    """
    small_batches(docs.sparkSession)
    path = os.path.join(tokenizers, vocabulary)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            out, at = [], 0
            for s, e, _ in find_secrets(t, path, most):
                out += [t[at:s], mark]
                at = e
            return "".join(out) + t[at:] if out else None

        return texts.map(one, na_action="ignore")

    # One pass: only the texts with a candidate go to Python, and only changed ones come back.
    new = clean(F.when(F.col(text).rlike(CANDIDATE), F.col(text)))
    free = unused(docs.columns, "_new")
    changed = {text: F.col(free), n_chars: F.length(free)}
    return docs.withColumn(free, new).select(*[F.coalesce(changed[c].cast(docs.schema[c].dataType), F.col(c)).alias(c) if c in changed else F.col(c) for c in docs.columns])
