"""Personal data by a semi-Markov conditional random field.

A text is cut into segments, each either a single token outside or an entity of some type of up to 16 tokens and 64 characters; e-mail
addresses may have up to 254 characters, the most that a valid one has, and any number of tokens.
An entity's score is linear in features of the whole span (its shape, check digits, octets, what stands next to it),
so boundaries and types are chosen together by dynamic programming over segments. The weights are
trained by maximum likelihood on generated, labelled sentences.

A segment can be an entity only if it has an ``@`` or four digits and no white space next to a lower-case letter; so text between
such places is outside whatever the weights, and the dynamic program runs on the places alone.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.session import small_batches

TYPES = ("email", "phone", "ip", "card", "ssn", "iban")
#: Most tokens of an entity; most characters of an entity; most characters of an e-mail address; generated sentences; passes over them.
MOST_TOKENS, MOST_CHARS, MOST_ADDRESS, SENTENCES, EPOCHS = 16, 64, 254, 1500, 5
#: Characters before a span in which its cue words stand.
CUE_CHARS = 30

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_CHUNK = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]")
_JOIN = re.compile(r"[0-9A-Z()+]")
_EMAIL = re.compile(r"[A-Za-z0-9](?:[\w.%+\-]*[\w%+\-])?@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,12}")
_DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,12}")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_IP6 = re.compile(r"(?i)(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
_CUES = {"phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "mail": "email", "email": "email", "card": "card", "visa": "card", "credit": "card", "ssn": "ssn", "social": "ssn", "ip": "ip", "host": "ip", "address": "ip", "iban": "iban", "account": "iban", "version": "version", "v": "version", "section": "version", "order": "number", "invoice": "number", "isbn": "number", "no": "number", "id": "number"}


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        v = int(ch) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _class(ch: str) -> str:
    return "9" if ch.isdigit() else "a" if ch.isalpha() else "_" if not ch or ch.isspace() else ch


def shape(s: str) -> str:
    return re.sub(r"((.)\2*)", lambda m: f"{m[2]}{min(len(m[1]), 5)}" if m[2] in "9aA" else m[1], "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "_" if c.isspace() else c for c in s))


def features(text: str, start: int, end: int) -> list[str]:
    """Features of the whole span ``[start, end)`` of a text."""
    s = text[start:end]
    digits = re.sub(r"\D", "", s)
    n = len(digits)
    plain = re.fullmatch(r"[\d \-]+", s) is not None
    out = ["1", f"n{n}", "L" + _class(text[start - 1 : start]), "R" + _class(text[end : end + 1]), "RR" + _class(text[end : end + 1]) + _class(text[end + 1 : end + 2]), "LL" + _class(text[start - 2 : start - 1]) + _class(text[start - 1 : start])]
    letters = sum(c.isalpha() for c in s)
    if n <= 24:  # letters: runs of any length look alike
        out.append("s" + (re.sub(r"\d", "", shape(s).replace("9", "d")) if letters else shape(s)))
    out += [f"{c}{min(s.count(c), 4)}" for c in "@.-+() /:,_" if c in s]
    out.append(f"a{min(letters, 3)}")
    if _EMAIL.fullmatch(s):
        out.append("email")
        out.append("email" + _class(text[start - 1 : start]) + _class(text[end : end + 1]))
        out.append("email" + ("in" if re.match(r"[\w.%+\-]", text[start - 1 : start]) or re.match(r"[\w\-]|\.\w", text[end : end + 2]) else "whole"))
    m = _IP.fullmatch(s)
    if m:
        out.append("octets" if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in m.groups()) else "not octets")
    if _IP6.fullmatch(s):
        out.append("ip6")
    if plain:
        out.append("plain")
        if 13 <= n <= 19:
            out.append("luhn" if luhn(digits) else "no luhn")
            out.append("groups" if re.fullmatch(r"\d{4}(?P<g>[ \-]?)\d{4}(?P=g)\d{4}(?P=g)\d{1,7}", s) else "no groups")
    compact = s.replace(" ", "")
    if _IBAN.fullmatch(compact):
        out.append("iban" if int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1 else "no iban")
    if re.fullmatch(r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}", s):
        out.append("dial")
    if re.fullmatch(r"(?:19|20)\d\d[\-/.]\d{1,2}[\-/.]\d{1,2}|\d{1,2}[\-/.]\d{1,2}[\-/.](?:19|20)\d\d", s):
        out.append("date")
    at = max(0, start - CUE_CHARS)
    if at and text[at - 1].isalpha():  # whole words only
        while at < start and text[at].isalpha():
            at += 1
    before = re.findall(r"[^\W\d_]+", text[at:start])[-2:]
    out += ["c" + _CUES[w.lower()] for w in before if w.lower() in _CUES]
    return out


def segments(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Tokens ``(start, end)`` and candidate segments ``(first token, last token + 1, start, end)`` of a stretch of text."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    n = len(tokens)
    digits = [sum(c.isdigit() for c in text[a:b]) for a, b in tokens]
    spots, at = places(text), 0
    joined = [True] * n  # may a segment go on from the token before?
    for k in range(1, n):
        left, right = tokens[k - 1][1], tokens[k][0]
        if left < right:
            while at < len(spots) and spots[at][1] < right:
                at += 1
            inside = at < len(spots) and spots[at][0] < left
            joined[k] = inside and right - left == 1 and text[left] in " \t" and bool(_JOIN.match(text[right])) and bool(_JOIN.match(text[left - 1]))
    out = []
    for i in range(n):
        a = tokens[i][0]
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        d, at = 0, False
        for j in range(i, min(n, i + MOST_TOKENS)):
            if j > i and not joined[j]:
                break
            b = tokens[j][1]
            if b - a > MOST_CHARS:
                break
            d += digits[j]
            at = at or text[tokens[j][0]] == "@"
            if (at or d >= 4) and b - a >= 6 and text[b - 1].isalnum():
                out.append((i, j + 1, a, b))
    return tokens, out + _long_addresses(text, tokens)


def _long_addresses(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Candidate segments for e-mail addresses beyond the bounds of other entities: of each ``@`` the longest address around it."""
    out, starts = [], None
    for m in re.finditer("@", text):
        a = m.start()
        while a and m.end() - a < MOST_ADDRESS and (text[a - 1].isalnum() or text[a - 1] in "_.%+-"):
            a -= 1
        while a < m.start() and not (text[a].isascii() and text[a].isalnum()):
            a += 1
        domain = _DOMAIN.match(text, m.end(), min(len(text), a + MOST_ADDRESS))
        if not domain or a == m.start():
            continue
        starts = [t[0] for t in tokens] if starts is None else starts
        i, j = bisect.bisect_left(starts, a), bisect.bisect_left(starts, domain.end())
        whole = i < len(tokens) and tokens[i][0] == a and tokens[j - 1][1] == domain.end()
        if whole and (j - i > MOST_TOKENS or domain.end() - a > MOST_CHARS) and _EMAIL.fullmatch(text, a, domain.end()):
            out.append((i, j, a, domain.end()))
    return out


def places(text: str) -> list[tuple[int, int]]:
    """Stretches outside which no segment is a candidate: runs of chunks with a digit or ``@``, one blank apart."""
    out: list[tuple[int, int]] = []
    for m in _CHUNK.finditer(text):
        if _TRIGGER.search(m.group()):
            if out and m.start() - out[-1][1] == 1 and text[out[-1][1]] in " \t":
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
    return out


def sentences(n: int, seed: int = 3) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated sentences with their entities; among them numbers that are no personal data."""
    rng = np.random.default_rng(seed)
    number = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwzäéñ"), int(rng.integers(2, 10))))
    pick = lambda *x: x[int(rng.integers(0, len(x)))]

    def card() -> str:
        base = pick("4", "5", "3", "6", number(1)) + number(int(pick(14, 14, 14, 13)))
        full = next(base + c for c in "0123456789" if luhn(base + c))
        return " ".join(re.findall(".{1,4}", full)) if pick(0, 0, 1) else full

    def bad_card() -> str:
        s = number(16)
        return s if not luhn(s) else s[:-1] + str((int(s[-1]) + 1) % 10)

    def iban() -> str:
        body = number(18)
        country = pick("DE", "FR", "ES", "NL")
        rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{98 - rest:02d}{body}"
        return " ".join(re.findall(".{1,4}", s)) if pick(0, 1) else s

    byte = lambda: str(int(rng.integers(0, pick(256, 256, 100))))
    ascii_word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), int(rng.integers(2, 9))))
    entity = {
        "email": lambda: pick("", ascii_word() + ".", ascii_word() + "_") + ascii_word() + pick("", number(2), "." + number(2)) + "@" + pick("", "mail" + number(1) + ".") + ascii_word() + pick("", ".example") + pick(".com", ".org", ".de", ".fr", ".co.uk", ".net"),
        "phone": lambda: pick(f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"+{pick('49', '33', '34', '44', '1')} {number(3)} {number(3)} {number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"+1-{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}"),
        "ip": lambda: pick(f"{byte()}.{byte()}.{byte()}.{byte()}", f"{byte()}.{byte()}.{byte()}.{byte()}", ":".join("".join(rng.choice(list("0123456789abcdef"), 4)) for _ in range(8))),
        "card": card,
        "ssn": lambda: f"{number(3)}-{number(2)}-{number(4)}",
        "iban": iban,
    }
    nothing = [
        lambda: pick("version ", "v", "") + f"{number(1)}.{number(1)}", lambda: f"{number(1)}.{number(1)}.{number(2)}", lambda: f"20{number(2)}-0{number(1)}-1{number(1)}", lambda: f"1{number(1)}/0{number(1)}/20{number(2)}",
        lambda: f"{number(2)}:{number(2)}:{number(2)}", lambda: f"{number(3)},{number(3)},{number(3)}", lambda: f"${number(4)}.{number(2)}", lambda: number(int(rng.integers(4, 13))), bad_card, lambda: number(int(rng.integers(17, 30))),
        lambda: "".join(rng.choice(list("0123456789abcdef"), int(pick(18, 32, 40)))), lambda: "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16)), lambda: f"{number(3)}.{number(3)}.3{number(2)}.{number(3)}", lambda: f"{number(4)}-{number(4)}", lambda: f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
        lambda: f"@{ascii_word()}", lambda: f"{number(2)}.{number(2)}.{number(2)}.{number(2)}.{number(2)}", lambda: f"a{number(2)}b{number(3)}c{number(1)}", lambda: f"{pick('order', 'invoice', 'id')} {number(10)}", lambda: f"{number(4)} {number(4)}",
    ]
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(int(rng.integers(1, 5))):
            text += " ".join(word() for _ in range(int(rng.integers(0, 4)))) + pick(" ", " ", ", ", "\n", " (", ' "')
            if pick(0, 0, 0, 1):
                text += pick("phone: ", "email: ", "card ", "ip ", "call ", "IBAN ")
            if pick(0, 1, 1):
                kind = pick(*TYPES)
                s = entity[kind]()
                gold.append((len(text), len(text) + len(s), kind))
            else:
                s = nothing[int(rng.integers(0, len(nothing)))]()
            text += s + pick("", "", ".", ",", "!!", ")", "%%%", ";") + pick(" ", " ", " ", "\n")
        out.append((text + pick("", " ", " " + word()), gold))
    return out


@lru_cache(maxsize=1)
def train(n: int = SENTENCES, epochs: int = EPOCHS, seed: int = 3) -> tuple[dict[str, int], np.ndarray]:
    """Feature numbers and weights ``features x types``, by stochastic gradient on the segment likelihood."""
    index: dict[str, int] = {}
    data = []
    for text, gold in sentences(n, seed):
        tokens, segs = segments(text)
        want = {(a, b): TYPES.index(k) for a, b, k in gold}
        feats = [np.array([index.setdefault(f, len(index)) for f in features(text, a, b)]) for _, _, a, b in segs]
        y = np.array([want.get((a, b), -1) for _, _, a, b in segs], int)
        data.append((len(tokens), np.array([s[:2] for s in segs], int).reshape(-1, 2), feats, y))
    w, square = np.zeros((len(index), len(TYPES))), np.full((len(index), len(TYPES)), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            length, span, feats, y = data[k]
            if not len(span):
                continue
            score = np.stack([w[f].sum(0) for f in feats])
            p = np.exp(_marginals(length, span, score))
            for f, row, gold in zip(feats, p, y):
                g = -row
                if gold >= 0:
                    g = g.copy()
                    g[gold] += 1
                g = g - 1e-4 * w[f]
                square[f] += g * g
                w[f] += 0.3 * g / np.sqrt(square[f])
    return index, w


def _marginals(length: int, span: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Log probability of each segment and type; a token outside scores 0."""
    whole = np.logaddexp.reduce(score, 1)
    ends: list[list[int]] = [[] for _ in range(length + 1)]
    starts: list[list[int]] = [[] for _ in range(length + 1)]
    for s, (i, j) in enumerate(span):
        ends[j].append(s)
        starts[i].append(s)
    fore, aft = np.zeros(length + 1), np.zeros(length + 1)
    for j in range(1, length + 1):
        fore[j] = np.logaddexp.reduce([fore[j - 1], *(fore[span[s, 0]] + whole[s] for s in ends[j])])
    for i in range(length - 1, -1, -1):
        aft[i] = np.logaddexp.reduce([aft[i + 1], *(aft[span[s, 1]] + whole[s] for s in starts[i])])
    return score + (fore[span[:, 0]] + aft[span[:, 1]] - fore[length])[:, None]


def best_segments(length: int, spans: list[tuple[int, int]], score: np.ndarray) -> list[tuple[int, int, float]]:
    """``(segment, type, score)`` of the cut with the highest total; of equal ones the one with fewer entities."""
    best, back = [0.0] * (length + 1), [None] * (length + 1)
    kind = score.argmax(1) if len(score) else []
    ends: dict[int, list[int]] = {}
    for s, (_, j) in enumerate(spans):
        ends.setdefault(j, []).append(s)
    for j in range(1, length + 1):
        best[j] = best[j - 1]
        for s in ends.get(j, ()):
            v = best[spans[s][0]] + score[s, kind[s]]
            if v > best[j] + 1e-12:
                best[j], back[j] = v, s
    out, j = [], length
    while j:
        s = back[j]
        if s is None:
            j -= 1
        else:
            out.append((s, int(kind[s]), float(score[s, kind[s]])))
            j = spans[s][0]
    return out[::-1]


def find_pii(text: str | None, model: tuple[dict[str, int], np.ndarray] | None = None, everywhere: bool = False) -> list[tuple[int, int, str, float]]:
    """``(start, end, type, score)`` of the entities of a text. ``everywhere``: run the dynamic program over the whole text, for tests."""
    index, w = model or train()
    out = []
    for lo, hi in [(0, len(text))] if everywhere and text else places(text or ""):
        tokens, segs = segments(text[lo:hi])
        if not segs:
            continue
        score = np.stack([w[[index[f] for f in features(text, lo + a, lo + b) if f in index]].sum(0) for _, _, a, b in segs])
        out += [(lo + segs[s][2], lo + segs[s][3], TYPES[k], v) for s, k, v in best_segments(len(tokens), [s[:2] for s in segs], score)]
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per entity: ``(doc_id, start, end, type, value, score)``; offsets in characters, end exclusive.

    Documents without a digit or ``@`` have no candidate and never reach Python. Null and empty texts have no entity; a null id stays
    null; repeated rows are reported once each; texts of any length are searched whole, for entities within the bounds that the module names; an empty table gives an empty result; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = train()

    def search(batches):
        for b in batches:
            rows = [(i, s, e, k, t[s:e], v) for i, t in zip(b["doc_id"], b["text"]) for s, e, k, v in find_pii(t, model)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "type", "value", "score"]).astype({"doc_id": "Int64"})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    return slim.mapInPandas(search, "doc_id long, start int, end int, type string, value string, score double")
