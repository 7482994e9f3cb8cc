"""Operator 3: personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, schemes (``://``), plus signs,
digits and identifier cues.  From each anchor a deterministic local parser expands left and right,
validates the boundary, and gives a span.  The parsers look only at characters around their anchor,
so the work is linear in the text.

Base kinds (code points, end exclusive): email, ip (four parts up to 255), card (16 to 19 digits
passing Luhn), phone (plus sign, 8 to 15 digits).  Spans that the method adds: ``userinfo``
(user part of a URL of any length between its scheme and an at-sign), ``iban`` (country, check digits that are
right modulo 97), ``account`` (8 to 17 digits after an account cue), ``secret`` (a quoted value of
16 or more characters after a token, key or password cue).

Scale: one map over the rows, no shuffle, no state that grows.

Defined results: a null text counts as empty and has no spans; repeated rows repeat; a column that
already has the output name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches
from .text import tidy

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "userinfo", "iban", "account", "secret")
#: Words before an account number or a secret; each is an anchor of its own.
ACCOUNT_CUES = ("account", "acct", "iban", "kontonummer", "cuenta", "compte")
SECRET_CUES = ("token", "api_key", "apikey", "secret", "password", "passwd")

_DIGIT = frozenset("0123456789")
_LABEL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")
_LOCAL = _LABEL | frozenset("._%+")
_PHONE = _DIGIT | frozenset(" ().-")
_ALNUM = _LABEL - {"-"}
_NOT_USER = re.compile(r"[/?#\s]")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for mark in ("@", "+", "://"):
        a.add_word(mark, mark)
    for d in sorted(_DIGIT):
        a.add_word(d, "0")
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in sorted({cue, cue.capitalize(), cue.upper()}):
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _run(t: str, i: int, allowed: frozenset) -> int:
    """The end of the run of allowed characters that starts at i."""
    n = len(t)
    while i < n and t[i] in allowed:
        i += 1
    return i


def _email(t: str, at: int, low: int) -> tuple[int, int] | None:
    start = at
    while start > low and t[start - 1] in _LOCAL:
        start -= 1
    end = _run(t, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(t) and t[end] == "." and (stop := _run(t, end + 1, _LABEL)) > end + 1:
        end, dots = stop, dots + 1
    return (start, end) if dots else None


def _ip(t: str, start: int) -> tuple[int, bool] | None:
    """End of four dotted digit runs from ``start``, and whether each is at most 255."""
    end, fits = start, True
    for part in range(4):
        if part:
            if end >= len(t) or t[end] != ".":
                return None
            end += 1
        stop = _run(t, end, _DIGIT)
        if stop == end:
            return None
        digits = t[end:stop].lstrip("0")
        fits &= len(digits) <= 3 and int(digits or "0") <= 255
        end = stop
    return end, fits


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _card(t: str, start: int) -> tuple[int, bool]:
    """End of the digits from ``start`` with single spaces or hyphens between, and whether they are a card number."""
    end, n = start + 1, len(t)
    while True:
        if end < n and t[end] in _DIGIT:
            end += 1
        elif end + 1 < n and t[end] in " -" and t[end + 1] in _DIGIT:
            end += 2
        else:
            break
    if not 16 <= end - start <= 37:
        return end, False
    digits = t[start:end].replace(" ", "").replace("-", "")
    return end, 16 <= len(digits) <= 19 and luhn(digits)


def _phone(t: str, plus: int) -> tuple[int, bool] | None:
    first = plus + 1
    if first >= len(t) or t[first] not in _DIGIT:
        return None
    end = _run(t, first + 1, _PHONE)
    while end > first + 1 and t[end - 1] not in _DIGIT:
        end -= 1
    if end - 1 < first + 2:
        return None
    return end, 8 <= sum(c in _DIGIT for c in t[plus:end]) <= 15


def _iban(t: str, start: int) -> tuple[int, int] | None:
    """An IBAN whose first check digit stands at ``start``."""
    at = start - 2
    if at < 0 or not (t[at].isascii() and t[at].isupper() and t[at + 1].isascii() and t[at + 1].isupper()):
        return None
    if at and t[at - 1] in _ALNUM:
        return None
    body, end = t[at : at + 2], start
    while end < len(t) and len(body) < 34:
        if t[end] in _ALNUM:
            body, end = body + t[end], end + 1
        elif t[end] == " " and end + 1 < len(t) and t[end + 1] in _ALNUM and (len(body) % 4 == 0):
            end += 1
        else:
            break
    if not 15 <= len(body) <= 34 or (end < len(t) and t[end] in _ALNUM):
        return None
    turned = body[4:] + body[:4]
    return (at, end) if body[2:4].isdigit() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else None


def _account(t: str, cue: int, cue_end: int) -> tuple[int, int] | None:
    """8 to 17 digits within a few characters after a cue that is a word of its own, standing alone."""
    if (cue and t[cue - 1].isalnum()) or (cue_end < len(t) and t[cue_end].isalnum()):
        return None
    i, most = cue_end, cue_end + 16
    while i < min(len(t), most) and t[i] not in _DIGIT:
        if t[i] == "\n":
            return None
        i += 1
    end = _run(t, i, _DIGIT)
    alone = (i == 0 or t[i - 1] not in _ALNUM) and (end >= len(t) or t[end] not in _ALNUM)
    return (i, end) if 8 <= end - i <= 17 and alone else None


def _secret(t: str, cue_end: int) -> tuple[int, int] | None:
    i = cue_end
    while i < len(t) and t[i] in " =:" and i < cue_end + 6:
        i += 1
    if i >= len(t) or t[i] not in "\"'" or i == cue_end:
        return None
    end = i + 1
    while end < len(t) and (t[end] in _LOCAL or t[end] in "/=~"):
        end += 1
    return (i + 1, end) if end - i - 1 >= 16 and end < len(t) and t[end] == t[i] else None


def find(t: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order of their start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # the end of the last match of a kind, kept or dropped
    seen_digit, scheme = -2, -1
    for at, kind in anchors.iter(t):
        if kind == "0":
            fresh = at != seen_digit + 1
            seen_digit = at
            if not fresh:
                continue
            if at >= done["card"]:
                end, good = _card(t, at)
                if end > at + 1:
                    done["card"] = end
                    if good:
                        out["card"].append((at, end))
            if at >= done["ip"] and (x := _ip(t, at)):
                done["ip"] = x[0]
                if x[1]:
                    out["ip"].append((at, x[0]))
            if at >= done["iban"] and (span := _iban(t, at)):
                out["iban"].append(span)
                done["iban"] = span[1]
        elif kind == "@":
            if span := _email(t, at, done["email"]):
                out["email"].append(span)
                done["email"] = span[1]
            if 0 <= scheme <= at and not _NOT_USER.search(t, scheme, at):
                if at > scheme:
                    out["userinfo"].append((scheme, at))
            scheme = -1  # each scheme is looked at once, so that many at-signs cost no more
        elif kind == "+":
            if at >= done["phone"] and (x := _phone(t, at)):
                done["phone"] = x[0]
                if x[1]:
                    out["phone"].append((at, x[0]))
        elif kind == "://":
            scheme = at + 1
        else:
            span = _secret(t, at + 1) if kind[0] == "secret" else _account(t, at + 1 - kind[1], at + 1)
            if span and span[0] >= done[kind[0]]:
                out[kind[0]].append(span)
                done[kind[0]] = span[1]
    return out


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_spans(df: DataFrame, text_col: str = "text", out_col: str = "pii_spans") -> DataFrame:
    """Add ``out_col``: spans of personal data by kind (the order of KINDS), then start."""

    @F.arrow_udf(_SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        anchors = automaton()
        for batch in tidy(batches):
            at, kinds, starts, ends = [0], [], [], []
            for text in batch:
                t = text.as_py()
                if t:
                    for kind, found in find(t, anchors).items():
                        for a, b in found:
                            kinds.append(kind)
                            starts.append(a)
                            ends.append(b)
                at.append(len(kinds))
            rows = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["kind", "start", "end"])
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows)

    return bounded_batches(df).withColumn(out_col, spans(F.col(text_col)))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """Replace each span of the text by ``<KIND>``; where spans overlap, their union becomes one mark of the first kind.

    Null texts stay null.  Built from Spark's array functions on the spans, which are few.
    """
    order = F.array_sort(F.transform(F.col(spans_col), lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    zero = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["a"] - acc["at"]), F.lit("<"), F.upper(s["k"]), F.lit(">"))
        return F.when(s["a"] < acc["at"], F.struct(acc["done"].alias("done"), F.greatest(acc["at"], s["b"]).alias("at"))).otherwise(F.struct(gap.alias("done"), s["b"].alias("at")))

    clean = F.aggregate(order, zero, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, clean).otherwise(text))


def digest(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined; only of ``kinds`` if given."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
