"""Personal data with offset-preserving deobfuscation.

A text is read twice. The plain detectors run on the text itself. Where it holds a disguise, a transducer rewrites it (look-alike
characters to ASCII, zero-width characters away, spelled digits to digits, ``(at)``, ``[dot]``, `` dot `` and their kin to ``@`` and
``.``) and remembers for each written character which source characters it stands for; the same detectors run on the rewritten text
and their spans are mapped back. All scans are linear in the text, so very long texts and long runs are safe."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.shared import prepare, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Digit words, and letters of other scripts that look like Latin ones.
DIGITS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
LOOK_ALIKE = dict(zip("аеорсхуіјѕкмтвнАВЕКМНОРСТХУІЈЅοανρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijskmtbhABEKMHOPCTXYIJSoavptuikABEZHIKMNOPTYX", strict=True))
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_WORD = "|".join(DIGITS)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DOT_REFERENCE, _AT_REFERENCE = "&(?:period|#0*46|#x0*2e);", "&(?:commat|#0*64|#x0*40);"
_DOTTED = rf"(?:\s+dot\s+|\s-dot-\s|_dot_|\s?{_DOT_REFERENCE}\s?|\s?{_OPEN}\s?(?:dot|\.)\s?{_CLOSE}\s?)"
_LABELS = r"[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)*+"  # joined by plain dots
_RULES = re.compile(
    rf"(?P<at>\s?{_OPEN}\s?(?:at|@)\s?{_CLOSE}\s?|\s?{_AT_REFERENCE}\s?|(?<=[A-Za-z0-9])\s+@\s+(?={_LABELS}(?:(?<=\.[a-z]{{2}})|(?<=\.[a-z]{{3}})|{_DOTTED}[A-Za-z0-9]))"
    rf"|(?<=[A-Za-z0-9])(?:\s-at-\s|_at_)(?={_LABELS}{_DOTTED}[A-Za-z0-9])|(?<=[A-Za-z0-9])\s+at\s+(?!(?:the|an?|this|that)\b(?!\.))(?={_LABELS}{_DOTTED}[A-Za-z0-9]))"
    rf"|(?P<plain_at>(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]{{1,63}}+\.[A-Za-z0-9]))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){_DOTTED}(?=[A-Za-z0-9]))"
    rf"|(?P<plus>\bplus\s+(?=[0-9(]|(?:{_WORD})\b))"
    rf"|(?P<digit>\b(?:{_WORD})\b)(?:[ -](?=(?:{_WORD})\b))?", re.IGNORECASE)
# The screens of disguised(), over lower-cased text; each starts with what re finds fast. A "plus" before a digit word is found by that word.
_BRACKETED = re.compile(rf"{_OPEN}\s?(?:at|@|dot|\.)\s?{_CLOSE}")
_REFERENCE = re.compile(f"{_AT_REFERENCE}|{_DOT_REFERENCE}")
_SPACED_AT = re.compile(r"\s@\s")
_SPELLED_DOT = re.compile(r"[\s_-]dot[\s_-]")
_SPELLED_AT = re.compile(r"\sat\s+[a-z0-9-]+\.[a-z0-9]")
_SPELLED_PLUS = re.compile(r"plus\s+[0-9(]")
_SPELLED_DIGIT = {w: re.compile(rf"{w}(?<=\b{w})\b") for w in DIGITS}
_SAME_LETTER = {"\u017f": "s", "\u0130": "i", "\u0131": "i"}  # what re.IGNORECASE takes for a letter of the words, and lower() does not
_LAST = re.compile(r"[A-Za-z0-9._%+-]++\Z")
_LETTERS = re.compile("[A-Za-z]")
_NO_LOCAL = frozenset(["us", "me", "him", "her", "them", "you", "page", "form", "address"])
_TELLING = re.compile(r"[0-9._]")
_INTRODUCED = re.compile(r"(?:mail|contact|kontakt|correo|courriel)(?:\s*:)?\s+\Z", re.IGNORECASE)
# Dashes count between digits, where identifiers have hyphens; the hyphens of Unicode also between letters.
_FOREIGN = re.compile("[\u00ad\u0370-\u04ff\u0660-\u0669\u06f0-\u06f9\u200b-\u200d\u2024\u2060\ufe50-\ufe6b\ufeff\uff01-\uff5e\U0001d400-\U0001d7ff]"
                      r"|(?<=[0-9)])[\u2010-\u2015\u2212](?=[0-9(])|(?<=[A-Za-z0-9])[\u2010\u2011](?=[A-Za-z0-9])")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Of a run of local characters up to an @, the match starts at the run's first one; if the domain fails there, it fails for all."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield "email", begin, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def plain_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each kind, by start and then kind as listed."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _ascii_of(c: str) -> str:
    if c in ZERO_WIDTH:
        return ""
    if c in DASHES:
        return "-"
    plain = LOOK_ALIKE.get(c) or unicodedata.normalize("NFKC", c)
    if not plain.isascii() and c.isdigit():
        plain = str(unicodedata.digit(c))
    return plain if plain.isascii() and len(plain) == 1 else c


def _rewrite(text: str, begins: list[int], ends: list[int], pattern: re.Pattern, write) -> tuple[str, list[int], list[int]]:
    """Replace matches, except those that write gives None for; begins and ends say for each written character which source characters it stands for."""
    parts, b, e, done = [], [], [], 0
    for m in pattern.finditer(text):
        s, t = m.span()
        new = write(m)
        if new is None:
            continue
        parts += [text[done:s], new]
        b += begins[done:s] + [begins[s]] * len(new)
        e += ends[done:s] + [ends[t - 1]] * len(new)
        done = t
    parts.append(text[done:])
    return "".join(parts), b + begins[done:], e + ends[done:]


_LETTER = str.maketrans(_SAME_LETTER)


def _is_address(text: str, end: int) -> bool:
    """Whether what ends here reads as a local part: beside letters it holds a digit, dot or underscore, or a word for mail or contact
    stands before it, and it is none that often follows those."""
    local = _LAST.search(text, max(0, end - 64), end)
    if not local or not _LETTERS.search(local[0]) or local[0].lower() in _NO_LOCAL:
        return False
    return bool(_TELLING.search(local[0]) or _INTRODUCED.search(text, max(0, local.start() - 24), local.start()))


def _write(m: re.Match) -> str | None:
    if m.lastgroup == "plain_at":
        return "@" if _is_address(m.string, m.start()) else None
    return {"at": "@", "dot": ".", "plus": "+"}.get(m.lastgroup) or DIGITS[m["digit"].translate(_LETTER).lower()]


def disguised(text: str) -> bool:
    """A cheap test that holds for whatever the transducer would rewrite: one rule's words at a time, and never narrower than the rule."""
    if not text.isascii() and (_FOREIGN.search(text) or any(c in text for c in _SAME_LETTER)):
        return True
    low = text.lower()
    if any(c in text for c in "[({<") and _BRACKETED.search(low) or "dot" in low and _SPELLED_DOT.search(low) or "plus" in low and _SPELLED_PLUS.search(low):
        return True
    if "." in low and _SPELLED_AT.search(low) or "&" in low and _REFERENCE.search(low) or "@" in low and _SPACED_AT.search(low):
        return True
    return any(w in low and test.search(low) for w, test in _SPELLED_DIGIT.items())


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows: they cover a rewritten place and no plain span of their kind covers them wholly. One that
    reaches beyond a plain span, which then is a fragment of it, stays beside that."""
    if not disguised(text):
        return []
    n = len(text)
    new, begins, ends = text, list(range(n)), list(range(1, n + 1))
    if not text.isascii():
        new, begins, ends = _rewrite(new, begins, ends, _FOREIGN, lambda m: _ascii_of(m[0]))
    new, begins, ends = _rewrite(new, begins, ends, _RULES, _write)
    out = []
    for kind, s, e in plain_spans(new):
        a, b = begins[s], ends[e - 1]
        if text[a:b] != new[s:e] and not any(k == kind and x <= a and b <= y for k, x, y in base):
            out.append((kind, a, b))
    return out


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by the first one's kind in brackets."""
    parts, done = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))):
        if s >= done:
            parts += [text[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join(parts) + text[done:]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii_base and pii_added (arrays of kind, start, end in code points, end exclusive) and pii_redacted (the text with
    placeholders; null stays null).

    Null and empty texts have no spans. Rows are independent: repeated rows repeat their result, nothing is shuffled. Other columns
    pass through; columns that already have one of the three names are replaced."""
    prepare(docs.sparkSession)
    made = ["pii_base", "pii_added", "pii_redacted"]
    kept = [f for f in docs.schema.fields if f.name.lower() not in made]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"pii_base {_SPAN_SQL}", f"pii_added {_SPAN_SQL}", "pii_redacted string"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            base, added, clean = [], [], []
            for t, null in zip(texts_of(column).to_pylist(), column.is_null().to_pylist(), strict=True):
                one = plain_spans(t)
                two = added_spans(t, one)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in one])
                added.append([{"kind": k, "start": s, "end": e} for k, s, e in two])
                clean.append(None if null else redacted(t, one + two) if one or two else t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, _SPAN), pa.array(added, _SPAN), pa.array(clean, pa.string())], [*batch.schema.names, *made])

    return docs.select([F.col(f"`{f.name}`") for f in kept]).mapInArrow(find, schema)


def span_text(c) -> F.Column:
    """Spans as kind:start:end by start, then kind as listed, comma-joined."""
    rank = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(c, lambda s: F.struct(s["start"].alias("at"), F.array_position(rank, s["kind"]).alias("k"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("t")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["t"]), ",")


def count_kind(c, kind: str) -> F.Column:
    return F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("long")
