"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, schemes, pairs of digits (alone or around a dot, as every
account, telephone number and numeric address has them) and cue words of credentials and of identifiers
such as accounts and passports. At each anchor a
small parser looks at its surroundings only, expands to the real boundaries, however far, and validates.

What one anchor has looked at isn't looked at again by the next, so the time is in proportion to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import row_schema

CUES = ("token", "secret", "password", "passwd", "passphrase", "api_key", "api-key", "apikey", "access_key", "private_key", "authorization", "bearer")
#: Words that an identifier of any length follows, and the kind of it.
IDENTIFIERS = {
    **dict.fromkeys(("account", "acct", "a/c", "routing", "sort code", "passport", "national id", "tax id", "driver license", "driver's license", "driving licence", "license number", "licence number", "customer number", "customer id", "member id", "policy number"), "account"),
    **dict.fromkeys(("ssn", "social security"), "ssn"),
}
PREFIXES = ("AKIA", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk-", "sk_live_", "glpat-")
#: From strongest to weakest; where finds overlap, the longer one counts, then the stronger.
KINDS = ("secret", "email", "url", "iban", "card", "account", "ssn", "phone", "ip")

LOCAL = frozenset(".!#$%&'*+/=?^_`{|}~-")
DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
#: What may stand between a cue and its value: the end of its word, quotes, blanks, a sign.
SIGN = re.compile(r"[A-Za-z_-]*+[\"']?\s*+(?:=>|[:=]|is)?\s*+[\"']?")
VALUE = re.compile(r"[A-Za-z0-9_+/=.~-]{8,}")
TAIL = re.compile(r"[A-Za-z0-9_-]{10,}")
#: From the end of an identifier cue to its value: words for number, a sign, a quote.
LINK = re.compile(r"s?(?:[\s_-]*+(?:numbers?|num|nr|no|id|code|ref(?:erence)?)(?![a-z])\.?){0,2}[\"']?\s*+(?:#|[:=]>?|is(?![a-z])|was(?![a-z])|-)?\s*+#?[\"'(]?", re.I)
IDENTIFIER = re.compile(r"(?:(?<![A-Za-z])|(?=\d))(?!\d{4}-\d\d-\d\d(?!\d))(?:[A-Z]{1,4}[ -])?(?=[A-Za-z]*\d)[A-Za-z0-9]+(?:(?:[./-]| (?=\w{2}))(?=[A-Za-z]*\d)[A-Za-z0-9]+)*(?![\w])")
NUMBERS = (
    ("secret", re.compile(r"(?<![\w])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}(?!\w)")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("card", re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}(?:([ -])\d{4}){3}(?:\1\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|(?<=\+\d[ .-])\d{2,4}[ .-]\d{3,4}[ .-]?\d{3,4}|(?<=\+\d\d[ .-])\d{2,4}[ .-]\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{8,15}(?!\w)")),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)")),
)
#: What lies within a number or beside it, without blanks; and how the window that the parsers see goes on.
NEAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.+-()")
ONWARD = re.compile(r"(?:[0-9A-Za-z.+()-]| (?=[0-9A-Z.+() -]))*+")
#: The shortest number there is has so many signs: a numeric address.
LEAST = 7


@dataclass(frozen=True)
class Private:
    #: Kinds that are masked in the text; the others are only reported.
    kinds: tuple[str, ...] = KINDS
    mask: str = "<{}>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def anchors():
    a = ahocorasick.Automaton()
    digits = "0123456789"
    for x in digits:
        for y in digits:
            a.add_word(x + y, ("number", 2))
            a.add_word(x + "." + y, ("number", 3))
    a.add_word("@", ("email", 1))
    a.add_word("://", ("url", 3))
    for cue in CUES:
        a.add_word(cue, ("cue", len(cue)))
    for cue in IDENTIFIERS:
        a.add_word(cue, ("identifier", len(cue)))
    for prefix in PREFIXES:
        a.add_word(prefix.lower(), ("prefix", len(prefix)))
    a.make_automaton()
    return a


_shared: list = []


def automaton():
    if not _shared:
        _shared.append(anchors())
    return _shared[0]


def email_at(text: str, at: int):
    """The address around the at-sign at `at`."""
    m = DOMAIN.match(text, at + 1)
    if not m:
        return None
    lo = at
    while lo > 0 and ((c := text[lo - 1]).isalnum() or c in LOCAL):
        lo -= 1
    while lo < at and text[lo] in ".!#$%&'*+/=?^`{|}~-":
        lo += 1
    if lo == at or text[at - 1] == "." or ".." in text[lo:at]:
        return None
    return lo, m.end(), "email"


def url_at(text: str, at: int):
    """The address around the `://` at `at`."""
    if not text[at + 3 : at + 4].isalnum():
        return None
    lo = at
    while lo > 0 and text[lo - 1] in SCHEME:
        lo -= 1
    while lo < at and not text[lo].isalpha():
        lo += 1
    if lo == at:
        return None
    end = REST.match(text, at + 3).end()
    while text[end - 1] in ".,;:!?)]*&$%#":
        end -= 1
    return lo, end, "url"


def secret_after(text: str, end: int):
    """The value that follows a cue ending at `end`, and how far it was looked for."""
    sign = SIGN.match(text, end)
    m = VALUE.match(text, sign.end()) or VALUE.match(text, end)  # or the cue's word itself goes on as the value
    if not m:
        return None, sign.end()
    value = m[0].rstrip(".-=") if m[0][-1] in ".-" else m[0]
    digits = sum(map(value.count, "0123456789"))
    return (m.start(), m.start() + len(value), "secret") if len(value) >= 8 and 2 <= digits < len(value) else None, max(sign.end(), m.end())


def identifier_after(text: str, start: int, end: int):
    """The account or the like that follows the cue text[start:end]: at least five letters and digits, four of them digits."""
    if start and text[start - 1].isalnum():
        return None
    m = IDENTIFIER.match(text, LINK.match(text, end).end())
    if not m or sum(c.isalnum() for c in m[0]) < 5 or sum(c.isdigit() for c in m[0]) < 4:
        return None
    return m.start(), m.end(), IDENTIFIERS[text[start:end].lower()]


def secret_at(text: str, start: int, end: int):
    """The key that begins with a known prefix, and how far it was looked for."""
    if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        return None, start
    m = TAIL.match(text, end)
    if not m:
        return None, start
    return (start, m.end(), "secret") if any(map(m[0].__contains__, "0123456789")) and any(text.startswith(p, start) for p in PREFIXES) else None, m.end() if not any(map(m[0].__contains__, "0123456789")) else start


def numbers_in(text: str, lo: int, hi: int):
    """All numeric identifiers that lie wholly in text[lo:hi]."""
    for kind, pattern in NUMBERS:
        for m in pattern.finditer(text, lo, hi):
            found = kind
            if kind == "card":
                digits = "".join(c for c in m[0] if c.isdigit())
                found = "card" if luhn(digits) else "account"
            elif kind == "iban" and not iban_valid(m[0]) or kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            yield m.start(), m.end(), found


def window(text: str, start: int, end: int, seen: int) -> tuple[int, int]:
    """What may belong to a number around text[start:end]: words with digits before it, and what goes on after it.

    Nothing before `seen`, where an earlier window ended, belongs to it.
    """
    lo = start
    while lo > seen and text[lo - 1] in NEAR:
        lo -= 1
    while lo - 1 > seen and text[lo - 1] == " ":
        word = lo - 1
        while word > seen and text[word - 1] in NEAR:
            word -= 1
        if not any(c.isdigit() for c in text[word : lo - 1]):
            break
        lo = word
    return lo, ONWARD.match(text, end).end()


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in order, not overlapping, as character places."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length
        low = "".join(c.lower() if c.isascii() else c for c in text)
    found, seen = [], dict.fromkeys(("number", "url", "cue", "prefix", "identifier"), 0)
    for end, (kind, n) in automaton().iter(low):
        start, end = end - n + 1, end + 1
        if kind == "email":
            one = email_at(text, start)
        elif start < seen[kind] and end <= seen[kind]:  # an earlier find of the kind holds it, or what can follow was in vain
            continue
        elif kind == "number":
            lo, hi = window(text, start, end, seen[kind])
            seen[kind] = hi
            found += numbers_in(text, lo, hi) if hi - lo >= LEAST else ()
            continue
        elif kind == "url":
            one = url_at(text, start)
            seen[kind] = one[1] if one else 0
        elif kind == "cue":
            one, seen[kind] = secret_after(text, end)
        elif kind == "prefix":
            one, seen[kind] = secret_at(text, start, end)
            seen[kind] = one[1] if one else seen[kind]
        else:
            one = identifier_after(text, start, end)
            seen[kind] = one[1] if one else 0
        if one:
            found.append(one)
    return apart(found)


def apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of finds that overlap the longest, then the strongest, then the first; in order of place."""
    starts: list[int] = []
    out: list[tuple[int, int, str]] = []
    for one in sorted(set(found), key=lambda x: (x[0] - x[1], KINDS.index(x[2]), x[0])):
        i = bisect_left(starts, one[0])
        if (i == 0 or out[i - 1][1] <= one[0]) and (i == len(out) or one[1] <= starts[i]):
            starts.insert(i, one[0])
            out.insert(i, one)
    return out


def masked(text: str, spans: list[tuple[int, int, str]], config: Private = Private()) -> str:
    parts, at = [], 0
    for start, end, kind in spans:
        if kind in config.kinds:
            parts += [text[at:start], config.mask.format(kind.upper())]
            at = end
    return "".join([*parts, text[at:]])


SPANS = "array<struct<kind:string,start:int,length:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))


def _found(docs: DataFrame, config: Private) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                spans = [None if x is None else find(x) for x in texts]
                new = [masked(x, s, config) if s else x for x, s in zip(texts, spans, strict=True)]
                told = [None if s is None else [{"kind": k, "start": a, "length": b - a} for a, b, k in s] for s in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string()), pa.array(told, _SPANS)], names=["row", "text", "spans"])

    return rows.mapInArrow(run, row_schema(rows, f"text string, spans {SPANS}"))


def redact(docs: DataFrame, config: Private = Private()) -> DataFrame:
    """(doc_id, text, n_found, spans), one row for each row of docs.

    text has each find replaced by its kind, as in <EMAIL>; spans lie in the original text, by character.
    Finds of one document don't overlap; of those that would, the longest counts. A null text stays null,
    with null n_found and spans; an empty one has none. Texts of any length are read whole, in time in
    proportion to their length, and a find of any length is masked whole. Repeated rows stay, each on its
    own. An empty table gives an empty one. Further columns are ignored.
    """
    return _found(docs.select("doc_id", "text"), config).select(F.col("row.doc_id").alias("doc_id"), "text", F.when(F.col("spans").isNotNull(), F.size("spans")).cast("long").alias("n_found"), "spans")


def redacted(docs: DataFrame, config: Private = Private()) -> DataFrame:
    """The documents, all columns, with personal data replaced in text; n_chars, if there, follows it.

    For null, empty and long texts, repeated rows and empty tables see redact.
    """
    new = {c: F.col("text") if c == "text" else F.col("row")[c] for c in docs.columns}
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return _found(docs, config).select(*[x.alias(c) for c, x in new.items()])
