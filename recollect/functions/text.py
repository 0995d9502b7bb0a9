"""Text as column expressions: tokens, hashes, addresses, entities, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"
HAN = r"\x{4e00}-\x{9fff}"
#: Words too common to tell anything.
STOPWORDS = tuple("的了在是我有和就不人都一个上也到他没这要会对说而去之被她把那")
MOST_TOKENS = 30
#: A position between a word character of ASCII and anything else; Java's own \b knows more letters.
LEFT, RIGHT = r"(?<!\w)", r"(?!\w)"  # \w is [A-Za-z0-9_] here, looked up in a table


def matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def _by_first(words: tuple[str, ...]) -> tuple[str, str]:
    """The letters that words begin with, as a class, and what may follow them. So at most positions one letter is all that is looked at."""
    firsts = sorted({w[0] for w in words})
    rests = ("|".join(w[1:] for w in sorted(words, key=len, reverse=True) if w[0] == first) for first in firsts)
    return f"[{''.join(firsts)}]", "(?:" + "|".join(f"(?<={first})(?:{rest})" for first, rest in zip(firsts, rests)) + ")"


def ascii_words(*words: str) -> str:
    """Case-insensitive pattern of whole words, with ASCII borders; each begins with a plain letter."""
    first, rest = _by_first(words)
    return rf"(?i){first}(?<!\w.){rest}{RIGHT}"


def within_ascii(*words: str) -> str:
    """Words of other scripts that count only between two ASCII word characters, as an ASCII border asks."""
    first, rest = _by_first(words)
    return rf"{first}(?<=\w.){rest}(?=\w)"


#: White space of any kind: what \\s, \\p{Z} and the byte order mark stand for.
WHITE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def plain(c: Column) -> Column:
    """Whether a text is all ASCII; told by its length."""
    return F.octet_length(c) == F.length(c)


#: What is looked at first: most texts have their 30 tokens within so many letters.
HEAD_CHARS, HEAD_TOKENS = 1000, 120


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _latin(c: Column) -> Column:
    return F.filter(F.split(c, r"\W+"), lambda w: F.length(w) > 1)


def _first_distinct(tokens: Column) -> Column:
    """The first 30 distinct tokens. Telling distinct ones apart takes time with the square of their number, so few are tried first."""
    few = lambda t: F.array_distinct(F.slice(t, 1, HEAD_TOKENS))
    return let(tokens, lambda t: let(few(t), lambda d: F.slice(F.when(F.size(d) >= MOST_TOKENS, d).otherwise(F.array_distinct(t)), 1, MOST_TOKENS)))


def tokenize(c: Column) -> Column:
    """At most 30 distinct tokens: Latin words of two letters or more, then single and paired CJK letters.

    Latin words come first, so where the head of a text has 30 of them the rest cannot matter. The last
    word of the head may be cut and isn't counted.
    """

    def pieces(chunk: Column) -> Column:
        n = F.length(chunk)
        one = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(chunk, i, F.lit(1)))
        two = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(chunk, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(one, two)

    cjk = F.filter(F.flatten(F.transform(F.regexp_extract_all(c, F.lit(f"[{CJK}]+"), 0), pieces)), lambda w: ~w.isin(*STOPWORDS))
    whole = _first_distinct(F.concat(_latin(c), F.when(~plain(c) & matches(c, f"[{CJK}]"), cjk).otherwise(F.array().cast("array<string>"))))
    head = let(_latin(F.substring(c, 1, HEAD_CHARS)), lambda t: F.array_distinct(F.slice(t, 1, F.greatest(F.least(F.size(t) - 1, F.lit(HEAD_TOKENS)), F.lit(0)))))
    return F.when(F.length(c) > HEAD_CHARS, let(head, lambda h: F.when(F.size(h) >= MOST_TOKENS, F.slice(h, 1, MOST_TOKENS)).otherwise(whole))).otherwise(whole)


def terms(tokens: Column) -> Column:
    """Index terms of tokens, in order: lower case, accents dropped, split where no letter or digit stands."""
    bare = lambda w: F.translate(F.lower(w), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    parts = lambda w: F.when(matches(w, r"[^\p{L}\p{N}]"), F.split(w, r"[^\p{L}\p{N}]+")).otherwise(F.array(w))
    return F.filter(F.flatten(F.transform(F.transform(tokens, bare), parts)), lambda w: w != "")


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(stripped(c), 256), 1, 16)


def uri_domain(uri: Column) -> Column:
    """The part before ://, null where the address isn't one."""
    return F.nullif(F.regexp_extract(uri, r"^([a-z]+)://(.+)$", 1), F.lit(""))


def uri_path(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"^([a-z]+)://(.+)$", 2), F.lit(""))


def slugify(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(stripped(c)), rf"[^a-z0-9{HAN}]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 60)
    return F.when(cut == "", F.lit("item")).otherwise(cut)


def numbers(c: Column) -> Column:
    """Dotted numbers, and whole ones of two digits or more. A run of digits is tried from its start only, so that time stays in proportion to the text."""
    return F.regexp_extract_all(c, F.lit(r"\d(?<!\d\d)(?:\d*+(?:\.\d+)+|(?<!\w\d)\d++(?!\w))"), 0)


def entities(c: Column) -> Column:
    """Distinct names, numbers, tags, CJK runs and addresses, in order.

    An address is sought from the start of a word, or of what the last find left of it: from further within it ends alike.
    """
    kinds = ("[A-Z][A-Za-z0-9_-]+", r"\d+(?:[-/:]\d+)*", "[#@][A-Za-z0-9_-]+", f"[{HAN}]{{2,}}")
    address = rf"(?:{LEFT}|\G)\w++://\S+"
    found = F.when(F.contains(c, F.lit("://")), F.regexp_extract_all(c, F.lit("|".join((*kinds, address))), 0)).otherwise(F.regexp_extract_all(c, F.lit("|".join(kinds)), 0))
    return F.array_distinct(found)


def clauses(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[\n；;。.!?！？]+"), stripped), lambda x: x != "")


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n+"), stripped), lambda x: x != "")


def first_line(c: Column, most: int = 200) -> Column:
    return F.substring(F.split(c, "\n")[0], 1, most)
