"""Column functions over names, codes, people lists, durations and paths. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words that a title keeps in lower case except first, last and after a colon or dash.
SMALL_WORDS = (
    "a", "an", "the",
    "and", "or", "but", "nor", "for", "yet", "so",
    "of", "in", "on", "at", "to", "by", "up", "as", "off", "per", "via", "from", "into", "with", "over",
    "vs", "vs.",
)
# Fixed value: name particles that stay joined to the capital after them.
PARTICLES = ("mc", "mac", "o", "de", "di", "du", "la", "le", "van", "von", "der", "den", "st", "fitz")


def _folded() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters whose compatibility form is one character and marks, what stays of each, and Latin ones whose form is several characters."""
    one, to, several = [], [], []
    for c in map(chr, [*range(0xA0, 0x3130), *range(0xA640, 0xA7FF), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and len(plain) == 1:
            one.append(c)
            to.append(plain)
        elif len(plain) > 1 and plain.isalpha() and unicodedata.name(c, "").startswith("LATIN"):
            several.append((c, plain))
    return "".join(one), "".join(to), several


def without_accents(name: Column) -> Column:
    """Letters without their accents: of the alphabets up to U+312F, with full-width forms and Latin ligatures; others stay as they are."""
    one, to, several = _folded()
    plain = F.translate(F.regexp_replace(name, r"\p{Mn}", ""), one, to)
    for c, text in several:
        plain = F.replace(plain, F.lit(c), F.lit(text))
    return plain


def entity_key(name: Column) -> Column:
    """Comparison key of a name: ``Last, First`` turned round, accents dropped, camel case split except after a particle,
    punctuation to spaces, single letters in a row joined, lower case. Letters of any script stay; null gives null.

    Accents are dropped in the JVM; ASCII names skip that.
    """
    turned = F.regexp_replace(F.trim(name), r"^([^,]*),\s*(.*)$", "$2 $1")
    plain = F.when(turned.rlike(r"[^\x00-\x7F]"), without_accents(turned)).otherwise(turned)
    spaced = F.regexp_replace(plain, rf"(?<=\p{{Ll}})(?<!(?i:\b(?:{'|'.join(PARTICLES)})))(?=\p{{Lu}})", " ")
    words = F.trim(F.lower(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " ")))
    return F.regexp_replace(words, r"(?<![\p{L}\p{N}])([\p{L}\p{N}]) (?=[\p{L}\p{N}](?![\p{L}\p{N}]))", "$1")


def title_case(text: Column, small_words: bool = True) -> Column:
    """Capitalised words, small ones in lower case except first, last and after a colon or dash; names have no small words.

    Underscores and hyphens inside words become spaces, a hyphen beside white space a dash, commas get one space after them.
    """
    dashed = F.regexp_replace(F.replace(F.trim(text), F.lit("_"), F.lit(" ")), r"\s+-\s*|-\s+", "\u0001")
    plain = F.replace(F.replace(dashed, F.lit("-"), F.lit(" ")), F.lit("\u0001"), F.lit(" - "))
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s*,\s*", ", "), r"\s+", " ")), " ")
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    before = lambda i: F.coalesce(F.get(words, i - 1), F.lit(":"))
    small = lambda w, i: F.lower(w).isin(*SMALL_WORDS) & (i < F.size(words) - 1) & ~before(i).endswith(":") & (before(i) != "-")
    return F.array_join(F.transform(words, (lambda w, i: F.when(small(w, i), F.lower(w)).otherwise(cap(w))) if small_words else cap), " ")


def isbn13(nine: Column) -> Column:
    """ISBN-13 of the first nine digits of an ISBN-10."""
    twelve = F.concat(F.lit("978"), nine)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda acc, i: acc + F.substring(twelve, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return F.concat(twelve, ((10 - total % 10) % 10).cast("string"))


def plain_isbn(code: Column) -> Column:
    """Code without hyphens and white space at its ends or between, in capitals; null if nothing is left. Check digits aren't tested."""
    out = F.upper(F.trim(F.regexp_replace(code, "[- ]", "")))
    return F.when(out != "", out)


def canonical_isbn(code: Column) -> Column:
    """ISBN-13 of 13 digits (as they are) or of an ISBN-10 (its last digit recomputed); null for anything else."""
    plain = plain_isbn(code)
    return F.when(plain.rlike("^[0-9]{13}$"), plain).when(plain.rlike("^[0-9]{9}[0-9X]$"), isbn13(F.substring(plain, 1, 9)))


def same_isbn(a: Column, b: Column) -> Column:
    """Whether two codes are of one ISBN; false where one isn't a code."""
    return F.coalesce(canonical_isbn(a) == canonical_isbn(b), F.lit(False))


def people(value: Column) -> Column:
    """Array of people from a list joined by ``&``, ``and`` between blanks, or ``;``; blanks go.

    A part is cut at its commas, too, if there are at least two names between them and each has an inner blank.
    """
    some = lambda x, by: F.filter(F.transform(F.split(x, by), lambda p: F.trim(p)), lambda p: p != "")
    full = lambda names: (F.size(names) >= 2) & F.forall(names, lambda n: n.contains(" "))
    parts = some(value, r"\s*&\s*|\s+and\s+|\s*;\s*")
    return F.flatten(F.transform(parts, lambda p: F.when(full(some(p, ",")), some(p, ",")).otherwise(F.array(p))))


def description(html: Column) -> Column:
    """Plain text of an HTML fragment: breaks to line feeds, tags out, the five basic entities decoded, runs collapsed."""
    out = F.regexp_replace(html, r"(?i)<(?:br|/p|/div)[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), r"\n\s*\n+", "\n"))


def timecode(seconds: Column) -> Column:
    """H:MM:SS of whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", (s / 3600).cast("long"), (s % 3600 / 60).cast("long"), s % 60)


def seconds_of(code: Column) -> Column:
    """Whole seconds of H:MM:SS, M:SS or S; null for anything else."""
    return F.when(code.rlike(r"^\d{1,9}(:\d{1,9}){0,2}$"), F.aggregate(F.split(code, ":"), F.lit(0).cast("long"), lambda acc, x: acc * 60 + x.try_cast("long")))


def path_id(path: Column) -> Column:
    """First 16 hexadecimal digits of the path's SHA-1."""
    return F.substring(F.sha1(path.cast("binary")), 1, 16)
