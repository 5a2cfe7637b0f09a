"""Column functions that bring fields into one form: authors, genres, lists, numbers, and which of them a field takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import names
from lectern.functions import text as fx

# Suffixes that are no initials, lower-case words inside names, families of containers by extension.
SUFFIXES = ("II", "III", "IV", "V", "VI", "JR", "SR")
NAME_WORDS = ("van", "von", "de", "der", "den", "del", "di", "la", "le", "du", "da", "dos")
FAMILIES = {"mp3": "mpeg", "opus": "ogg", "ogg": "ogg", "oga": "ogg", "flac": "flac", "m4a": "mp4", "m4b": "mp4", "mp4": "mp4", "aac": "aac", "wav": "wav"}


def unshouted(name: Column, keep_acronyms: bool = False) -> Column:
    """A name all in capitals with only the first letters large; any lower-case letter leaves it as it is, and so does, if asked for, a single word."""
    shouted = name.rlike(r"\p{Lu}") & ~name.rlike(r"[\p{L}&&[^\p{Lu}]]")
    if keep_acronyms:
        shouted = shouted & names.stripped(name).contains(" ")
    return F.when(shouted, fx.title_case(name, small_words=False)).otherwise(name)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def author_name(name: Column) -> Column:
    """An author's name to show: not shouted, underscores and glued capitals apart, initials as ``J. D.``, stray marks at the ends of words gone. Blank names stay."""
    particles = "|".join(fx.PARTICLES)
    plain = F.replace(unshouted(name, keep_acronyms=True), F.lit("_"), F.lit(" "))
    # where a small letter meets a capital, unless what stands before it since the last such place is a particle
    apart = F.regexp_replace(plain, rf"(?<=\p{{Ll}})(?<!(?<!\S)(?i:{particles}))(?<!\p{{Ll}}(?=\p{{Lu}})(?i:{particles}))(?=\p{{Lu}})", " ")
    words = F.filter(F.transform(_words(apart), lambda w: F.regexp_replace(w, r"^[=|~^*]+|[=|~^*]+$", "")), lambda w: w != "")
    letters = lambda w: F.replace(w, F.lit("."), F.lit(""))
    initials = lambda w: letters(w).rlike(r"^\p{Lu}{1,4}$") & ~F.upper(w).isin(*SUFFIXES)
    dotted = lambda w: F.trim(F.regexp_replace(letters(w), r"(\p{Lu})", "$1. "))
    return F.when(names.stripped(name) == "", name).otherwise(F.array_join(F.transform(words, lambda w: F.when(initials(w), dotted(w)).otherwise(w)), " "))


def person_name(value: Column) -> Column:
    """Whether a text is shaped like the names of people: each of one to four words, all initials, capitalised or small words of names, and one that is no small word."""
    small = "|".join(NAME_WORDS)
    word = rf"^(?:[A-Z][A-Za-z'’.\-]*|{small})$"
    fits = lambda ws: (F.size(ws) >= 1) & (F.size(ws) <= 4) & F.forall(ws, lambda w: w.rlike(word)) & F.exists(ws, lambda w: ~F.lower(w).rlike(rf"^(?:{small})$") & w.rlike(r"\p{L}"))
    parts = fx.people(value)
    return F.coalesce((F.size(parts) > 0) & F.forall(parts, lambda p: fits(_words(p))), F.lit(False))


def distinct_by(values: Column, key) -> Column:
    """Values of an array whose key comes first, in order; ``key`` is a function of a value."""
    keyed = F.transform(values, lambda v: F.struct(key(v).alias("k"), v.alias("v")))
    keys = F.transform(keyed, lambda x: x["k"])
    return F.transform(F.filter(keyed, lambda x, i: F.array_position(keys, x["k"]) == i + 1), lambda x: x["v"])


def merged(existing: Column, new: Column) -> Column:
    """Both arrays' values, trimmed, the first of equal ones, no blanks."""
    listed = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(F.concat(listed(existing), listed(new)), names.stripped), lambda v: v != ""))


def genres(values: Column, mapping: dict[str, str] | None = None, accepted: tuple[str, ...] = ()) -> Column:
    """Genres in title case, synonyms replaced by ``mapping`` without case, blanks and repeated ones gone; only ``accepted`` ones if any are named."""
    low = lambda v: F.lower(names.stripped(v))
    if mapping:
        to = F.create_map(*(F.lit(x) for k, v in mapping.items() for x in (k.strip().lower(), v)))
        values = F.transform(values, lambda v: F.coalesce(to[low(v)], v))
    shown = F.filter(F.transform(values, lambda v: fx.title_case(F.coalesce(v, F.lit("")))), lambda v: v != "")
    kept = [a.strip().lower() for a in accepted if a.strip()]
    return distinct_by(F.filter(shown, lambda v: F.lower(v).isin(*kept)) if kept else shown, F.lower)


def split_list(value: Column, mark: str = ";") -> Column:
    """Trimmed parts of a list, blanks gone; null is empty."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), rf"\Q{mark}\E"), names.stripped), lambda p: p != "")


def join_list(values: Column, mark: str = "; ") -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, mark))


def whole_number(value: Column) -> Column:
    """The number that a text is, or null."""
    return names.stripped(value).try_cast("long")


def year(value: Column) -> Column:
    """The year in front of a date's text, or null."""
    return names.stripped(F.substring(value, 1, 4)).try_cast("int")


def container_family(extension: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))[F.regexp_replace(F.lower(extension), r"^\.+", "")]


#: What brings each free-text field into its form; codes and numbers have none.
FIELDS = {
    "title": fx.title_case, "subtitle": fx.title_case, "author": lambda c: fx.title_case(c, small_words=False), "narrator": lambda c: fx.title_case(c, small_words=False), "series": fx.title_case, "publisher": fx.title_case,
    "genre": lambda c: F.coalesce(join_list(genres(split_list(c))), F.lit("")), "description": fx.description,
}
