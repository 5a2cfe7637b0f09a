"""Column functions over file and folder names: part marks, track numbers, sequence numbers, folder titles, natural order.

All stay in the JVM. Null names give null, but for arrays of marks, which are empty then. Digits are those of any script where
they are only matched, ASCII where their value counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words before the number of a part, compact marks before a track number, words before a book's track numbers.
PART_WORDS = "cd|dvd|disc|disk|dvds?|part|pt|tape|side|track|trk|chap(?:ter)?|ch|sect(?:ion)?"
TRACK_MARKS = "cd|disc|d|t"
LEADING_WORDS = "chapter|chap|ch|part|track|disc|section|volume|vol"
#: One to three digits and no more, so that a year is no number of a part.
SHORT = "[0-9]{1,3}(?![0-9])"
DASHES = "-–—"
# Unicode classes, and only line feeds end lines.
FLAGS = "(?Ud)"

_RANGE = rf"{SHORT}(?:\s*-\s*{SHORT})?"
_WORD_MARK = rf"(?:{PART_WORDS})\s*[._-]?\s*{_RANGE}(?:\s*of\s*{SHORT})?[ab]?"
_MARK = rf"(?Udi)(?<!\w)(?:{_WORD_MARK}|{_RANGE}\s*of\s*{SHORT}|{SHORT}[ab])(?!\w)"
_WHOLE_MARK = rf"(?Udi)^\s*(?:{_WORD_MARK}|{_RANGE}\s*of\s*{SHORT}[ab]?|{_RANGE}[ab])\s*$"
_INDEX = rf"(?Udi)^\s*((?:{TRACK_MARKS})?{SHORT}(?:(?:[-_](?=(?:{TRACK_MARKS})?{SHORT})|(?=(?:{TRACK_MARKS})[0-9]))(?:{TRACK_MARKS})?{SHORT})*)(?:\.([0-9]{{1,2}})|([a-z])(?![a-z0-9]))?"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"{FLAGS}^\s+|\s+$", "")


def squeezed(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{FLAGS}\s+", " "))


def _some(text: Column) -> Column:
    return F.when(text != "", text)


def _mark(found: Column) -> Column:
    number = lambda pattern: _some(F.regexp_extract(found, pattern, 1)).cast("int")
    return F.struct(
        number("([0-9]{1,3})").alias("index"), number(r"(?Ui)of\s*([0-9]{1,3})").alias("total"), number(r"(?U)[0-9]\s*-\s*([0-9]{1,3})").alias("end"),
        F.lower(F.regexp_extract(found, r"(?Ui)[0-9]([ab])\s*$", 1)).alias("half"),
    )


def part_marks(name: Column) -> Column:
    """Array of (index, total, end, half) of the part marks in a name, in order: ``Disc 05``, ``1of9``, ``01-06 of 20``, ``13b``.

    A number alone is no mark: it takes a word, a total or a half.
    """
    return F.transform(F.coalesce(F.regexp_extract_all(name, F.lit(_MARK), F.lit(0)), F.array().cast("array<string>")), _mark)


def part_of(token: Column) -> Column:
    """The mark that a whole token is, or null."""
    return F.when(token.rlike(_WHOLE_MARK), _mark(token))


def without_parts(name: Column) -> Column:
    """A name without its part marks, blanks tidied, dashes, underscores and dots at the ends gone."""
    plain = F.regexp_replace(F.regexp_replace(name, _MARK, " "), rf"{FLAGS}\s{{2,}}", " ")
    return F.regexp_replace(plain, r"^[ \-_.]+|[ \-_.]+$", "")


def track_index(name: Column) -> Column:
    """(components, subpart) of the number in front of a name, or null: ``02-01`` is [2, 1], ``d2t01 x`` too, ``06b`` is [6] with ``b``, ``12.5`` [12] with ``5``."""
    front = F.regexp_extract(name, _INDEX, 1)
    numbers = F.transform(F.regexp_extract_all(front, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    rest = F.concat(F.regexp_extract(name, _INDEX, 2), F.lower(F.regexp_extract(name, _INDEX, 3)))
    return F.when(front != "", F.struct(numbers.alias("components"), rest.alias("subpart")))


def leading_word(name: Column) -> Column:
    """The word (``chapter``, ``disc`` ...) in front of a name, lower case, or null; it counts only where all names of a book share it."""
    return _some(F.lower(F.regexp_extract(name, rf"(?Udi)^\s*({LEADING_WORDS})\b[\s._-]*", 1)))


def without_leading_word(name: Column) -> Column:
    return F.regexp_replace(name, rf"(?Udi)^\s*(?:{LEADING_WORDS})\b[\s._-]*", "")


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits count as numbers: array of (text, number), lower case; any number of runs of up to 38 digits."""
    texts = F.split(F.lower(name), "[0-9]+")
    numbers = F.transform(F.regexp_extract_all(name, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("decimal(38,0)"))
    return F.zip_with(texts, numbers, lambda t, n: F.struct(t.alias("text"), n.alias("number")))


def enumeration(text: Column) -> Column:
    """(residue, pairs): text without its ``N of M`` and ``N/M`` counts, and these as (n, m). Without a count the text is as it was."""
    pattern = rf"(?Udi)\b({SHORT})\s*(?:of|/)\s*({SHORT})\b"
    number = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    pairs = F.zip_with(number(1), number(2), lambda n, m: F.struct(n.cast("int").alias("n"), m.cast("int").alias("m")))
    residue = F.when(F.size(pairs) > 0, squeezed(F.regexp_replace(text, pattern, " "))).otherwise(text)
    return F.when(text.isNotNull(), F.struct(residue.alias("residue"), pairs.alias("pairs")))


def sequence_affix(name: Column) -> Column:
    """(sequence, cleaned, strong) of a number that hangs before or after a title, or null where there is none or no letter is left.

    It is strong in brackets or with white space beside its dash; ``30-Day`` and ``Catch-22`` are weak.
    """
    number = r"[0-9]{1,3}(?:\.[0-9]{1,2})?"
    before = rf"{FLAGS}^\s*({number})(\s*)([-_)\].–—])(\s*)(\S.*)$"
    bracket = rf"{FLAGS}^(.*?\S)\s*[(\[]\s*({number})\s*[)\]]\s*$"
    after = rf"{FLAGS}^(.*?\S)(\s*)[-_–—](\s*)({number})\s*$"
    of = lambda pattern, k: F.regexp_extract(name, pattern, k)

    def made(num: Column, rest: Column, strong: Column) -> Column:
        rest = stripped(rest)
        return F.when(rest.rlike(r"\p{L}"), F.struct(num.cast("double").alias("sequence"), rest.alias("cleaned"), strong.alias("strong")))

    blank = lambda pattern, *groups: F.concat(*(of(pattern, k) for k in groups)) != ""
    return (
        F.when(name.rlike(before), made(of(before, 1), of(before, 5), of(before, 3).isin(")", "]") | blank(before, 2, 4)))
        .when(name.rlike(bracket), made(of(bracket, 2), of(bracket, 1), F.lit(True)))
        .when(name.rlike(after), made(of(after, 4), of(after, 1), blank(after, 2, 3)))
    )


def folder_title(name: Column) -> Column:
    """(title, year, narrators, series, sequence) of a folder name such as ``(Saga Book #6) 1981 - Title (Unabridged, read by A and B)``.

    The number of a book and its series, the year and the narrators are taken out in this order; what the name lacks is null,
    narrators an empty array.
    """
    s = stripped(name)
    series, bare = r"(?Udi)^\s*\(\s*(.+?)\s+(?:book\s+)?#\s*([0-9]+(?:\.[0-9]+)?)\s*\)\s*", rf"{FLAGS}^\s*#\s*([0-9]+(?:\.[0-9]+)?)\s*[-–—_]\s*"
    in_series = s.rlike(series)
    sequence = _some(F.when(in_series, F.regexp_extract(s, series, 2)).otherwise(F.regexp_extract(s, bare, 1))).cast("double")
    of_series = _some(stripped(F.regexp_replace(stripped(F.regexp_extract(s, series, 1)), ",+$", "")))
    s = F.when(in_series, F.regexp_replace(s, series, "")).otherwise(F.regexp_replace(s, bare, ""))
    dated = r"(?Ud)^\s*([12][0-9]{3})\s*[-–—_]\s*"
    year = _some(F.regexp_extract(s, dated, 1)).cast("int")
    s = F.regexp_replace(s, dated, "")
    # what stands before ``read by``, cut at its last bracket, and what stands after the bracket that closes it
    reader = r"(?Usi)^(.*?)read by\s+([^)]+)(.*)$"
    read = s.rlike(reader)
    front, names, back = (F.regexp_extract(s, reader, k) for k in (1, 2, 3))
    tail = F.regexp_replace(back, r"(?s)^\)", "")
    end = rf"{FLAGS}[\s{DASHES}]+$"
    inner = stripped(F.regexp_replace(F.substring_index(front, "(", -1), end, ""))
    head = F.regexp_replace(F.regexp_extract(front, r"(?s)^(.*)\(", 1), rf"{FLAGS}\s+$", "")
    bracketed = F.when(inner != "", F.concat(head, F.lit(" ("), inner, F.lit(")"), tail)).otherwise(F.concat(head, tail))
    rest = F.when(~read, s).when(front.contains("("), bracketed).otherwise(F.regexp_replace(front, end, ""))
    people = F.filter(F.transform(F.split(stripped(names), r"(?Udi)\s*(?:,|&|\band\b)\s*"), stripped), lambda p: p != "")
    narrators = F.when(read, people).otherwise(F.array().cast("array<string>"))
    return F.when(name.isNotNull(), F.struct(squeezed(rest).alias("title"), year.alias("year"), narrators.alias("narrators"), F.when(in_series, of_series).alias("series"), sequence.alias("sequence")))
