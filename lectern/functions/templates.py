"""The template languages: one for paths to build, one for file names to parse. Each template becomes Column expressions once.

A template holds ``$Token`` and literal text; ``$$`` is a dollar. In paths ``[ ... ]`` is a group that goes if one of its tokens is
empty, ``[[`` and ``]]`` are brackets, and an unknown token is empty. To parse, white space stands for any, and tokens may not repeat.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.names import FLAGS, squeezed, stripped

# Tokens that a name can be parsed into, their fields and what they may hold.
PARSED = {"author": ("author", ".+?"), "title": ("title", ".+?"), "narrator": ("narrator", ".+?"), "series": ("series", ".+?"), "sernum": ("sequence", r"[0-9]+(?:\.[0-9]+)?"), "pubyear": ("year", "[0-9]{4}"), "skip": (None, ".+?")}
# The older %placeholder% form of the same tokens.
PLACEHOLDERS = {"author": "Author", "title": "Title", "narrator": "Narrator", "series": "Series", "sequence": "SerNum", "year": "PubYear", "skip": "Skip", "subtitle": "Skip"}
PART_SUFFIX = " ($Part of $Total)"


class TemplateError(ValueError):
    """A template that can't be compiled."""


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Token:
    name: str


@dataclass(frozen=True)
class Group:
    parts: tuple[Text | Token, ...]


def scan(template: str) -> list[Text | Token | Group]:
    """A path template as texts, tokens and groups."""
    out: list[Text | Token | Group] = []
    group: list[Text | Token] | None = None
    for lexeme in re.findall(r"\$\$|\[\[|\]\]|\$\w+|[^$\[\]]+|.", template, re.DOTALL):
        to = out if group is None else group
        if lexeme == "[":
            if group is not None:
                raise TemplateError("nested [ bracket in a template")
            group = []
        elif lexeme == "]":
            if group is None:
                raise TemplateError("unbalanced ] bracket in a template")
            out.append(Group(tuple(group)))
            group = None
        elif len(lexeme) > 1 and lexeme[0] == "$" and lexeme != "$$":
            to.append(Token(lexeme[1:]))
        else:
            to.append(Text(lexeme[0] if lexeme in ("$$", "[[", "]]") else lexeme))
    if group is not None:
        raise TemplateError("unbalanced [ bracket in a template")
    return out


def tokens(template: str) -> list[str]:
    return [t.name for p in scan(template) for t in (p.parts if isinstance(p, Group) else (p,)) if isinstance(t, Token)]


def render(template: str, values: dict[str, Column]) -> Column:
    """The template filled from columns by token name; null values are empty."""
    value = lambda t: F.coalesce(values[t.name], F.lit("")) if t.name in values else F.lit("")
    text = lambda p: F.lit(p.value) if isinstance(p, Text) else value(p)

    def whole(part: Text | Token | Group) -> Column:
        if not isinstance(part, Group):
            return text(part)
        full = F.lit(True)
        for t in part.parts:
            if isinstance(t, Token):
                full = full & (value(t) != "")
        return F.when(full, F.concat(F.lit(""), *map(text, part.parts))).otherwise("")

    return F.concat(F.lit(""), *map(whole, scan(template)))


def derived(template: str, values: dict[str, Column]) -> Column:
    """As ``render``, but empty where every token of the template is, whatever literal text stands beside them."""
    named = [F.coalesce(values[t], F.lit("")) if t in values else F.lit("") for t in tokens(template)]
    return F.when(F.concat(*named) != "", render(template, values)).otherwise("") if named else render(template, values)


def sort_author(author: Column) -> Column:
    """``Last, First Middle``; a single word stays."""
    words = F.filter(F.split(author, rf"{FLAGS}\s+"), lambda w: w != "")
    n = F.size(words)
    return F.when(n > 1, F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, F.lit(1), n - 1), " "))).otherwise(author)


def sort_title(title: Column) -> Column:
    """Without a leading article."""
    return F.regexp_replace(title, r"(?Ui)^(?:the|a|an)\s+", "")


@dataclass(frozen=True)
class SeriesFormat:
    """Templates of the label of a series and of its two halves."""

    series: str = "($FmtName[ $FmtNum])"
    name: str = "$SerName"
    number: str = "Book #$SerNum"


def token_values(fields: dict[str, Column], series: SeriesFormat = SeriesFormat()) -> dict[str, Column]:  # noqa: B008
    """Columns of all tokens of a path from those of a book's fields; absent and null fields are empty.

    Fields: author, title, narrator, franchise, language (text), series_name (null: no series), sequence (double), year (int),
    abridged (boolean), part and total (int).
    """
    get = lambda name, kind: F.coalesce(fields.get(name, F.lit(None)).cast(kind), F.lit(None).cast(kind))
    text = lambda name: F.coalesce(get(name, "string"), F.lit(""))
    name, sequence = get("series_name", "string"), get("sequence", "double")
    whole = sequence == F.floor(sequence)
    number = F.when(name.isNotNull(), F.when(whole, sequence.cast("long").cast("string")).otherwise(sequence.cast("string")))
    padded = F.when(whole & (F.length(number) < 2), F.lpad(number, 2, "0")).otherwise(number)
    part, total = get("part", "int"), get("total", "int")
    width = F.greatest(F.lit(2), F.length(total.cast("string")))
    zeros = lambda n: F.when(part.isNotNull() & total.isNotNull(), F.lpad(n.cast("string"), F.greatest(width, F.length(n.cast("string"))), F.lit("0")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    base = {"SerName": empty(name), "SerNum": empty(number), "PadNum": empty(padded), "PubYear": empty(get("year", "int").cast("string")), "Language": text("language")}
    some = lambda c: F.when(name.isNotNull(), c).otherwise("")
    halves = {"FmtName": some(derived(series.name, base)), "FmtNum": some(derived(series.number, base))}
    return base | halves | {
        "Series": some(render(series.series, base | halves)), "Author": text("author"), "SortAuthor": sort_author(text("author")), "Title": text("title"), "SortTitle": sort_title(text("title")), "Franchise": text("franchise"),
        "Narrator": text("narrator"), "Part": empty(zeros(part)), "Total": empty(zeros(total)), "Abridged": empty(F.when(get("abridged", "boolean"), "Abridged").when(~get("abridged", "boolean"), "Unabridged")),
    }


def segment(text: Column) -> Column:
    """A path's segment without characters that file systems refuse, blanks at its ends and dots at its end."""
    return F.regexp_replace(stripped(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "")), "[. ]+$", "")


def target_path(folder: str, name: str, fields: dict[str, Column], extension: Column | str, series: SeriesFormat = SeriesFormat()) -> Column:  # noqa: B008
    """Relative path of a book by a folder and a file template (``$Title`` if blank): empty segments go, slashes in values make no folders."""
    values = token_values(fields, series)
    folders = F.filter(F.array(*(segment(render(s, values)) for s in folder.split("/"))), lambda s: s != "")
    extension = F.lit(extension) if isinstance(extension, str) else extension
    return F.array_join(F.array_append(folders, F.concat(segment(render(name or "$Title", values)), extension)), "/")


def part_path(folder: str, name: str, fields: dict[str, Column], extension: Column, series: SeriesFormat = SeriesFormat()) -> Column:  # noqa: B008
    """``target_path`` of one file of a book: with several files, a template without ``$Part`` gets ``(1 of n)`` behind it, with zeros.

    The extension may come without its dot.
    """
    name = name or "$Title"
    ext = F.trim(F.coalesce(extension, F.lit("")))
    ext = F.when((ext == "") | ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    single = {k: v for k, v in fields.items() if k not in ("part", "total")}
    several = name if "Part" in tokens(name) else name + PART_SUFFIX
    return F.when(fields["total"] > 1, target_path(folder, several, fields, ext, series)).otherwise(target_path(folder, name, single, ext, series))


def compile_parser(template: str) -> tuple[str, list[str]]:
    """A regular expression of the template, and the fields of its groups in order."""
    if "[" in template or "]" in template:
        raise TemplateError("a [ ... ] group can't be parsed, only built")
    pattern, fields = "", []
    for lexeme in re.findall(r"\$\$|\$[A-Za-z]+|\s+|[^$\s]+|\$", template):
        if lexeme[0] == "$" and lexeme not in ("$", "$$"):
            if lexeme[1:].lower() not in PARSED:
                raise TemplateError(f"unknown token {lexeme}, or one that can't be parsed")
            field, holds = PARSED[lexeme[1:].lower()]
            if field in fields:
                raise TemplateError(f"token {lexeme} is used more than once")
            pattern += f"({holds})" if field else f"(?:{holds})"
            fields += [field] if field else []
        else:
            pattern += r"\s+" if lexeme.isspace() else re.sub(r"([^\w\s])", r"\\\1", "$" if lexeme == "$$" else lexeme, flags=re.ASCII)
    return f"{FLAGS}^{pattern}$", fields


def parse_name(template: str, name: Column) -> Column:
    """Fields of a file name (its last extension left out) by the template, as a struct of texts; null where it doesn't match.

    Underscores in what is captured read as blanks.
    """
    pattern, fields = compile_parser(template)
    stem = F.regexp_replace(name, r"(?s)\.[^.]*$", "")
    clean = lambda k: squeezed(F.replace(F.regexp_extract(stem, pattern, k), F.lit("_"), F.lit(" ")))
    return F.when(stem.rlike(pattern), F.struct(*(clean(k + 1).alias(f) for k, f in enumerate(fields)))) if fields else F.when(stem.rlike(pattern), F.struct(stem.alias("name")))


def migrated(template: str) -> str:
    """A template in the older form with its %placeholders% as tokens; others stay."""
    return re.sub(r"%(\w+)%", lambda m: f"${PLACEHOLDERS[m[1]]}" if m[1] in PLACEHOLDERS else m[0], template)
