"""Column builders over whole texts: lines, match positions, sections."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# Every separator that ends a line for ``str.splitlines``.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\u0085  ]"
_BREAK_CHARS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85  "
BLANKS = " \t\n\r\f\x0b"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim blanks and tabs, not only spaces."""
    return F.btrim(col(c), F.lit(BLANKS))


def contains(c: Column, needle: str) -> Column:
    return F.contains(c, F.lit(needle))


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    """Whether one of the literals occurs: much cheaper than a regex, hence also asked in front of one."""
    return reduce(or_, [contains(c, n) for n in needles])


def around(c: Column, mark: str) -> Column:
    """A text without the words that lie between blanks and touch no ``mark``, a single character.

    A pattern whose matches hold a mark and no blank, except as their first character, finds the same
    in what is left, which is short where marks are rare.
    """
    blank = F.lit(" ")

    def ends(piece: Column) -> Column:
        outer = F.concat(F.substring_index(piece, " ", 1), blank, F.substring_index(piece, " ", -1))
        return F.when(F.contains(piece, blank), outer).otherwise(piece)

    return F.array_join(F.transform(F.split(c, re.escape(mark), -1), ends), mark)


def count_of(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.length(c) - F.length(F.replace(c, F.lit(needle)))
    return (gone / F.lit(len(needle))).cast("int")


def newline_count(c: Column | str) -> Column:
    """Number of newline characters."""
    c = col(c)
    return F.length(c) - F.length(F.replace(c, F.lit("\n")))


def split_lines(c: Column | str) -> Column:
    """Lines of a text; a final break leaves one empty element at the end."""
    return F.split(col(c), LINE_BREAK, -1)


def ends_with_break(c: Column | str) -> Column:
    return reduce(or_, [F.endswith(col(c), F.lit(b)) for b in _BREAK_CHARS])


def line_total(c: Column | str) -> Column:
    """Number of lines as a text editor counts them: no empty line after a final break."""
    c = col(c)
    tail = (ends_with_break(c) | (c == F.lit(""))).cast("int")
    # most texts break by \n only: counted without a list of lines
    odd = contains_any(c, _BREAK_CHARS[1:])
    return F.when(odd, F.size(split_lines(c))).otherwise(newline_count(c) + 1) - tail


def without_final_break(c: Column | str) -> Column:
    """The text without one final line break, so that a split gives the real lines."""
    c = col(c)
    drop = F.when(F.endswith(c, F.lit("\r\n")), 2).when(ends_with_break(c), 1).otherwise(0)
    return F.when(drop > 0, F.left(c, F.length(c) - drop)).otherwise(c)


def first_chars(c: Column, n: int | None) -> Column:
    """The first ``n`` characters, or all of them."""
    return c if n is None else F.substring(c, 1, n)


def explode_lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line with a 1-based number. Narrow: no shuffle.

    ``posexplode_outer`` keeps Spark from splitting twice: a plain explode gets a size filter
    in front that evaluates the split again. Texts that break by newlines only, most of them, are split by
    that character, the others by a pattern.
    """
    body = F.col("_body")
    lines = F.when(contains_any(body, _BREAK_CHARS[1:]), split_lines(body)).otherwise(F.split(body, "\n", -1))
    return (
        files.filter(F.col("text") != "").select(*keep, without_final_break("text").alias("_body"))
        .select(*keep, F.posexplode_outer(lines).alias("_pos", "line"))
        .select(*keep, (F.col("_pos") + 1).alias("line_no"), "line")
    )


def matches_with_line(c: Column | str, pattern: str, groups: tuple[int, ...] = (0,)) -> Column:
    """All matches of a pattern over a whole text, with the line each one starts on.

    Result: ``array<struct<line:int, g0:string, g1:string, ...>>``. The line of match *i* is
    one plus the newlines in front of it, i.e. in the first *i*+1 pieces between matches and
    the first *i* matches. ``pattern`` must not match the empty string.
    """
    c = col(c)
    regex = F.lit(pattern)
    found = F.regexp_extract_all(c, regex, F.lit(0))
    pieces = F.transform(F.split(c, pattern, -1), newline_count)
    inside = F.transform(found, newline_count)
    # running sums: start[i] = sum(pieces[0..i]) + sum(inside[0..i-1])
    steps = F.zip_with(
        F.slice(pieces, 1, F.size(inside)),
        inside,
        lambda p, m: F.struct(p.alias("p"), m.alias("m")),
    )
    starts = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("seen"), F.array().cast("array<int>").alias("at")),
        lambda acc, s: F.struct(
            (acc["seen"] + s["p"] + s["m"]).alias("seen"),
            F.concat(acc["at"], F.array(acc["seen"] + s["p"] + 1)).alias("at"),
        ),
        lambda acc: acc["at"],
    )
    columns = [starts] + [F.regexp_extract_all(c, regex, F.lit(g)) for g in groups]
    zipped = F.arrays_zip(*columns)
    return F.transform(
        zipped,
        lambda z: F.struct(
            z["0"].alias("line"), *[z[str(i + 1)].alias(f"g{g}") for i, g in enumerate(groups)]
        ),
    )


def glob_regex(globs: tuple[str, ...], anywhere: bool = True) -> str:
    """File-name globs as one regex; ``anywhere`` tests every path segment."""
    parts = []
    for g in globs:
        pieces = [re.escape(p) for p in re.split(r"(\*|\?)", g) if p not in ("*", "?")]
        wild = re.findall(r"\*|\?", g)
        out = pieces[0] if pieces else ""
        for w, p in zip(wild, pieces[1:] + [""] * (len(wild) - len(pieces) + 1)):
            out += ("[^/]*" if w == "*" else "[^/]") + p
        parts.append(out)
    body = "|".join(parts)
    return f"(^|/)({body})(/|$)" if anywhere else f"^({body})$"


def last_segment(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def suffix(path: Column | str) -> Column:
    """Lower-cased extension of the last segment; empty for ``.name`` and ``name.``."""
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^/.]+)$", 1))


def path_key(path: Column | str) -> Column:
    """Sort key that orders paths by their segments instead of by their text."""
    return F.translate(col(path), "/", "\x01")


def parent_dirs(path: Column | str) -> Column:
    """Every directory above a path, outermost first."""
    path = col(path)
    above = F.transform(F.sequence(F.lit(1), count_of(path, "/")), lambda n: F.call_function("substring_index", path, F.lit("/"), n))
    return F.when(contains(path, "/"), above).otherwise(F.array().cast("array<string>"))


def section_has(c: Column, low: Column, needle: str, *titles: str) -> Column:
    """Whether the section that ``section_slice`` gives holds a literal without line break; ``low`` is
    the text in lower case. Each position is looked up once and no section is copied. Null without one."""
    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def first(at: Column, rest: Column) -> Column:
        return let(at, lambda p: F.when(p > 0, p).otherwise(rest))

    def held(start: Column, found: Column) -> Column:
        return (found > 0) & ~contains(F.substr(c, start + 1, found - start - 1), "\n## ")

    start = F.lit(0)
    for title in reversed(titles):
        start = first(F.locate(title, low), start)
    return let(start, lambda s: F.when(s > 0, let(F.position(F.lit(needle), c, s), lambda f: held(s, f))))


def section_slice(c: Column, *titles: str) -> Column:
    """Text from the first heading that starts with one of the titles to the next ``## ``.

    Titles are tried in order, letter case is ignored. Null when none is there.
    """
    low = F.lower(c)
    start = F.lit(0)
    for title in reversed(titles):
        at = F.locate(title, low)
        start = F.when(at > 0, at).otherwise(start)
    rest = F.substr(c, start)
    stop = F.locate("\n## ", rest, 2)
    return F.when(start > 0, F.when(stop > 1, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest))
