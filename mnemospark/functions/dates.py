"""Relative dates in a text, annotated with the calendar dates they mean on a given day. All of it stays in the JVM.

A text is cut once at all relative expressions; each piece found is looked at by its words, and its meaning, if it has one, is
put after it. Durations (`for two years`) are a second pass over the result, as `for two months ago` holds one of either kind.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words from one on, and week days by their first three letters.
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

_COUNT = r"(?:an?|" + "|".join(NUMBERS) + r"|[0-9]+)"
_WEEKDAY = r"(?:mon|tue|wed|fri|sun)(?:day)?|tues|tuesday|weds|wednesday|thu(?:rs?)?|thursday|sat|saturday"
MOMENT = (
    r"(?iU)\b(?:yesterday|(?:last|yesterday) night|this morning|today|tonight|the other day|tomorrow"
    rf"|(?:last|this past|past)\s+(?:weekend|week|{_WEEKDAY})|(?:last|past|earlier this)\s+(?:month|year)"
    rf"|{_COUNT}\s+(?:weekend|day|week|month|year)s?\s+ago)\b"
)
DURATION = rf"(?iU)\b(?:for|since)\s+{_COUNT}\s+(?:day|week|month|year)s?\b"
#: Every match holds a word of each of these groups; texts without one are not searched by the large patterns.
MOMENT_WORDS = (("yesterday", "last", "past", "morning", "today", "tonight", "other", "tomorrow", "earlier", "ago"),)
DURATION_WORDS = (("for", "since"), ("day", "week", "month", "year"))
#: Letters that are equal to an ASCII letter when case is ignored, and that lower() leaves or makes two of.
_LIKE_ASCII = ("\u017f", "\u212a", "\u0130", "\u0131")
MARKS = {"paren": (" (", ")"), "tag": (" [= ", "]")}
#: The first day of the calendar, counted from 1970, and a count beyond any in it.
_FIRST_DAY, _MANY = -719_162, 10_000_000


def long_date(d: Column) -> Column:
    return F.date_format(d, "MMMM d, y")


def span(first: Column, last: Column) -> Column:
    """A range that names a shared month and year once."""
    begin = F.when(F.year(first) != F.year(last), long_date(first)).otherwise(F.date_format(first, "MMMM d"))
    same_month = F.trunc(first, "month") == F.trunc(last, "month")
    return F.concat(begin, F.lit(" to "), F.when(same_month, F.date_format(last, "d, y")).otherwise(long_date(last)))


def _days_before(d: Column, n: Column) -> Column:
    """The day n days before d; null before the calendar begins."""
    at = F.unix_date(d).cast("bigint") - n
    return F.when(n <= _MANY, F.when(at >= _FIRST_DAY, F.date_from_unix_date(at.cast("int"))))


def _week_day(d: Column, weeks: Column, day: int) -> Column:
    """Day (0 is Monday) of the ISO week so many weeks before d's."""
    return _days_before(d, F.when(weeks <= _MANY, weeks * 7) + F.weekday(d) - day)


def _weekend(d: Column, weeks: Column) -> Column:
    return span(_week_day(d, weeks, 5), _week_day(d, weeks, 6))


def _month(d: Column, n: Column) -> Column:
    at = F.when(n <= _MANY, F.year(d) * 12 + F.month(d) - 1 - n)
    return F.when(at >= 12, F.date_format(F.make_date(F.floor(at / 12).cast("int"), (at % 12 + 1).cast("int"), F.lit(1)), "MMMM y"))


def _year(d: Column, n: Column) -> Column:
    return (F.year(d).cast("bigint") - n).cast("string")


def _number(word: Column) -> Column:
    """A number of digits or a number word; null beyond 64 bits."""
    named = F.array_position(F.array(*map(F.lit, NUMBERS)), word)
    return F.when(word.isin("a", "an"), 1).when(named > 0, named).otherwise(word.try_cast("bigint"))


def _moment(found: Column, d: Column) -> Column:
    """What an expression of MOMENT means on day d."""
    words = F.split(F.lower(found), r"(?U)\s+")
    head, last, one = F.get(words, F.lit(0)), F.element_at(words, -1), F.lit(1).cast("bigint")
    n, unit = _number(head), F.regexp_replace(F.get(words, F.lit(1)), "s$", "")
    ago = (
        F.when(unit == "day", long_date(_days_before(d, n))).when(unit == "week", long_date(_days_before(d, F.when(n <= _MANY, n * 7))))
        .when(unit == "weekend", _weekend(d, n)).when(unit == "month", _month(d, n)).otherwise(_year(d, n))
    )
    back = F.pmod(F.weekday(d) - F.array_position(F.array(*map(F.lit, DAYS)), F.substring(last, 1, 3)), F.lit(7)) + 1
    return (
        F.when(last == "ago", ago)
        .when(last.isin("yesterday", "night"), long_date(F.date_sub(d, 1)))
        .when(last.isin("morning", "today", "tonight"), long_date(d))
        .when(last == "day", long_date(F.date_sub(d, 2)))
        .when(last == "tomorrow", long_date(F.date_add(d, 1)))
        .when(last == "weekend", _weekend(d, one))
        .when(last == "week", span(_week_day(d, one, 0), _week_day(d, one, 6)))
        .when(last == "month", _month(d, one))
        .when(last == "year", _year(d, one))
        .otherwise(long_date(F.date_sub(d, back.cast("int"))))
    )


def _duration(found: Column, d: Column) -> Column:
    """What an expression of DURATION means on day d; days and weeks mean nothing."""
    words = F.split(F.lower(found), r"(?U)\s+")
    n, unit = _number(F.get(words, F.lit(1))), F.regexp_replace(F.get(words, F.lit(2)), "s$", "")
    return F.concat(F.lit("since "), F.when(unit == "month", _month(d, n)).when(unit == "year", _year(d, n)))


def _may_match(text: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """Whether a text holds a word of every group, or a letter for which that can't be told so simply."""
    low = F.lower(text)
    either = lambda words, t: functools.reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in words])
    return functools.reduce(Column.__and__, [either(words, low) for words in groups]) | either(_LIKE_ASCII, text)


def _noted(text: Column, pattern: str, groups: tuple[tuple[str, ...], ...], meaning, day: Column, mark: str) -> Column:
    """The text with the meaning of each match of the pattern after it, where it has one."""
    left, right = MARKS[mark]
    note = lambda m: F.coalesce(F.concat(F.lit(left), meaning(m, day), F.lit(right)), F.lit(""))
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda part, m: F.concat(part, F.when(m.isNull(), "").otherwise(F.concat(m, note(m)))))
    return F.when(_may_match(text, groups), F.array_join(pieces, "")).otherwise(text)


def annotate_relative_dates(text: Column, day: Column, mark: str = "paren") -> Column:
    """The text with each relative date followed by what it means on the day (a date, or yyyy-MM-dd; empty or null: unchanged).

    Numbers are words up to twelve or ASCII digits; dates outside the calendar stay as they are.
    """
    if mark not in MARKS:
        raise ValueError(f"mark must be one of {', '.join(MARKS)}, not {mark!r}")
    at = day.try_cast("date")
    # arrays of one element bind a value to a name, so that no text is made twice
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    noted = bind(_noted(text, MOMENT, MOMENT_WORDS, _moment, at, mark), lambda t: _noted(t, DURATION, DURATION_WORDS, _duration, at, mark))
    return F.when(at.isNotNull(), noted).otherwise(text)
