"""Scalar text functions as Column expressions. Lengths are counted in characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

EMPTY = "cast(array() as array<string>)"


def trim_u(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, f"^[{P.BLANK}]+|[{P.BLANK}]+\\z", "")


def sanitize(c: Column) -> Column:
    """Without ANSI escapes and control characters other than tab, newline and carriage return."""
    return F.regexp_replace(F.regexp_replace(c, P.ANSI, ""), P.CONTROL, "")


def strip_wrappers(c: Column) -> Column:
    """Without blocks that a host puts into user text, and trimmed."""
    return trim_u(F.regexp_replace(c, rf"<({P.WRAPPER_TAGS})(?![A-Za-z0-9_])[^>]*>[\s\S]*?</\1>", ""))


def clip(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(0, most - 1)), F.lit("…")))


def non_empty_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n", -1), trim_u), lambda line: line != "")


def first_line(c: Column, most: int) -> Column:
    """The first of ``non_empty_lines``; what follows it is not looked at."""
    return clip(F.coalesce(F.regexp_extract(c, rf"([^{P.BLANK}](?:[^\n]*[^{P.BLANK}])?)", 1), F.lit("")), most)


def cjk_chars(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, P.CJK, ""))


def has_cjk(c: Column) -> Column:
    return c.rlike(P.CJK)


def estimate_tokens(c: Column) -> Column:
    """A token for each CJK character and for each four others."""
    return F.ceil((F.length(c) + 3 * cjk_chars(c)) / 4)


def clip_sentence(c: Column, most: int) -> Column:
    """Cut after the last end of a sentence in the first ``most`` characters if it lies past their middle."""
    window = F.substring(c, 1, most)
    last = lambda end: F.when(F.instr(window, end) > 0, most - len(end) - F.instr(F.reverse(window), end[::-1]) + 1).otherwise(-1)
    cut = F.greatest(*map(last, (". ", "。", "! ", "? ")))
    return F.when(F.length(c) <= most, c).when(cut > most / 2, F.substring(window, F.lit(1), cut + 1)).otherwise(clip(c, most))


def clip_tokens(c: Column, tokens: int) -> Column:
    """The longest beginning of at most ``tokens`` estimated tokens, and an ellipsis."""
    most = 4 * tokens
    step = lambda a, x: F.struct((a["cost"] + F.when(x.rlike(P.CJK), 4).otherwise(1)).alias("cost"), (a["n"] + (a["cost"] + F.when(x.rlike(P.CJK), 4).otherwise(1) <= most).cast("int")).alias("n"))
    fitting = F.aggregate(F.split(F.substring(c, 1, most), ""), F.struct(F.lit(0).alias("cost"), F.lit(0).alias("n")), step, lambda a: a["n"])
    cut = F.when(has_cjk(c), F.substring(c, F.lit(1), fitting)).otherwise(F.substring(c, 1, most))
    return F.when(F.length(c) + 3 * cjk_chars(c) <= most, c).otherwise(F.concat(cut, F.lit("…")))


def hash_id(c: Column) -> Column:
    """A stable id of 12 hex digits."""
    return F.substring(F.md5(c), 1, 12)


def search_tokens(c: Column) -> Column:
    """Terms of a text, repeats included: words and their parts, then pairs of CJK characters."""
    lower = F.lower(c)

    def terms(word: Column) -> Column:
        parts = F.filter(F.split(word, r"[.\-/_]+"), lambda p: (F.length(p) >= 2) & (p != word))
        return F.when(word.rlike(r"[.\-/_]"), F.concat(F.array(word), parts)).otherwise(F.array(word))

    def pairs(run: Column) -> Column:
        return F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))

    # words without the marks around them; most have no parts
    words = F.flatten(F.transform(F.regexp_extract_all(lower, F.lit(r"[a-z0-9_$][a-z0-9_$.\-/]*[a-z0-9_$]"), F.lit(0)), terms))
    return F.when(has_cjk(c), F.concat(words, F.flatten(F.transform(F.regexp_extract_all(lower, F.lit(f"{P.CJK}+"), F.lit(0)), pairs)))).otherwise(words)


def one_line(c: Column, most: int = 400) -> Column:
    return clip(trim_u(F.regexp_replace(c, f"[{P.BLANK}]+", " ")), most)


def stamp(c: Column) -> Column:
    """A timestamp to the minute; the session's time zone should be UTC."""
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def snippet(text: Column, at: Column, width: int = P.SNIPPET) -> Column:
    """``width`` characters around a place (from 0), on one line."""
    start = F.greatest(F.lit(0), at - width // 2).cast("int")
    body = trim_u(F.regexp_replace(F.substring(text, start + 1, F.lit(width)), f"[{P.BLANK}]+", " "))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + width < F.length(text), "…").otherwise(""))


def path_tokens(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({P.PATH_TOKEN})"), F.lit(1)), F.lower))


def _error_lines(c: Column) -> Column:
    return non_empty_lines(F.regexp_replace(c, P.EXIT_CODE, ""))


def error_line_of(c: Column) -> Column:
    """The first line that reads as an error; null if none does."""
    lines = F.filter(_error_lines(c), lambda x: F.regexp_replace(x, P.ZERO_COUNT, "").rlike(P.ERROR_LINE))
    return clip(F.get(lines, F.lit(0)), 200)


def error_line(c: Column) -> Column:
    return F.coalesce(error_line_of(c), clip(F.coalesce(F.get(_error_lines(c), F.lit(0)), F.lit("")), 200))


def short_tool_name(c: Column) -> Column:
    return F.substring_index(c, "__", -1)


def relativize(path: Column, cwd: str | None) -> Column:
    return F.when(path.startswith(f"{cwd}/"), F.substring(path, len(cwd) + 2, 1 << 30)).otherwise(path) if cwd else path


def is_work_path(path: Column) -> Column:
    """Not a background task's output and not the host's own file."""
    return ~path.rlike(P.TASK_OUTPUT) & ~path.rlike(P.HARNESS_PATH)


def compress_command(c: Column, most: int = 120) -> Column:
    """A command without a leading cd, assignments and trailing pagers, on one line."""
    for left_out in (P.LEADING_CD, P.LEADING_ASSIGNMENTS, P.TRAILING_PAGER):
        c = F.regexp_replace(c, left_out, "")
    return clip(trim_u(F.regexp_replace(c, f"[{P.BLANK}]+", " ")), most)


def path_of(arguments: Column) -> Column:
    return F.coalesce(*(arguments[k] for k in ("file_path", "notebook_path", "path")))


def tool_line(name: Column, arguments: Column, cwd: str | None = None, detail: bool = False) -> Column:
    """One line for a tool call: what a command is for, the path, or the first telling argument."""
    blanks = f"[{P.BLANK}]+"
    command = F.nullif(arguments["command"], F.lit(""))
    about = F.nullif(trim_u(F.regexp_replace(arguments["description"], blanks, " ")), F.lit(""))
    short = lambda n: compress_command(command, 400 if detail else n)
    told = F.coalesce(*(arguments[k] for k in ("pattern", "query", "url", "description", "prompt", "skill")))
    path = F.nullif(path_of(arguments), F.lit(""))
    return (
        F.when((name == "Bash") & command.isNotNull() & about.isNotNull(), F.concat(F.lit("Bash: "), clip(about, 100), F.lit(" — `"), short(60), F.lit("`")))
        .when((name == "Bash") & command.isNotNull(), F.concat(F.lit("Bash: "), short(120)))
        .when(path.isNotNull(), F.concat(name, F.lit(": "), relativize(path, cwd)))
        .when(F.nullif(told, F.lit("")).isNotNull(), F.concat(name, F.lit(": "), clip(F.regexp_replace(told, blanks, " "), 100)))
        .otherwise(name)
    )


def is_notification(role: Column, text: Column) -> Column:
    return (role == "user") & text.rlike(P.NOTIFICATION)


def notification_text(text: Column) -> Column:
    found = F.when(text.rlike(r"<summary>[\s\S]*?</summary>"), trim_u(F.regexp_extract(text, r"<summary>([\s\S]*?)</summary>", 1)))
    return F.concat(F.lit("task notification: "), clip(F.coalesce(found, F.lit("a background task finished")), 200))


def is_goal(line: Column) -> Column:
    """Whether a trimmed line says something to work on."""
    least = F.when(has_cjk(line), 3).otherwise(6)
    return (F.length(line) >= least) & (F.length(line) <= P.GOAL_CHARS) & ~line.rlike(P.NOISE_SHORT) & ~line.rlike(P.NON_GOAL)


def without_bullet(line: Column) -> Column:
    return trim_u(F.regexp_replace(line, P.BULLET, ""))


def one_turn(text: Column, tokens: int) -> Column:
    return F.regexp_replace(clip_tokens(text, tokens), "\n+", " ⏎ ")


def index_mark(index: Column) -> Column:
    return F.when(index.isNotNull(), F.concat(F.lit(" (#"), index.cast("string"), F.lit(")"))).otherwise("")
