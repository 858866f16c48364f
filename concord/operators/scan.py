"""Scans of a text corpus: names, markers, release spellings, and what is under no declaration.

Files are (keys..., path, content), one row per file; a file is one text, so the rows
of one file are a bounded group. Patterns and name lists come from a register and are short.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.arrays import running_max, running_sum
from concord.functions.binding import let
from concord.functions.globs import glob_regex
from concord.functions.versions import version_key
from concord.operators.skew import lookup_join, spread_join

# How much of a line is shown; folders that are skipped; line ends.
SHOWN = 200
SKIPPED = ("node_modules", ".venv", "dist", "build", ".git")
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def _lines(files: DataFrame, keys: Sequence[str], text: str, hint: str) -> DataFrame:
    """Lines of the files that hold the hint at all."""
    held = files.where(F.col(text).rlike(hint))
    return held.select(*keys, F.posexplode(F.split(F.col(text), LINE_END)).alias("_at", "_line")).where(F.col("_line").rlike(hint))


def find_names(files: DataFrame, keys: Sequence[str], text: str, names: Sequence[str]) -> DataFrame:
    """Every whole-word occurrence of a name: keys, line number, name, line. Nothing is judged."""
    # (?U): a letter with an accent is part of a word.
    pattern = r"(?U)\b(" + "|".join(re.escape(n) for n in names) + r")\b"
    return _lines(files, keys, text, pattern).select(
        *keys, (F.col("_at") + 1).alias("line"), F.explode(F.regexp_extract_all("_line", F.lit(pattern), 1)).alias("name"), F.trim("_line").alias("shown")
    )


def at_risk(register: DataFrame, side: str, old_spelling: str) -> DataFrame:
    """Old names found in a renamed entry's notes that are registered for another concept.

    ``register`` is (concept, notes, rename_count, <side>); ``old_spelling`` is a pattern whose
    first group is the old spelling.
    """
    renamed = register.where(F.coalesce("rename_count", F.lit(0)) > 0)
    spelled = renamed.select("concept", F.col(side).alias("new"), F.explode(F.regexp_extract_all("notes", F.lit(old_spelling), 1)).alias("spelling"))
    old = spelled.withColumn("name", F.regexp_extract("spelling", r"^[^(\s]*", 0))
    held = register.where(F.col(side).isNotNull()).groupBy(F.col(side).alias("name")).agg(F.max("concept").alias("held_by"))
    return spread_join(old, held, ["name"], "inner").where("held_by <> concept")


# Fixed pattern of a marker: id, then an optional side, then an optional reason.
MARKER = r'unavailable\s+parity_id=([a-z0-9][a-z0-9-]*)(?:\s+side=(python|typescript))?(?:\s+own_reason="([^"]+)")?'


def find_markers(files: DataFrame, keys: Sequence[str], path: str, text: str) -> DataFrame:
    """Markers with their attributes; a side that is not written follows the file's suffix."""
    parts = F.split(path, "/")
    kept = files.where(~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED])))
    every = F.regexp_extract_all("_line", F.lit(MARKER), 0)
    rows = _lines(kept, [*keys, path], text, MARKER).select(*keys, path, (F.col("_at") + 1).alias("line"), F.explode(every).alias("_m"))
    side = F.nullif(F.regexp_extract("_m", MARKER, 2), F.lit(""))
    by_suffix = F.when(F.col(path).rlike(r"\.pyi?$"), "python").otherwise("typescript")
    return rows.select(
        *keys,
        path,
        "line",
        F.regexp_extract("_m", MARKER, 1).alias("parity_id"),
        F.coalesce(side, by_suffix).alias("side"),
        F.nullif(F.regexp_extract("_m", MARKER, 3), F.lit("")).alias("own_reason"),
    )


def unresolved(markers: DataFrame, ledger: DataFrame) -> DataFrame:
    """Markers whose id the ledger lacks."""
    return lookup_join(markers, ledger.select("parity_id").distinct(), ["parity_id"], "left_anti")


def closed_between(markers: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Markers resting on an entry that became complete on their side between two snapshots.

    Snapshots are (parity_id, side, status, terminal). Markers with their own reason and terminal
    entries are left out.
    """
    old = before.select("parity_id", "side", F.col("status").alias("_old"), "terminal")
    new = after.select("parity_id", "side", F.col("status").alias("_new"))
    joined = lookup_join(lookup_join(markers.where("own_reason IS NULL"), old, ["parity_id", "side"], "inner"), new, ["parity_id", "side"], "inner")
    was = F.coalesce(F.col("_old"), F.lit(""))
    return joined.where((was != "complete") & (F.col("_new") == "complete") & ~F.coalesce("terminal", F.lit(False))).drop("_old", "_new", "terminal")


# What may write a release: a chain of numbers, each parted from the next by one separator.
CHAIN = r"[vV]?\d+(?:(?:[._-]|,\s*)\d+)+"


@dataclass(frozen=True)
class Spelling:
    """The ways a release is written in running text: dotted or dashed with or without its patch and a leading v, underscored
    without patch, and as a tuple with it.

    ``inside`` finds them in a match of CHAIN. A number counts as a whole, and a dotted or dashed release has no further
    number of its kind on either side: that keeps package versions, longer numbers and dates out.
    """

    major: int
    minor: int
    patch: int

    def inside(self, chain: Column, before: Column) -> Column:
        """(skip, size) of each release in a chain; ``before`` is the character in front of it, empty at a text's begin."""
        numbers, marks = F.regexp_extract_all(chain, F.lit(r"\d+"), F.lit(0)), F.regexp_extract_all(chain, F.lit(r"[._-]|,\s*"), F.lit(0))
        lettered = chain.rlike("^[vV]").cast("int")
        parts = F.struct(numbers.alias("n"), marks.alias("m"), lettered.alias("v"), before.alias("b"))

        def judged(p: Column) -> Column:
            is_number = lambda i, n: F.coalesce(F.get(p["n"], i) == str(n), F.lit(False))
            mark = lambda i: F.coalesce(F.left(F.get(p["m"], i), F.lit(1)), F.lit(""))
            widths = F.transform(p["n"], lambda n, i: (F.length(n) + F.coalesce(F.length(F.get(p["m"], i)), F.lit(0))).cast("long"))

            def release(begin: Column, i: Column) -> Column:
                own = mark(i)
                pair = is_number(i, self.major) & is_number(i + 1, self.minor)
                third = (mark(i + 1) == own) & is_number(i + 2, self.patch)
                # What stands in front: the mark inside a chain, the character before it at its begin.
                front = F.when(i > 0, mark(i - 1)).when(p["v"] == 1, F.lit("v")).otherwise(p["b"])
                written = (
                    F.when(own.isin(".", "-") & (front != own) & (mark(i + 1) != own), F.lit(2))
                    .when(own.isin(".", "-") & (front != own) & third & (mark(i + 2) != own), F.lit(3))
                    .when(own == "_", F.lit(2))
                    .when((own == ",") & third, F.lit(3))
                )
                # The letter belongs to a dotted or dashed release that nothing of its kind, and no digit, stands before.
                letter = ((i == 0) & own.isin(".", "-") & (p["v"] == 1) & (p["b"] != own) & ~p["b"].rlike(r"\d")).cast("int")
                skip = begin + p["v"] - letter
                last = i + written - 1
                return F.when(pair & written.isNotNull(), F.struct(skip.alias("skip"), last.alias("last"), letter.alias("letter"), i.alias("first")))

            def sized(r: Column, begins: Column) -> Column:
                end = F.get(begins, r["last"]) + F.length(F.get(p["n"], r["last"])) + p["v"]
                return F.struct(r["skip"].cast("int").alias("skip"), (end - r["skip"]).cast("int").alias("size"))

            return let(
                running_sum(widths),
                lambda begins: F.transform(F.filter(F.transform(begins, release), lambda r: r.isNotNull()), lambda r: sized(r, begins)),
            )

        return let(parts, judged)


def spellings(major: int, minor: int, patch: int) -> Spelling:
    return Spelling(major, minor, patch)


def _feeds(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def placed(text: Column, pattern: Column | str | Spelling) -> Column:
    """Every match in a text as an array, in order: begin, stop (0-based, end exclusive), line, found, shown (its line, trimmed).

    Offsets and line numbers are running sums over the pieces between matches, worked out inside the row.
    """
    spelling = pattern if isinstance(pattern, Spelling) else None
    regex = F.lit(CHAIN) if spelling else F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.struct(F.split(text, regex, -1).alias("pieces"), F.regexp_extract_all(text, regex, F.lit(0)).alias("matches"), F.split(text, "\n").alias("lines"))

    def rows(f: Column) -> Column:
        pieces, matches = f["pieces"], f["matches"]
        widths = F.zip_with(pieces, matches, lambda a, m: (F.length(a) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
        feeds = F.zip_with(pieces, matches, lambda a, m: _feeds(a) + F.coalesce(_feeds(m), F.lit(0)))

        def one(begins: Column, lines: Column) -> Column:
            def row(m: Column, i: Column) -> Column:
                piece = F.get(pieces, i)
                begin, line = F.get(begins, i) + F.length(piece), F.get(lines, i) + _feeds(piece)
                if spelling is None:
                    return F.array(_occurrence(f, begin, m, line))
                before = F.when((F.length(piece) == 0) & (i > 0), F.lit("0")).otherwise(F.right(piece, F.lit(1)))

                def part(r: Column) -> Column:
                    head = F.left(m, r["skip"])
                    return _occurrence(f, begin + r["skip"], F.substring(m, r["skip"] + 1, r["size"]), line + _feeds(head))

                return F.transform(spelling.inside(m, before), part)

            return F.flatten(F.transform(matches, row))

        return let(running_sum(widths), lambda begins: let(running_sum(feeds), lambda lines: one(begins, lines)))

    return let(found, rows)


def _occurrence(f: Column, begin: Column, found: Column, line: Column) -> Column:
    return F.struct(
        begin.alias("begin"), (begin + F.length(found)).alias("stop"), (line + 1).alias("line"), found.alias("found"), _trimmed(F.get(f["lines"], line.cast("int"))).alias("shown")
    )


def _opened(df: DataFrame, keys: Sequence[str], found: Column) -> DataFrame:
    """A row for each element of ``found``. The outer form keeps Spark from working ``found`` out once more to drop empty arrays."""
    return df.select(*keys, F.explode_outer(found).alias("_o")).where("_o IS NOT NULL")


def occurrences(files: DataFrame, keys: Sequence[str], text: str, pattern: str | Column | Spelling) -> DataFrame:
    """Every match in a whole text: keys, begin, stop (0-based, end exclusive), line, found and shown, the line it begins on,
    trimmed and cut to SHOWN characters. A row stays apart from others of its key, and nothing is shuffled.
    """
    regex = F.lit(CHAIN) if isinstance(pattern, Spelling) else F.lit(pattern) if isinstance(pattern, str) else pattern
    held = files.where(F.rlike(F.col(text), regex))
    return _opened(held, keys, placed(F.col(text), pattern)).select(
        *keys, "_o.begin", "_o.stop", "_o.line", "_o.found", F.left("_o.shown", F.lit(SHOWN)).alias("shown")
    )


# How each form writes a release.
FORMS = {
    "full": "{0}.{1}.{2}", "line": "{0}.{1}", "dashed": "{0}-{1}-{2}", "dashed-line": "{0}-{1}", "underscored-line": "{0}_{1}",
    "tag": "v{0}.{1}.{2}", "directory": "V{0}-{1}-{2}", "tuple": "({0}, {1}, {2})",
}
# English number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_word(n: int) -> str:
    """A number below a hundred in words, larger ones in digits."""
    if n < len(UNITS):
        return UNITS[n]
    tens, unit = divmod(n, 10)
    return str(n) if n > 99 else TENS[tens - 2] + (f"-{UNITS[unit]}" if unit else "")


def expected_text(form: Column, found: Column, release: tuple[int, int, int], count: int | None = None) -> Column:
    """What a statement of this form should say, keeping the brackets the file does not write and its capital.

    ``count`` and ``count-word`` say how many releases are supported. A form that is none says so.
    """
    text = F.concat(F.lit("unknown form "), F.coalesce(form, F.lit("null")))
    for name, shape in FORMS.items():
        written = shape.format(*release)
        said = F.when(~found.startswith("("), F.lit(written[1:-1])).otherwise(F.lit(written)) if name == "tuple" else F.lit(written)
        text = F.when(form == name, said).otherwise(text)
    if count is not None:
        word = number_word(count)
        spoken = F.when(F.substring(found, 1, 1).rlike("[A-Z]"), F.lit(word[:1].upper() + word[1:])).otherwise(F.lit(word))
        text = F.when(form == "count", F.lit(str(count))).when(form == "count-word", spoken).otherwise(text)
    return text


def check_statements(files: DataFrame, keys: Sequence[str], text: str, declared: DataFrame, release: tuple[int, int, int], count: int | None = None) -> DataFrame:
    """Declared statements that are missing (wrong number of matches, no file) or stale, with the line of a stale one.

    ``declared`` is (keys..., pattern, occurrences, form); the pattern's first group is the release, or for the forms
    ``count`` and ``count-word`` the number ``count`` of supported releases.
    """
    joined = declared.join(files.select(*keys, F.col(text).alias("_t"), F.lit(True).alias("_file")), list(keys), "left")
    stated = F.zip_with(
        F.regexp_extract_all("_t", F.col("pattern"), F.lit(1)),
        placed(F.col("_t"), F.col("pattern")),
        lambda g, o: F.struct(
            g.alias("found"), (o["line"] + _feeds(F.call_function("substring_index", o["found"], g, F.lit(1)))).alias("line"), o["shown"].alias("shown"),
        ),
    )
    judged = joined.select(*keys, "occurrences", "form", "_file", stated.alias("_s"))
    right = F.col("_file").isNotNull() & (F.coalesce(F.size("_s"), F.lit(0)) == F.col("occurrences"))
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("found"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("shown")))
    told = judged.select(*keys, "form", right.alias("_right"), F.when(right, F.col("_s")).otherwise(nothing).alias("_s"))
    rows = _opened(told, [*keys, "form", "_right"], F.col("_s")).select(*keys, "form", "_right", "_o.*")
    expected = F.when(F.col("_right"), expected_text(F.col("form"), F.col("found"), release, count))
    told = rows.withColumn("expected", expected).where(~F.col("_right") | (F.col("found") != F.col("expected")))
    return told.select(*keys, F.when(F.col("_right"), "stale").otherwise("missing").alias("finding"), "line", "found", "expected", F.left("shown", F.lit(SHOWN)).alias("shown"))


def stranger_occurrences(
    files: DataFrame, keys: Sequence[str], path: str, text: str, pattern: str | Spelling, declared: DataFrame,
    accounted: Sequence[str] = (), ignored_lines: Sequence[str] = (),
) -> DataFrame:
    """Occurrences that lie in no declared span, in no accounted file and on no ignored line.

    The patterns declared for a file join it as one list. Spans and occurrences are sorted together by their begin; the
    farthest end of the spans begun so far tells whether an occurrence lies in one. Only strangers leave the row. Every text
    is searched whole, and ignored lines are told by the whole line; only what is shown of it is cut.
    """
    open_files = files
    for glob in accounted:
        open_files = open_files.where(~F.col(path).rlike(glob_regex(glob)))
    held = open_files.where(F.rlike(F.col(text), F.lit(CHAIN if isinstance(pattern, Spelling) else pattern)))
    patterns = declared.groupBy(*keys).agg(F.collect_set("pattern").alias("_patterns"))
    joined = held.select(*keys, F.col(text).alias("_t")).join(patterns, list(keys), "left")
    found = joined.withColumn("_found", placed(F.col("_t"), pattern))
    declared_here = F.coalesce("_patterns", F.array().cast("array<string>"))
    spanned = found.withColumn("_spans", F.flatten(F.transform(declared_here, lambda p: placed(F.col("_t"), p)))).drop("_t", "_patterns")

    def events(column: str, kind: int) -> Column:
        # A span at 0 comes before an occurrence that begins where it does.
        return F.transform(column, lambda o: F.struct(o["begin"].alias("begin"), F.lit(kind).alias("kind"), *[o[c].alias(c) for c in ("stop", "line", "found", "shown")]))

    ordered = spanned.withColumn("_events", F.array_sort(F.concat(events("_spans", 0), events("_found", 1)))).drop("_spans", "_found")
    # Bound once: an expression that a lambda names is worked out for each element.
    bare = let(
        F.col("_events"),
        lambda es: let(
            running_max(F.transform(es, lambda e: F.when(e["kind"] == 0, e["stop"]).otherwise(-1)), -1),
            lambda reach: F.filter(es, lambda e, i: (e["kind"] == 1) & (F.get(reach, i) < e["stop"])),
        ),
    )
    strangers = ordered.select(*keys, bare.alias("_bare"))
    if ignored_lines:
        ignored = F.array(*[F.lit(i) for i in ignored_lines])
        strangers = strangers.withColumn("_bare", F.filter("_bare", lambda e: ~F.exists(ignored, lambda i: F.rlike(e["shown"], i))))
    return _opened(strangers, keys, F.col("_bare")).select(
        *keys, "_o.begin", "_o.stop", "_o.line", "_o.found", F.left("_o.shown", F.lit(SHOWN)).alias("shown")
    )


def without_lagging(rows: DataFrame, lagging: DataFrame, project: str) -> DataFrame:
    """Projects that lag skip the statement check (not the search for strangers)."""
    return lookup_join(rows, lagging.select(project).distinct(), [project], "left_anti")


def missing_declared(declared: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declarations that name one file (no wildcard in the last key) and name none that exists."""
    concrete = declared.where(~F.col(keys[-1]).rlike(r"[*?]"))
    return concrete.join(files.select(*keys).distinct(), list(keys), "left_anti")


def stranger_summary(found: DataFrame, project: str, path: str) -> DataFrame:
    """Strangers per project and top folder."""
    return found.groupBy(project, F.substring_index(path, "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("occurrences"))


def supported(files: DataFrame, text: str, pattern: str) -> DataFrame:
    """Releases written in a file (first group of the pattern), distinct and in order."""
    written = files.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("version")).distinct()
    return written.withColumn("_k", version_key(F.col("version"))).orderBy("_k").drop("_k")


def supported_summary(releases: DataFrame) -> DataFrame:
    """Newest release and how many there are."""
    return releases.agg(F.max_by("version", version_key(F.col("version"))).alias("newest"), F.count(F.lit(1)).alias("releases"))
