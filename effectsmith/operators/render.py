"""Documents as tables of lines: rendering values, replacing lines, reading values back.

lines: (doc, line_no, text), line_no from 1. commands: (doc, command, new_line). A command matches a line
that, without leading blanks, starts with it and goes on with white space or ends.

Lines and commands meet by an equi-join: a line emits its beginnings in the lengths that the commands of its
document have, so what is joined is (document, beginning), however many commands a document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectsmith.functions.expressions import float_text

BLANK = r"^[\s]"


def command_text(command: Column, value: Column, suffix: Column | None = None) -> Column:
    """``command`` and the number as text, with a unit suffix if there is one."""
    return F.concat(command, float_text(value), F.coalesce(suffix, F.lit("")) if suffix is not None else F.lit(""))


def int_command_text(command: Column, value: Column) -> Column:
    return F.concat(command, F.rint(value).cast("int").cast("string"))


def config_entry(key: Column, value: Column, suffix: Column) -> Column:
    """``key value[suffix]``; a blank at the end of the key stays, so there are two."""
    return F.concat(key, F.lit(" "), float_text(value), F.coalesce(suffix, F.lit("")))


def vector_commands(values: DataFrame, separator: str) -> DataFrame:
    """(sample_id, command, text): elements of each vector in order. ``values``: (sample_id, command, elem, value)."""
    items = F.array_sort(F.collect_list(F.struct("elem", float_text(F.col("value")).alias("t"))))
    return values.groupBy("sample_id", "command").agg(F.concat(F.col("command"), F.array_join(F.transform(items, lambda e: e["t"]), separator)).alias("text"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+", "")


def prefix_pairs(lines: DataFrame, commands: DataFrame, text: str, whole_words: bool) -> DataFrame:
    """Columns of ``lines`` with each ``command`` of the document that ``text`` starts with; with ``whole_words`` only
    where white space or the end follows. ``commands``: (doc, command), distinct. Null texts match nothing."""
    lengths = commands.groupBy("doc").agg(F.collect_set(F.length("command")).alias("lengths"))
    begun = lines.join(lengths, "doc").withColumn("n", F.explode("lengths")).drop("lengths").filter(F.col("n") <= F.length(text))
    if whole_words:
        begun = begun.filter((F.col("n") == F.length(text)) | F.substring(text, F.col("n") + 1, F.lit(1)).rlike(BLANK))
    keyed = begun.withColumn("command", F.substring(text, F.lit(1), F.col("n"))).drop("n")
    return keyed.join(commands, ["doc", "command"])


def hits_of(lines: DataFrame, commands: DataFrame, allow_commented: bool) -> DataFrame:
    """(doc, command, new_line, ord, line_no): the line each command replaces; line_no is null if there is none.
    ``ord`` is the commands' own column of that name, their call order, or else the command.

    The first uncommented match wins, else the first commented one. White space around a command is no part of it.
    """
    bare = F.when(F.col("commented"), _stripped(F.expr("substring(stripped, 2)"))).otherwise(F.col("stripped"))
    prepared = lines.withColumn("stripped", _stripped(F.col("text"))).withColumn("commented", F.col("stripped").startswith("#")).withColumn("bare", bare)
    if not allow_commented:
        prepared = prepared.filter(~F.col("commented"))
    order = F.col("ord") if "ord" in commands.columns else F.col("command")
    keyed = commands.select("doc", "command", "new_line", order.alias("ord"), F.regexp_replace("command", r"^\s+|\s+$", "").alias("key"))
    keys = keyed.select("doc", F.col("key").alias("command")).distinct()
    pairs = prefix_pairs(prepared.select("doc", "line_no", "commented", "bare"), keys, "bare", whole_words=True)
    best = pairs.groupBy("doc", F.col("command").alias("key")).agg(F.min(F.struct("commented", "line_no")).alias("best"))
    return keyed.join(best, ["doc", "key"], "left").select("doc", "command", "new_line", "ord", F.col("best.line_no").alias("line_no"))


def stopping(rows: DataFrame, bad: Column, message: Column) -> DataFrame:
    """No rows, but the job fails with the message of any row that is ``bad``: the check is one filter expression,
    which no column pruning takes away and whose message is not made before the row is known to be bad. To be
    united with the rows that are to be guarded."""
    return rows.filter(F.assert_true(~bad, message).isNotNull())


def replaced_first(lines: DataFrame, commands: DataFrame, allow_commented: bool = False, append_if_missing: bool = False, required: bool = False) -> DataFrame:
    """Lines with each command's first match replaced; missing commands are appended in command order, or, if
    required, stop the job with their name.

    Of several commands on one line the last in command order wins, as if applied one after another.
    """
    found = hits_of(lines, commands, allow_commented)
    new = found.filter("line_no is not null").groupBy("doc", "line_no").agg(F.max_by("new_line", "ord").alias("new_line"))
    out = lines.join(new, ["doc", "line_no"], "left").select("doc", "line_no", F.coalesce("new_line", "text").alias("text"))
    if required and not append_if_missing:
        absent = stopping(found, F.col("line_no").isNull(), F.concat(F.lit("required command is missing from "), F.col("doc").cast("string"), F.lit(": "), F.trim("command")))
        out = out.unionByName(absent.select("doc", "line_no", F.col("new_line").alias("text")))
    if append_if_missing:
        last = lines.groupBy("doc").agg(F.max("line_no").alias("last"))
        w = Window.partitionBy("doc").orderBy("ord", "command")
        missing = found.filter("line_no is null").join(last, "doc").withColumn("k", F.row_number().over(w))
        out = out.unionByName(missing.select("doc", (F.col("last") + F.col("k")).cast("int").alias("line_no"), F.col("new_line").alias("text")))
    return out


def missing_commands(lines: DataFrame, commands: DataFrame, allow_commented: bool = False) -> DataFrame:
    """Required commands without a line: what a strict rendering rejects."""
    return hits_of(lines, commands, allow_commented).filter("line_no is null").select("doc", "command")


def replaced_all(lines: DataFrame, commands: DataFrame) -> DataFrame:
    """Lines with every line that starts with the command's text replaced; no word boundary, no stripping."""
    pairs = prefix_pairs(lines.select("doc", "line_no", "text"), commands.select("doc", "command", "new_line"), "text", whole_words=False)
    new = pairs.groupBy("doc", "line_no").agg(F.max_by("new_line", "command").alias("new_line"))
    return lines.join(new, ["doc", "line_no"], "left").select("doc", "line_no", F.coalesce("new_line", "text").alias("text"))


def first_lines(lines: DataFrame, commands: DataFrame) -> DataFrame:
    """(doc, command, line_no, line): the first line that starts with each command, white space around it trimmed;
    commands without a line are not there."""
    asked = commands.select("doc", "command").distinct()
    stripped = lines.select("doc", "line_no", F.regexp_replace("text", r"^\s+|\s+$", "").alias("line"))
    # only line numbers meet the commands; the lines that were found are fetched by their numbers
    pairs = prefix_pairs(stripped, asked, "line", whole_words=False).select("doc", "command", "line_no")
    first = pairs.groupBy("doc", "command").agg(F.min("line_no").alias("line_no"))
    return first.join(stripped, ["doc", "line_no"]).select("doc", "command", "line_no", "line")


def rendered(template: DataFrame, overrides: DataFrame) -> DataFrame:
    """(sample_id, line_no, text): the template of each sample with its overridden lines.

    ``template``: (doc, line_no, text); ``overrides``: (sample_id, doc, line_no, text, precedence).
    """
    samples = overrides.select("sample_id", "doc").distinct()
    best = overrides.groupBy("sample_id", "doc", "line_no").agg(F.max_by("text", "precedence").alias("new_text"))
    every = samples.join(F.broadcast(template), "doc")  # a row a line of the template
    return every.join(best.hint("merge"), ["sample_id", "doc", "line_no"], "left").select("sample_id", "doc", "line_no", F.coalesce("new_text", "text").alias("text"))


def command_values(lines: DataFrame, commands: DataFrame) -> DataFrame:
    """(doc, command, value): text behind the first line that starts with the command, trimmed; ``<missing>``."""
    value = F.regexp_replace(F.expr("substring(line, length(command) + 1)"), r"^\s+|\s+$", "")
    found = commands.select("doc", "command").distinct().join(first_lines(lines, commands), ["doc", "command"], "left")
    return found.select("doc", "command", F.coalesce(value, F.lit("<missing>")).alias("value"))


def number_list(text: Column) -> Column:
    """Comma-separated doubles, blanks trimmed, empty parts dropped."""
    return F.transform(F.filter(F.split(text, ","), lambda t: F.trim(t) != ""), lambda t: F.trim(t).cast("double"))


def first_number(text: Column) -> Column:
    """First word as a double: the unit is dropped; null if it is no number."""
    return F.split(F.trim(text), r"\s+")[0].try_cast("double")


def chip_z(thickness_um: Column) -> Column:
    return thickness_um * F.lit(1e-6) / F.lit(2.0)


def checked_manifest(records: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``problem``: missing value, sites of different length, or no site; null if the record is fine. With
    ``strict`` the first record with a problem stops the job with its sample and problem."""
    problem = (
        F.when(F.col("gap").isNull() | F.col("chip_z").isNull(), "missing command")
        .when(F.col("qx").isNull() | F.col("qy").isNull(), "missing command")
        .when(F.size("qx") != F.size("qy"), "site lengths differ")
        .when(F.size("qx") == 0, "no site")
    )
    checked = records.withColumn("problem", problem)
    if strict:
        return checked.filter(F.assert_true(F.col("problem").isNull(), F.concat(F.col("sample_name"), F.lit(": "), F.col("problem"))).isNull())
    return checked


def checked_settings(settings: DataFrame) -> DataFrame:
    """Adds ``valid``: known log mode and a fraction from 0 to 1."""
    return settings.withColumn("valid", F.col("log_mode").isin("failures", "full", "none", "random") & F.col("log_fraction").between(0, 1))
