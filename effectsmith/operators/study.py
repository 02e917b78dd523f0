"""From a design to documents to the manifest: every sample's macro and lattice file, and what they say.

All samples have one template and the same commands, so which line a command replaces is found once, on the
template; the samples' values join it by command. Nothing is searched a sample.

``path_documents`` makes the documents of a design of trajectories row by row: a trajectory's steps and a document's
lines stand in arrays until the end, so neither values, commands nor lines are shuffled, written or spilled.
``rendered_documents`` takes commands of any kind as a table.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectsmith.functions.expressions import float_text
from effectsmith.functions.lineage import written
from effectsmith.operators import render
from effectsmith.operators.design import sample_name
from effectsmith.sources.catalog import PINNED

#: Trajectories of a task: some 7,000 samples with a million lines.
TASK_PATHS = 125
#: What the manifest reads from a macro.
MANIFEST_COMMANDS = {
    "x": "/main/electrode_param/setXLocations", "y": "/main/electrode_param/setYLocations", "gap": "/main/detector_param/setTopGap", "sub": "/main/detector_param/setSubThickness",
    "height": "/main/electrode_param/setHeight", "width": "/main/electrode_param/setWidth", "top": "/main/detector_param/setTopThickness", "beam": "/run/beamOn",
}


def swept_commands(design: DataFrame, catalog: DataFrame) -> DataFrame:
    """(sample_id, doc, command, new_line, ord) of every group of variables that goes to a document.

    ``design``: (sample_id, var_idx, value). Whole numbers are rounded half to even. Elements of a vector stand in
    order, with commas in macros but blanks between whole numbers and in lattice files, whose keys keep their blank.
    """
    named = catalog.filter("target <> 'ode'").select("var_idx", "grp_ord", "command", "elem", "suffix", "is_int", F.col("target").alias("doc"))
    rows = design.select("sample_id", "var_idx", "value").join(F.broadcast(named), "var_idx")  # a row a variable
    number = F.when(F.col("is_int"), F.rint("value").cast("int").cast("string")).otherwise(float_text(F.col("value")))
    items = F.array_sort(F.collect_list(F.struct("elem", number.alias("t"))))
    grouped = rows.groupBy("sample_id", "doc", "grp_ord", "command", "suffix", "is_int").agg(F.transform(items, lambda e: e["t"]).alias("items"))
    config = F.col("doc") == "config"
    vector = F.when(config | F.col("is_int"), F.array_join("items", " ")).otherwise(F.array_join("items", ","))
    text = F.concat("command", F.when(config, F.lit(" ")).otherwise(F.lit("")), vector, "suffix")
    return grouped.select("sample_id", "doc", "command", text.alias("new_line"), (F.col("grp_ord") + 100).alias("ord"))


def fixed_commands(samples: DataFrame, prefix: str, hits_folder: str, material: str = "Si") -> DataFrame:
    """(sample_id, doc, command, new_line, ord) of what is not swept: the sample's hits path, substrate and pinned
    limits; they come before the swept commands."""
    rows = [F.struct(F.lit(command).alias("command"), line.alias("new_line")) for command, line in _fixed(prefix, hits_folder, material)]
    each = samples.select("sample_id", F.lit("macro").alias("doc"), F.posexplode(F.array(*rows)).alias("ord", "c"))
    return each.select("sample_id", "doc", "c.command", "c.new_line", "ord")


def _fixed(prefix: str, hits_folder: str, material: str) -> list[tuple[str, Column]]:
    """Commands and lines of a macro that are not swept, in order."""
    name = sample_name(prefix, F.col("sample_id"))
    return [
        ("/g4cmp/HitsFile", F.concat(F.lit(f"/g4cmp/HitsFile {hits_folder}/"), name, F.lit("_hitsfile.txt"))),
        ("/main/detector_param/setSubstrateG4Name ", F.lit(f"/main/detector_param/setSubstrateG4Name G4_{material}")),
        ("/main/detector_param/setSubstrateName ", F.lit(f"/main/detector_param/setSubstrateName {material}")),
        *((command, F.lit(line)) for command, line in PINNED.items()),
    ]


def places(template: DataFrame, commands: DataFrame) -> DataFrame:
    """(doc, command, line_no) on the template. Macro commands may stand behind a number sign, and one without a line
    stops the job; lattice keys without a line get the next numbers behind the last, in command order."""
    asked = commands.groupBy("doc", "command").agg(F.min("ord").alias("ord")).withColumn("new_line", F.col("command"))
    macro = render.hits_of(template.filter("doc = 'macro'"), asked.filter("doc = 'macro'"), allow_commented=True)
    absent = render.stopping(macro, F.col("line_no").isNull(), F.concat(F.lit("required command is missing from the template: "), F.trim("command")))
    config = render.hits_of(template.filter("doc = 'config'"), asked.filter("doc = 'config'"), allow_commented=False)
    last = template.filter("doc = 'config'").agg(F.max("line_no").alias("last"))
    behind = F.row_number().over(Window.partitionBy("doc").orderBy("ord", "command"))  # a row a key of the catalog
    added = config.filter("line_no is null").join(last).withColumn("line_no", (F.coalesce("last", F.lit(0)) + behind).cast("int"))
    parts = [macro, absent, config.filter("line_no is not null"), added]
    out = parts[0].select("doc", "command", "line_no")
    for part in parts[1:]:
        out = out.unionByName(part.select("doc", "command", "line_no"))
    return out


def rendered_documents(template: DataFrame, commands: DataFrame) -> DataFrame:
    """(sample_id, doc, line_no, text): the documents of every sample. ``commands``: (sample_id, doc, command,
    new_line, ord); of several on one line the last in order wins. They are written once: places, samples and
    lines are all found from them. Places and template have a row a line of the template: they are the sides that are
    broadcast, never the samples' commands, which Parquet's compression lets the planner take for small."""
    commands = written(commands, "study-commands")
    at = places(template, commands)
    overrides = commands.join(F.broadcast(at), ["doc", "command"]).select("sample_id", "doc", "line_no", F.col("new_line").alias("text"), F.col("ord").alias("precedence"))
    added = at.join(template.select("doc", "line_no"), ["doc", "line_no"], "left_anti").select("doc", "line_no", F.lit(None).cast("string").alias("text")).distinct()
    return render.rendered(template.unionByName(added), overrides)


def path_documents(paths: DataFrame, catalog: DataFrame, template: DataFrame, prefix: str, hits_folder: str, material: str = "Si") -> DataFrame:
    """(sample_id, doc, lines, one column a variable of the recurrence): every sample's documents, ``lines`` an array of
    (line_no, text) in order. The same lines as ``rendered_documents`` of ``swept_commands`` and ``fixed_commands``.

    ``paths``: (traj, path) as from ``design.morris_paths`` of this catalog. A variable has two values a trajectory, so
    numbers are written out as text once a trajectory. The catalog is read to the driver; trajectories are so small
    that they are dealt to tasks by their number.
    """
    rows = catalog.orderBy("var_idx").select("var_idx", "name", "grp_ord", "command", "elem", "suffix", "is_int", "target").collect()
    whole = F.array(*[F.lit(bool(r["is_int"])) for r in rows])
    text = lambda v, i: F.when(F.get(whole, i), F.rint(v).cast("int").cast("string")).otherwise(float_text(v))
    words = F.transform("path", lambda p, i: F.struct(p["flip"].alias("flip"), text(p["before"], i).alias("before"), text(p["after"], i).alias("after")))
    dealt = paths.repartition(max(1, math.ceil(paths.select("traj").count() / TASK_PATHS)), "traj").withColumn("words", words)
    steps = dealt.withColumn("step", F.explode(F.sequence(F.lit(0), F.size("path")))).withColumn("sample_id", F.col("traj") * (len(rows) + 1) + F.col("step"))
    now = lambda c, i: F.when(F.col("step") < F.get(c, F.lit(i))["flip"], F.get(c, F.lit(i))["before"]).otherwise(F.get(c, F.lit(i))["after"])

    groups: dict = {}
    for i, r in enumerate(rows):
        if r["target"] != "ode":
            groups.setdefault((r["target"], r["grp_ord"], r["command"], r["suffix"], r["is_int"]), []).append((r["elem"], i))
    lines = [("macro", command, k, line) for k, (command, line) in enumerate(_fixed(prefix, hits_folder, material))]
    for (doc, order, command, suffix, is_int), own in groups.items():
        vector = F.concat_ws(" " if doc == "config" or is_int else ",", *[now("words", i) for _, i in sorted(own)])
        lines.append((doc, command, order + 100, F.concat(F.lit(command + (" " if doc == "config" else "")), vector, F.lit(suffix))))
    asked = catalog.sparkSession.createDataFrame([(doc, command, k, place) for place, (doc, command, k, _) in enumerate(lines)], "doc string, command string, ord int, place int")
    at = places(template, asked.select("doc", "command", "ord")).join(asked, ["doc", "command"])
    best = at.groupBy("doc", "line_no").agg(F.max_by("place", "ord").alias("place"))  # of several the last in order
    every = template.join(asked.select("doc").distinct(), "doc", "left_semi").join(best, ["doc", "line_no"], "full")
    slots = every.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "place"))).alias("slots"))  # a row a document

    ode = {r["name"]: now("path", i) for i, r in enumerate(rows) if r["target"] == "ode"}
    samples = steps.select("sample_id", F.array(*[line for *_, line in lines]).alias("new"), *[c.alias(name) for name, c in ode.items()])
    line = lambda s: F.struct(s["line_no"].alias("line_no"), F.coalesce(F.get("new", s["place"]), s["text"]).alias("text"))
    return samples.crossJoin(F.broadcast(slots)).select("sample_id", "doc", F.transform("slots", line).alias("lines"), *ode)


def document_values(documents: DataFrame, commands: dict[str, str]) -> DataFrame:
    """``documents`` with a column for each name instead of ``lines``, an array of (line_no, text) in order: the text behind
    the first line that starts with its command, trimmed, null where there is none. Nothing is grouped."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    begins = lambda t: reduce(lambda a, c: a | t.startswith(c), commands.values(), F.lit(False))
    # few lines may begin with a command: only those are trimmed as a whole
    begun = F.filter(F.transform("lines", lambda x: F.ltrim(x["text"], F.lit(" \t\n\x0b\f\r"))), begins)
    found = documents.withColumn("begun", F.transform(begun, trimmed))
    first = lambda c: F.get(F.filter("begun", lambda t: t.startswith(c)), F.lit(0))
    value = lambda c: trimmed(F.regexp_replace(first(c), f"^{re.escape(c)}", ""))
    # as rows of a generator the values are computed once, however often later filters name them
    values = F.inline(F.array(F.struct(*[value(c).alias(n) for n, c in commands.items()])))
    return found.select(*[c for c in documents.columns if c != "lines"], values)


def manifest(documents: DataFrame, prefix: str, hits_folder: str, strict: bool = True) -> DataFrame:
    """Manifest records read back from the samples' macros. ``documents``: (sample_id, doc, lines, ...) as from
    ``path_documents``; their other columns, the recurrence's inputs, are kept."""
    kept = [c for c in documents.columns if c not in ("sample_id", "doc", "lines")]
    found = document_values(documents.filter("doc = 'macro'").withColumnsRenamed({c: f"own_{c}" for c in kept}), MANIFEST_COMMANDS)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    name = sample_name(prefix, F.col("sample_id"))
    records = found.select(
        "sample_id", name.alias("sample_name"), F.concat(F.lit(f"{hits_folder}/"), name, F.lit("_hitsfile.txt")).alias("hits_file"), number("gap"),
        render.number_list(F.col("x")).alias("qx"), render.number_list(F.col("y")).alias("qy"), render.chip_z(F.col("sub").try_cast("double")).alias("chip_z"),
        number("height"), number("width"), render.first_number(F.col("top")).alias("thickness"), F.col("beam").try_cast("double").alias("n_sim"),
        *[F.col(f"own_{c}").alias(c) for c in kept],
    )
    return render.checked_manifest(records, strict)
