"""Templates of the study's documents as tables of lines: a command a line of the catalog, and what is not swept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from effectsmith.plans.derived import QX, QY
from effectsmith.sources import catalog

#: Commands that the template holds only behind a number sign; rendering makes them live.
COMMENTED = ("PSpecProb ", "setSubstrateName ", "setSubstrateG4Name ")
#: Lattice keys that the configuration lacks; rendering appends them.
LACKING = ("decayTT ", "vtrans ")


def macro_lines() -> list[str]:
    """The macro: comments, commands with their defaults in catalog order, sites and events at the end."""
    places = [", ".join(f"{float(v):f}" for v in q) for q in (QX, QY)]
    lines = ["# verbosity as it is", "# /main/gun/setEnergy 1 MeV", "/main/gun/setGunType phonon", "", "/g4cmp/HitsFile none.txt"]
    lines += [f"#/main/detector_param/{c}none" for c in COMMENTED[1:]] + ["  /main/detector_param/setSubThickness 525"]
    lines += [f"{command}0" for command in catalog.PINNED]
    for command, default, suffix, _ in [*catalog.ELECTRODE, *catalog.DETECTOR, *catalog.TRANSPORT]:
        mark = "# " if command.endswith(COMMENTED) else ""
        lines.append(f"{mark}{command}{default}{'' if suffix == 'int' else suffix}")
    lines += ["", f"/main/electrode_param/setXLocations {places[0]}", f"/main/electrode_param/setYLocations {places[1]}", "# /run/beamOn 10", "/run/beamOn 1000000"]
    return lines


def config_lines() -> list[str]:
    """The lattice file, the longer of two keys first where one starts with the other."""
    lines = ["# lattice of the substrate"]
    for command, default, _, _ in sorted(catalog.CONFIG, key=lambda row: row[0], reverse=True):
        if command not in LACKING:
            lines.append(command + " ".join(map(str, default if isinstance(default, list) else [default])))
    return lines


def template(spark: SparkSession) -> DataFrame:
    """(doc, line_no, text) of ``macro`` and ``config``."""
    rows = [(doc, n, text) for doc, lines in (("macro", macro_lines()), ("config", config_lines())) for n, text in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "doc string, line_no int, text string")
