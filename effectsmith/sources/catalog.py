"""The swept parameters of the detector study as a table, and the commands that are pinned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOW, HIGH = 0.5, 1.5  # bounds are the default times these, unless they are given

# Group, command (with its blank), default, unit suffix or "int", bounds where they are not the
# default times LOW and HIGH. Four numbers after "dyn " are one vector.
ELECTRODE = [
    ("/main/gun/setEnergy ", 382.0e-6, " eV", None),
    ("/main/electrode_param/setHeight ", 10.0, "", None),
    ("/main/electrode_param/setWidth ", 10.0, "", None),
    ("/main/electrode_param/setIsland ", 200.0, " um", None),
    ("/main/electrode_param/setIslandSpacing ", 50.0, " um", None),
]
DETECTOR = [
    ("/main/detector_param/setTopThickness ", 0.12, " um", None),
    ("/main/detector_param/setTopFilmThickness ", 0.075, " um", None),
    ("/main/detector_param/setBotThickness ", 1.0, " um", None),
    ("/main/detector_param/setLatticeDeg ", 45.0, "", None),
    ("/main/detector_param/setTopAbs ", 0.795, "", (0.795 * LOW, 1.0)),
    ("/main/detector_param/setTopVSound ", 3.582, "", None),
    ("/main/detector_param/setTopGap ", 191.0e-6, "", None),
    ("/main/detector_param/setTopQPLim ", 3.0, "int", (2.0, 5.0)),
    ("/main/detector_param/setTopPhLifetime ", 0.242, "", None),
    ("/main/detector_param/setTopPhLifetimeSlope ", 0.29, "", None),
    ("/main/detector_param/setTopPSpecProb ", 0.0, "", (0.0, 1.0)),
    ("/main/detector_param/setTopFilmAbs ", 0.745, "", (0.745 * LOW, 1.0)),
    ("/main/detector_param/setTopFilmVSound ", 2.444, "", None),
    ("/main/detector_param/setTopFilmGap ", 1.5384e-3, "", None),
    ("/main/detector_param/setTopFilmQPLim ", 3.0, "int", (2.0, 5.0)),
    ("/main/detector_param/setTopFilmPhLifetime ", 0.00417, "", None),
    ("/main/detector_param/setTopFilmPhLifetimeSlope ", 0.29, "", None),
    ("/main/detector_param/setTopFilmPSpecProb ", 0.0, "", (0.0, 1.0)),
    ("/main/detector_param/setBotAbs ", 0.736, "", (0.736 * LOW, 1.0)),
    ("/main/detector_param/setBotVSound ", 2.608, "", None),
    ("/main/detector_param/setBotGapThres ", 180e-6, "", None),
    ("/main/detector_param/setBotQPLim ", 2.0, "int", (2.0, 5.0)),
    ("/main/detector_param/setBotPhLifetime ", 5.1, "", None),
    ("/main/detector_param/setBotPSpecProb ", 0.0, "", (0.0, 1.0)),
    ("/main/detector_param/setWallAbs ", 0.2, "", (0.0, 0.5)),
    ("/main/detector_param/setWallPSpecProb ", 0.0, "", (0.0, 1.0)),
]
TRANSPORT = [("/g4cmp/clearance ", 1e-06, "e-6 mm", (1.0, 10.0)), ("/g4cmp/temperature ", 0.0, " K", (0.0, 0.2))]
CONFIG = [
    ("cubic ", 5.431, " Ang", None),
    ("stiffness 1 1 ", 165.6, " GPa", None),
    ("stiffness 1 2 ", 63.9, " GPa", None),
    ("stiffness 4 4 ", 79.5, " GPa", None),
    ("dyn ", [-42.9, -94.5, 52.4, 68.0], " GPa", None),
    ("scat ", 2.43e-42, "e-42 s3", (2.43 * LOW, 2.43 * HIGH)),
    ("decay ", 7.41e-56, "e-56 s4", (7.41 * LOW, 7.41 * HIGH)),
    ("decayTT ", 0.74, "", (0.74 * LOW, 1.0)),
    ("Debye ", 15.0, " THz", None),
    ("vsound ", 9000.0, " m/s", None),
    ("vtrans ", 5400.0, " m/s", None),
]
ODE = [
    ("f_01", 4.30e9, "", None),
    ("r", 25e-6, "", None),
    ("s", 0.05, "", (0.01, 0.1)),
    ("I_ph", 1.673 * 8.916e5, "", None),
    ("pt", 150.0, "", None),
    ("n_cooper", 4e6, "", None),
]
PINNED = {"/g4cmp/phononBounces ": "/g4cmp/phononBounces 1000", "/g4cmp/minEPhonons ": "/g4cmp/minEPhonons 0.000382 eV"}
RISKY = ("cubic ", "stiffness 1 1 ", "stiffness 1 2 ", "stiffness 4 4 ", "dyn ", "vsound ", "vtrans ")


def rows() -> list[tuple]:
    """(var_idx, grp_ord, name, command, elem, n_elem, default, lo, hi, suffix, is_int, target) in study order."""
    out = []
    groups = [(g, t) for part, t in ((ELECTRODE, "macro"), (DETECTOR, "macro"), (TRANSPORT, "macro"), (CONFIG, "config"), (ODE, "ode")) for g in part]
    for order, ((command, default, suffix, bounds), target) in enumerate(groups):
        values = default if isinstance(default, list) else [default]
        for elem, value in enumerate(values):
            lo, hi = bounds or sorted((value * LOW, value * HIGH))
            name = f"{command}_{elem + 1}" if len(values) > 1 else command
            out.append((len(out), order, name, command, elem, len(values), value, lo, hi, "" if suffix == "int" else suffix, suffix == "int", target))
    return out


SCHEMA = (
    "var_idx int, grp_ord int, name string, command string, elem int, n_elem int, default double, lo double, hi double,"
    " suffix string, is_int boolean, target string"
)


def catalog(spark: SparkSession, safe: bool = False) -> DataFrame:
    """The catalog; ``safe`` leaves the lattice-shape groups at their stock values."""
    frame = spark.createDataFrame(rows(), SCHEMA)
    return frame.filter(~F.col("command").isin(*RISKY)) if safe else frame
