"""Input files of simulation programs, as texts by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.sources.sinks import box_nm

# The programs' names for force fields and waters, and their settings.
GROMACS_FORCE_FIELDS = {"AMBER99SB-ILDN": "amber99sb-ildn", "CHARMM36": "charmm36-jul2021", "OPLS-AA": "oplsaa", "GROMOS96": "gromos96-53a6"}
AMBER_FORCE_FIELDS = {"FF14SB": "leaprc.protein.ff14SB", "FF19SB": "leaprc.protein.ff19SB", "GAFF2": "leaprc.gaff2", "GLYCAM06": "leaprc.GLYCAM_06j-1"}
AMBER_WATERS = {"TIP3P": ("leaprc.water.tip3p", "TIP3PBOX"), "TIP4P": ("leaprc.water.tip4pew", "TIP4PEWBOX"), "SPCE": ("leaprc.water.spce", "SPCEBOX")}
MINIMISE = {"integrator": "steep", "emtol": 1000.0, "emstep": 0.01}
FORCES = {"cutoff-scheme": "Verlet", "ns_type": "grid", "coulombtype": "PME", "rcoulomb": 1.0, "rvdw": 1.0, "pbc": "xyz"}
MESH = {"nstlist": 10, "pme_order": 4, "fourierspacing": 0.16}
WARM = {"tcoupl": "V-rescale", "tc-grps": "Protein Non-Protein", "tau_t": "0.1 0.1", "ref_t": "300 300"}
PRESS = {"pcoupl": "Parrinello-Rahman", "pcoupltype": "isotropic", "tau_p": 2.0, "ref_p": 1.0, "compressibility": "4.5e-5"}
FREE = {"pcoupl": "no"}
HELD = {"define": "-DPOSRES"}
OFTEN = dict.fromkeys(("nstxout", "nstvout", "nstenergy", "nstlog"), 500)
SELDOM = dict.fromkeys(("nstxout-compressed", "nstenergy", "nstlog"), 5000)
AMBER_MIN = {"imin": 1, "maxcyc": 5000, "ncyc": 2500, "ntb": 1, "ntp": 0, "cut": 10.0}
AMBER_RUN = {"imin": 0, "cut": 10.0, "ntc": 2, "ntf": 2, "temp0": 300.0, "ntt": 3, "gamma_ln": 2.0}
AMBER_START = {"irest": 0, "ntx": 1, "ntb": 1, "tempi": 0.0}
AMBER_CONTINUE = {"irest": 1, "ntx": 5, "ntb": 2, "ntr": 0, "ntp": 1, "taup": 2.0}
HYDROGEN_WARNING = "No hydrogen atoms found: add hydrogens before the simulation."


def _settings(title: str, *parts: dict) -> str:
    values = {k: v for part in parts for k, v in part.items()}
    return f"; {title}\n" + "".join(f"{k} = {v}\n" for k, v in values.items())


def _namelist(title: str, *parts: dict) -> str:
    values = {k: v for part in parts for k, v in part.items()}
    return f"{title}\n &cntrl\n" + "".join(f"  {k} = {v},\n" for k, v in values.items()) + " /\n"


def _restrained(weight: float) -> dict:
    return {"ntr": 1, "restraintmask": "'@CA'", "restraint_wt": weight}


def _written(every: int, restart: int) -> dict:
    return {"ntpr": every, "ntwx": every, "ntwr": restart}


def missing_hydrogens(system: DataFrame) -> DataFrame:
    """One row: whether no atom is a hydrogen, true for an empty system."""
    return system.agg((~F.coalesce(F.bool_or(F.upper(F.coalesce("element", F.lit(""))) == "H"), F.lit(False))).alias("missing"))


def _readme(program: str, force_field: str, commands: list[str], system: DataFrame) -> str:
    warned = ["WARNINGS:", f"  ! {HYDROGEN_WARNING}"] if missing_hydrogens(system).first()["missing"] else []
    steps = [f"  {n}. {c}" for n, c in enumerate(commands, 1)]
    return "\n".join([f"{program}, force field {force_field}", *warned, "COMMANDS (run in order):", *steps]) + "\n"


def gromacs_inputs(system: DataFrame, force_field: str = "AMBER99SB-ILDN", water: str = "tip3p", ensemble: str = "NPT", n_em: int = 50_000, n_equil: int = 100_000, n_prod: int = 5_000_000, dt: float = 0.002, box: tuple[float, float, float] | None = None) -> dict[str, str]:
    """Minimisation, two equilibrations, production and the commands. box (in Angstrom): else the atoms' extent and 2 nm.

    An unknown force field counts as the default one; an empty system has a box of 2 nm.
    """
    dynamics = lambda n: {"integrator": "md", "nsteps": n, "dt": dt}
    press = PRESS if ensemble.upper() == "NPT" else FREE
    field = GROMACS_FORCE_FIELDS.get(force_field, GROMACS_FORCE_FIELDS["AMBER99SB-ILDN"])
    sides = " ".join(f"{v:.3f}" for v in box_nm(system, box).first())
    commands = [f"gmx pdb2gmx -f structure.pdb -ff {field} -water {water} -o processed.gro", f"gmx editconf -f processed.gro -o boxed.gro -box {sides}", "gmx solvate -cp boxed.gro -cs spc216.gro -o solvated.gro -p topol.top"]
    for step, start, more in (("em", "solvated", ""), ("nvt", "em", " -r em.gro"), ("npt", "nvt", " -r nvt.gro -t nvt.cpt"), ("md", "npt", " -t npt.cpt")):
        commands += [f"gmx grompp -f {step}.mdp -c {start}.gro{more} -p topol.top -o {step}.tpr", f"gmx mdrun -deffnm {step}"]
    return {
        "em.mdp": _settings("minimisation", MINIMISE, {"nsteps": n_em}, FORCES, {"nstlist": 1}),
        "nvt.mdp": _settings("equilibration at constant volume", HELD, dynamics(n_equil), OFTEN, FORCES, MESH, WARM, FREE),
        "npt.mdp": _settings("equilibration at constant pressure", HELD, dynamics(n_equil), OFTEN, FORCES, MESH, WARM, PRESS),
        "md.mdp": _settings("production", dynamics(n_prod), SELDOM, FORCES, MESH, WARM, press, {"gen_vel": "no"}),
        "README.txt": _readme("GROMACS", force_field, commands, system),
    }


def amber_inputs(system: DataFrame, force_field: str = "FF14SB", water: str = "TIP3P") -> dict[str, str]:
    """Set-up script, minimisation, heating, equilibration, production and the commands; unknown names count as the defaults."""
    field = AMBER_FORCE_FIELDS.get(force_field, AMBER_FORCE_FIELDS["FF14SB"])
    source, shape = AMBER_WATERS.get(water.upper(), AMBER_WATERS["TIP3P"])
    script = [f"source {field}", f"source {source}", "mol = loadpdb structure.pdb", f"solvatebox mol {shape} 10.0", "addions mol Na+ 0", "addions mol Cl- 0", "saveamberparm mol system.prmtop system.inpcrd", "savepdb mol solvated.pdb", "quit"]
    commands, start = ["tleap -f tleap.in"], "system.inpcrd"
    for step in ("min", "heat", "equil", "prod"):
        commands.append(f"sander -O -i {step}.in -o {step}.out -p system.prmtop -c {start} -r {step}.rst" + ("" if step == "min" else f" -x {step}.nc"))
        start = f"{step}.rst"
    run = lambda n: {"nstlim": n, "dt": 0.002}
    return {
        "tleap.in": "\n".join(script) + "\n",
        "min.in": _namelist("minimisation", AMBER_MIN, _restrained(50.0)),
        "heat.in": _namelist("heating", AMBER_RUN, AMBER_START, _restrained(10.0), run(50_000), _written(500, 1000)),
        "equil.in": _namelist("equilibration", AMBER_RUN, AMBER_CONTINUE, run(100_000), _written(1000, 5000)),
        "prod.in": _namelist("production", AMBER_RUN, AMBER_CONTINUE, run(5_000_000), _written(5000, 10_000), {"ioutfm": 1}),
        "README.txt": _readme("AMBER", force_field, commands, system),
    }
