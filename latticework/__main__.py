"""Command line: run one solver on one system and print a result row.

Exit codes: 0 done, 1 failed while running, 2 the command line can't be read,
3 the solver does not apply to the system, 4 no such device.
"""

from __future__ import annotations

import csv
import re
import statistics
import sys
import time
from dataclasses import dataclass, fields

import numpy as np

from . import errors
from .operators import layouts, solvers
from .operators.kernels import Grid
from .sources import generators, probe, results

VERSION = "0.2.0"
# The names of the execution models that share the arrow layout: their iterates have the same bits.
MODELS = ("serial", "openmp", "pthreads", "jthread", "mpi", "hybrid")
PROBLEMS = {"poisson": "", "dense_dd": "dd", "dense_spd": "spd"}


@dataclass
class Command:
    solver: str = "jacobi"
    backend: str = "serial"
    problem: str = "poisson"
    rhs: str = "rich"
    size: int = 63
    workers: int = 1
    threads_per_rank: int = 1
    pinning: str = "none"
    reduction: str = "deterministic"
    schedule: str = "static"
    mode: str = "solve"
    iterations: int = 100_000
    tolerance: float = 1e-8
    omega: float = 0.0
    blocks: int = 0
    check_interval: int = 1
    reps: int = 1
    seed: int = generators.SEED
    label: str = ""
    progress: bool = False
    header: bool = False
    list: bool = False
    topology: bool = False
    bandwidth: bool = False
    version: bool = False
    help: bool = False


FLAGS = {f"--{f.name.replace('_', '-')}": f for f in fields(Command)} | {"-h": next(f for f in fields(Command) if f.name == "help")}
BITS = {"workers": 31, "threads_per_rank": 31, "reps": 31, "seed": 64}  # other whole numbers have 63


def _number(flag: str, name: str, kind: str, text: str) -> int | float:
    """A value that is a number from its first character to its last, or a refusal."""
    if kind == "float":
        if not re.fullmatch(r"-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|-?(inf|infinity|nan)", text, re.I):
            raise errors.InvalidArgument(f"{flag} needs a number, and {text!r} is not one")
        return float(text)
    bits = BITS.get(name, 63)
    value = int(text) if re.fullmatch(r"-?[0-9]+", text) else None
    if value is None or not (0 if name == "seed" else -(1 << bits)) <= value < 1 << bits:
        raise errors.InvalidArgument(f"{flag} needs a whole number, and {text!r} is not one")
    return value


def parse(arguments: list[str]) -> Command:
    """Options of a command line; raises InvalidArgument for whatever it can't read."""
    command, rest = Command(), iter(arguments)
    for flag in rest:
        found = FLAGS.get(flag)
        if found is None:
            raise errors.InvalidArgument(f"unknown option {flag}")
        if found.type == "bool":
            setattr(command, found.name, True)
            continue
        text = next(rest, None)
        if text is None:
            raise errors.InvalidArgument(f"{flag} needs a value")
        setattr(command, found.name, text if found.type == "str" else _number(flag, found.name, found.type, text))
    if command.reps < 1:
        raise errors.InvalidArgument(f"--reps needs at least one repetition, and {command.reps} leaves no timings")
    return command


def inapplicable(command: Command) -> str:
    """Why the solver does not apply, or nothing."""
    if command.problem != "poisson" and solvers.find(command.solver).coloured:
        return "a dense system has no colouring"
    if command.problem == "dense_dd" and command.solver == "cg":
        return "the matrix is not symmetric"
    if command.backend == "relational" and command.problem != "poisson":
        return "the relational layout holds grids"
    return ""


def _systems(spark, command: Command):
    if command.problem == "poisson":
        rhs = generators.grid_rhs(command.size, "sine" if command.rhs == "sine" else "rich", command.seed)
        return spark.createDataFrame([("grid", command.size, rhs.tolist())], "system string, n int, b array<double>")
    a, b, _ = generators.dense_system(command.size, command.seed, PROBLEMS[command.problem])
    row = ("dense", command.size, b.tolist(), a.ravel().tolist(), command.blocks or 8, command.problem == "dense_spd")
    return spark.createDataFrame([row], "system string, n int, b array<double>, a array<double>, blocks int, spd boolean")


def measure(command: Command) -> dict:
    """Runs the repetitions and fills a row of the 36 columns."""
    from .session import session

    spark = session()
    systems = _systems(spark, command)
    fixed = command.mode == "fixed"
    options = solvers.Options(command.tolerance, command.iterations, "fixed" if fixed else "tolerance", command.check_interval, relaxation=command.omega)
    seconds = []
    with layouts.relayed():
        for _ in range(command.reps):
            began = time.perf_counter()
            done = solvers.solve(systems, [command.solver], options).drop("x", "history").first()
            seconds.append(time.perf_counter() - began)
    middle = sorted(seconds)[len(seconds) // 2]
    grid = command.problem == "poisson"
    unknowns, width = (command.size**2, 24.0) if grid else (command.size, 8.0 * command.size)
    updates = unknowns * done.iterations * done.sweeps
    relaxation = command.omega or (solvers.find(command.solver).omega(Grid(command.size, np.zeros(unknowns))) if grid and command.solver != "cg" else None)
    row = dict.fromkeys((c for c, _ in results.COLUMNS), None)
    row |= {c: getattr(command, c) for c in ("problem", "solver", "backend", "workers", "threads_per_rank", "pinning", "reduction", "schedule", "mode", "check_interval", "reps", "seed", "label")}
    row |= {
        "unknowns": unknowns, "ranks": 1, "iterations": done.iterations, "converged": int(done.converged), "stop_reason": done.reason,
        "relative_residual": done.error_estimate, "omega": relaxation, "blocks": command.blocks or (command.size if grid else 8),
        "seconds_median": middle, "seconds_min": min(seconds), "seconds_max": max(seconds), "updates_per_second": updates / middle,
        "gib_per_second": updates * width / middle / 2.0**30, "bytes_per_unknown": width, "sweeps": done.sweeps, "passes": done.passes,
        "pinning_status": "not applicable", "measured_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        "seconds_reps": ";".join(map(repr, seconds)), "kernels": "numpy", "kernel_variant": "arrow",
    }
    return row


def relational_row(command: Command) -> dict:
    """The same row from the cell table: fixed sweeps only, and no residual is measured."""
    from .session import session

    if command.mode != "fixed":
        raise errors.ConfigurationError("the relational layout runs fixed sweeps only")
    spark = session()
    n, rhs = command.size, generators.grid_rhs(command.size, "sine" if command.rhs == "sine" else "rich", command.seed)
    cells = spark.createDataFrame([(p // n + 1, p % n + 1, float(v)) for p, v in enumerate(rhs)], "i long, j long, b double")
    seconds = []
    with layouts.relayed():
        for _ in range(command.reps):
            began = time.perf_counter()
            layouts.find("relational")(cells, n, command.solver, command.iterations).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
    known = {"problem": "poisson", "unknowns": n * n, "solver": command.solver, "backend": "relational", "mode": "fixed", "iterations": command.iterations, "converged": 0, "stop_reason": "iteration_cap"}
    times = {"seconds_median": statistics.median_high(seconds), "seconds_min": min(seconds), "seconds_max": max(seconds), "reps": command.reps, "seconds_reps": ";".join(map(repr, seconds))}
    return dict.fromkeys((c for c, _ in results.COLUMNS), None) | known | times | {"seed": command.seed, "label": command.label, "kernel_variant": "relational"}


def main(arguments: list[str]) -> int:
    def refuse(code: int, *lines: object) -> int:
        for line in lines:
            print(f"latticework: {line}", file=sys.stderr)
        return code

    out = csv.writer(sys.stdout, lineterminator="\n")
    try:
        command = parse(arguments)
    except errors.InvalidArgument as error:
        return refuse(2, error, "try --help")
    if command.help:
        print(__doc__, *(f"  {flag}" for flag in FLAGS), sep="\n")
        return 0
    if command.version:
        print(f"latticework {VERSION}")
        return 0
    if command.header:
        out.writerow(c for c, _ in results.COLUMNS)
        return 0
    if command.list:
        print("solvers:", *solvers.SOLVERS)
        print("backends:", *MODELS, *layouts.LAYOUTS)
        return 0
    if command.topology:
        return refuse(4, "Spark places tasks; there is no topology to describe")
    if command.backend == "cuda":
        return refuse(4, "there is no CUDA layout")
    try:
        if command.bandwidth:
            from .session import session

            print(probe.stream_triad(session()))
            return 0
        if command.problem not in PROBLEMS:
            raise errors.ConfigurationError(f"unknown problem {command.problem!r}; known: {', '.join(PROBLEMS)}")
        if command.backend not in MODELS:
            layouts.find(command.backend)
        solvers.find(command.solver)
        why = inapplicable(command)
        if why:
            return refuse(3, f"solver {command.solver} does not apply to problem {command.problem}: {why}")
        row = relational_row(command) if command.backend == "relational" else measure(command)
    except errors.Error as error:
        return refuse(1, error)
    out.writerow("" if v is None else v for v in row.values())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
