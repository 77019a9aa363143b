"""Parameters of a mapping run: defaults, presets, option files and their checks."""

from __future__ import annotations

import os
import re
import shlex
from dataclasses import dataclass, field, fields, replace

import numpy as np

FORMATS = ("sam", "maf", "blast6", "paf")


@dataclass(frozen=True)
class Scoring:
    """Award of a match and costs, all positive: mismatch, gap open and extension, per-base costs of short gaps.

    ``gfa`` prices gaps that consume the reference, ``gfb`` those that consume the query; 0 turns them off. The model is
    linear when ``gi`` is 0, combined when both ``gfa`` and ``gfb`` are set, else affine. ``bonus`` changes single cells of
    the matrix: ``{"GA": 3}`` adds 3 where the reference has G and the query A.
    """

    match: int = 1
    mismatch: int = 1
    gi: int = 1
    ge: int = 1
    gfa: int = 0
    gfb: int = 0
    xdrop: int = 50
    bonus: tuple[tuple[str, int], ...] = ()

    @property
    def model(self) -> str:
        if self.gi == 0:
            return "linear"
        return "combined" if self.gfa and self.gfb else "affine"

    def matrix(self) -> np.ndarray:
        """Scores by reference and query code; code 4 (N) mismatches with all, itself included."""
        m = np.full((5, 5), -self.mismatch, np.int32)
        m[np.arange(4), np.arange(4)] = self.match
        for pair, add in self.bonus:
            m["ACGT".index(pair[0]), "ACGT".index(pair[1])] += add
        return m

    def check(self) -> None:
        if not 1 <= self.match <= 6:
            raise ValueError("match award must be 1 to 6")
        if not 1 <= self.mismatch <= 7:
            raise ValueError("mismatch cost must be 1 to 7")
        if self.gi < 0 or self.ge < 1:
            raise ValueError("gap open must be at least 0 and gap extension at least 1")
        if min(self.gfa, self.gfb) < 0 or (self.gfa and self.gfa < self.ge) or (self.gfb and self.gfb < self.ge):
            raise ValueError("short-gap costs must be 0 or at least the gap extension")
        if self.xdrop < 1:
            raise ValueError("X-drop must be positive")


@dataclass(frozen=True)
class MapParams:
    """All options of index building, mapping and output."""

    k: int = 15
    w: int = 0
    bucket_bits: int = 14
    frequencies: tuple[float, ...] = (0.05, 0.01, 0.001)
    circular: tuple[str, ...] = ()
    min_len: int = 1
    window: int = 7000
    gap: int = 7000
    scoring: Scoring = field(default_factory=Scoring)
    min_score: int = 50
    min_ratio: float = 0.3
    codec: str = "dna"
    mixing_hash: bool = False
    format: str = "sam"
    tags: tuple[str, ...] = ()
    read_group: str = ""
    keep_qual: bool = True
    omit_secondary: bool = False
    all_vs_all: bool = False
    base_rid: int = 0
    base_qid: int = 0

    def __post_init__(self) -> None:
        if not self.w:
            object.__setattr__(self, "w", int(2 / 3 * self.k + 0.499))
        self.check()

    def check(self) -> None:
        if not 2 <= self.k <= 31:
            raise ValueError("k must be 2 to 31")
        if not 2 <= self.w <= 31:
            raise ValueError("w must be 2 to 31")
        if not 1 <= len(self.frequencies) <= 7 or any(a < b for a, b in zip(self.frequencies[:-1], self.frequencies[1:], strict=True)):
            raise ValueError("one to seven descending frequencies are needed")
        if self.window < 1 or self.gap < 1:
            raise ValueError("window and gap must be positive")
        if self.min_len < 1 or self.min_score < 1 or not 0 <= self.min_ratio <= 1:
            raise ValueError("min_len and min_score must be positive, min_ratio 0 to 1")
        if self.format not in FORMATS:
            raise ValueError(f"unknown format {self.format!r}; known: {', '.join(FORMATS)}")
        if self.codec not in ("dna", "text2bit"):
            raise ValueError("codec must be dna or text2bit")
        self.scoring.check()

    @property
    def coefficient(self) -> float:
        """The award that stands for both score coefficients in length and quality estimates."""
        return float(self.scoring.match)


# The options that each preset stands for, and what the parts after it add.
_READS = {"1d": ("",), "1dsq": ("-b6 -r4,4",), "2d": ("-b6 -r4,4",)}
_CHEMISTRY = ("-a2", {**_READS, "1": ("", _READS)})
PRESETS: dict[str, tuple] = {
    "pacbio": ("-k15 -w10 -a2 -b4 -p4 -q2 -r3,3 -Y50 -s50 -m0.3", {"clr": ("",), "ccs": ("-b5 -p6 -p2",)}),
    "ont": (
        "-k15 -w10 -a3 -b5 -p6 -q2 -r3,3 -Y50 -s50 -m0.3",
        {
            "r7": ("-b4", {"1d": ("",), "2d": ("",)}),
            "r9": ("", {**_READS, "4": _CHEMISTRY, "5": _CHEMISTRY}),
            "1d": ("-a2",), "1dsq": ("-a2 -b6 -r4,4",), "2d": ("-a2 -b6 -r4,4",),
        },
    ),
    "ava": ("-k15 -w5 -a2 -b3 -p0 -q2 -Y50 -s30 -m0.05",),
}


def preset(name: str, base: MapParams | None = None) -> MapParams:
    """A preset by its path, with dots or colons between the parts; from a part that is unknown on, an option file."""
    params, level, at = base or MapParams(), PRESETS, 0
    for part in re.split("[.:]", name):
        if part not in level:
            if os.path.isfile(name[at:]):
                return load_options(name[at:], params)
            raise ValueError(f"unknown preset {name!r}")
        text, *below = level[part]
        params, level, at = parse_options(text, params), below[0] if below else {}, at + len(part) + 1
    return params


@dataclass(frozen=True)
class Command:
    """What a command line asks for: parameters, files in order, and where an index goes (option d)."""

    params: MapParams
    files: tuple[str, ...] = ()
    index_path: str = ""


_OPTIONS = {
    "k": ("k", int), "w": ("w", int), "B": ("bucket_bits", int), "L": ("min_len", int), "W": ("window", int), "G": ("gap", int),
    "s": ("min_score", int), "m": ("min_ratio", float), "O": ("format", str),
}
_FLAGS = {"X": {"all_vs_all": True}, "A": {}, "P": {"omit_secondary": True}, "Q": {"keep_qual": True}, "h": {}}
#: A and h change nothing. Options whose value may be left out, and those that only steer threads, buffers and logs: Spark's business here.
_OPTIONAL, _IGNORED = "cCv", "t12v"
_KNOWN = {*_OPTIONS, *_FLAGS, *_OPTIONAL, *_IGNORED, *"xfabepqrYTRd"}


def parse_command(text: str, base: MapParams | None = None) -> Command:
    """A command line without the program's name, or an option file; later options win.

    A value follows its letter, after an equals sign if one likes, or comes as the next word. Flags may share a dash,
    also with an option that takes a value, if it comes last. Words that belong to no option are files.
    """
    params, files, index_path, window_given = base or MapParams(), [], "", False
    words = shlex.split(text, comments=True)
    while words:
        word = words.pop(0)
        if not word.startswith("-") or len(word) < 2:
            files.append(word)
            continue
        rest = word[1:]
        while rest and rest[0] in _FLAGS:
            params, rest = replace(params, **_FLAGS[rest[0]]), rest[1:]
        if not rest:
            continue
        key, value = rest[0], rest[1:].removeprefix("=")
        if key not in _KNOWN:
            raise ValueError(f"unknown option -{key}")
        if not value and words and (not words[0].startswith("-") or words[0] == "-") and (key not in _OPTIONAL or _fits(key, words[0])):
            value = words.pop(0)
        if not value and key not in _OPTIONAL:
            raise ValueError(f"option -{key} needs a value")
        if key == "d":
            index_path = value
        elif key == "k":
            params = replace(params, k=int(value), **({} if window_given else {"w": 0}))
        elif key not in _IGNORED:
            window_given |= key in "wx"
            params = _with_option(params, key, value)
    return Command(params, tuple(files), index_path)


def _fits(key: str, word: str) -> bool:
    """Whether a word of its own is the value of an option that may have none: numbers for C and v, names for c."""
    return bool(re.fullmatch(r"[\d,;:/*]+", word)) if key in "Cv" else not os.path.exists(word)


def _with_option(params: MapParams, key: str, value: str) -> MapParams:
    scored = lambda **x: replace(params, scoring=replace(params.scoring, **x))
    if key in _OPTIONS:
        name, kind = _OPTIONS[key]
        return replace(params, **{name: kind(value)})
    if key == "x":
        return preset(value, params)
    if key == "f":
        return replace(params, frequencies=tuple(float(x) for x in value.split(",")))
    if key == "c":
        names = tuple(filter(None, re.split("[,;:/]", value)))
        return replace(params, circular=("*",) if not names or {"*", "-"} & set(names) else names)
    if key == "C":
        ids = [0 if x == "*" else int(x) for x in re.split("[,;:/]", value) if x]
        return replace(params, base_rid=ids[0] if ids else 0, base_qid=ids[min(1, len(ids) - 1)] if ids else 0)
    if key == "e":
        return scored(bonus=params.scoring.bonus + tuple((x[:2].upper(), int(x[2:])) for x in value.split(",")))
    if key == "r":
        a, _, b = value.partition(",")
        return scored(gfa=int(a), gfb=int(b or a))
    if key == "T":
        return replace(params, tags=tuple(value.split(",")))
    if key == "R":
        line = value.removeprefix("@RG").replace("\\t", "\t").strip()
        if not any(x.startswith("ID:") for x in line.split("\t")):
            raise ValueError("a read group needs an ID")
        return replace(params, read_group=line)
    return scored(**{{"a": "match", "b": "mismatch", "p": "gi", "q": "ge", "Y": "xdrop"}[key]: int(value)})


def parse_options(text: str, base: MapParams | None = None) -> MapParams:
    """The parameters of a command line or option file that names no files."""
    command = parse_command(text, base)
    if command.files:
        raise ValueError(f"not an option: {command.files[0]!r}")
    return command.params


def load_options(path: str, base: MapParams | None = None) -> MapParams:
    """An option file; file names in it are left aside."""
    with open(path) as f:
        return parse_command(f.read(), base).params


def describe(params: MapParams) -> str:
    """One line an option, for logs and help."""
    return "\n".join(f"{f.name} = {getattr(params, f.name)}" for f in fields(params))
