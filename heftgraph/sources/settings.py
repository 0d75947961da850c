"""Settings: configuration files, release files, build arguments, platforms, keys of builds."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from heftgraph.sources import platforms

#: Names of configuration and release files, in the order in which they are looked for.
CONFIG_NAMES = ("heftgraph.yaml", ".heftgraph.yaml", "heftgraph.yml", ".heftgraph.yml", "heftgraph.json")
RELEASE_NAMES = (".goreleaser.yaml", ".goreleaser.yml")
#: Platforms that are looked at when none are named.
DEFAULT_PLATFORMS = ("linux/amd64", "darwin/arm64", "windows/amd64")
#: Goes into every key, so that stored tables of another layout aren't found.
LAYOUT = "1"


def read_document(path: str) -> dict:
    """A YAML or JSON document; JSON needs no further library."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} isn't JSON, and no YAML library is installed") from e
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"{path} can't be read: {e}") from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no settings")
    return found


def find(folder: str, names: Sequence[str] = CONFIG_NAMES) -> str | None:
    return next((p for n in names if os.path.isfile(p := os.path.join(folder, n))), None)


def listed(value) -> list[str]:
    """A list of texts, of one text or of a list."""
    return [] if value is None else [str(value)] if not isinstance(value, list) else [str(v) for v in value]


def merged(*lists: Iterable[str]) -> list[str]:
    """The distinct entries of all lists, trimmed, in order of their first place; blanks go."""
    return list(dict.fromkeys(t for x in lists for v in x if (t := v.strip())))


def without_templates(text: str) -> str:
    """Template actions become '0'."""
    return re.sub(r"\{\{.*?\}\}", "0", text)


def split_arguments(text: str) -> list[str]:
    """Words of a command line; quotes of both kinds keep white space, and may stand within a word."""
    return ["".join(a or b or c for a, b, c in re.findall(r"'([^']*)(?:'|\Z)|\"([^\"]*)(?:\"|\Z)|([^\s'\"]+)", word)) for word in re.findall(r"(?:'[^']*(?:'|\Z)|\"[^\"]*(?:\"|\Z)|[^\s'\"])+", text)]


def build_tags(tags: Iterable[str]) -> list[str]:
    return [t for entry in tags for t in without_templates(entry).split()]


def environment(pairs: Iterable[str]) -> dict[str, str]:
    """Values by name of 'NAME=value' entries."""
    split = (p.partition("=") for p in pairs)
    return {k.strip(): without_templates(v) for k, eq, v in split if eq and k.strip()}


def build_arguments(flags: Iterable[str], linker: Iterable[str]) -> str:
    """Flags in one line, those of the linker as one quoted argument."""
    words = [w for f in flags for w in without_templates(f).split()]
    link = [w for f in linker for w in without_templates(f).split()]
    return " ".join(words + ([f'-ldflags="{" ".join(link)}"'] if link else []))


def build_target(folder: str, main: str) -> str:
    """The package to build, below the module's root."""
    folder, main = folder.strip(), main.strip()
    if not main or folder in ("", "."):
        return main or folder
    whole = posixpath.normpath(posixpath.join(folder, main))
    return f"./{whole}" if folder.startswith("./") else whole


def effective_tags(*tags: Iterable[str]) -> list[str]:
    return sorted(merged(*tags))


@dataclass(frozen=True)
class Cell:
    """One platform of a build, and how it is built there."""

    system: str
    arch: str
    tags: tuple[str, ...] = ()
    env: Mapping[str, str] = field(default_factory=dict)
    args: str = ""

    @property
    def label(self) -> str:
        return f"{self.system or 'host'}/{self.arch or 'host'}" + (f"+{','.join(effective_tags(self.tags))}" if effective_tags(self.tags) else "")

    @property
    def identity(self) -> tuple:
        return self.system, self.arch, tuple(effective_tags(self.tags)), tuple(sorted(self.env.items())), self.args


def build_key(commit: str, target: str, cell: Cell, tags: Iterable[str] = (), env: Mapping[str, str] | None = None, args: str = "", toolchain: str = "") -> str:
    """Hash of all that changes a build: equal builds have equal keys, whatever order tags and variables are given in."""
    flat = lambda e: "\0".join(f"{k}={v}" for k, v in sorted((e or {}).items()))
    parts = (LAYOUT, commit, target, cell.system, cell.arch, toolchain, ",".join(effective_tags(tags, cell.tags)), args, flat(env), cell.args, flat(cell.env))
    return hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts)).hexdigest()


@dataclass(frozen=True)
class Release:
    """The builds of a release file: distinct cells in order, and the package that the first build makes."""

    path: str
    cells: tuple[Cell, ...]
    target: str
    builds: int

    def host(self, system: str, arch: str) -> Cell:
        """The cell of a platform, or the first one."""
        return next((c for c in self.cells if (c.system, c.arch) == (system, arch)), self.cells[0])


def build_cells(build: Mapping) -> list[Cell]:
    """The cells of one build: its targets, or systems times architectures less what is ignored."""
    how = (tuple(build_tags(listed(build.get("tags")))), environment(listed(build.get("env"))), build_arguments(listed(build.get("flags")), listed(build.get("ldflags"))))
    if build.get("targets"):
        parts = [t.split("_") for t in listed(build["targets"])]
        return [Cell(p[0], p[1], *how) for p in parts if len(p) > 1 and p[0] and p[1]]
    rules = [(r.get("goos") or "", r.get("goarch") or "") for r in build.get("ignore") or []]
    every = [(s, a) for s in listed(build.get("goos")) or platforms.SYSTEMS for a in listed(build.get("goarch")) or platforms.ARCHITECTURES]
    return [Cell(s, a, *how) for s, a in every if not any(o in ("", s) and b in ("", a) for o, b in rules)]


def release(folder: str) -> Release:
    """The release file of a folder; an error where there is none, or it builds nothing."""
    path = find(folder, RELEASE_NAMES)
    if path is None:
        raise FileNotFoundError(f"no release file in {folder}")
    builds = read_document(path).get("builds") or []
    cells: dict[tuple, Cell] = {}
    for c in (c for b in builds for c in build_cells(b)):
        cells.setdefault(c.identity, c)
    if not cells:
        raise ValueError(f"{path} builds nothing")
    targets = [t for b in builds if (t := build_target(str(b.get("dir") or ""), str(b.get("main") or "")))]
    return Release(path, tuple(cells.values()), targets[0] if targets else "", len(builds))


def parse_cell(text: str) -> Cell:
    system, arch, tags = platforms.parse(text)
    return Cell(system, arch, tuple(tags))


@dataclass(frozen=True)
class Settings:
    """What a configuration file, a release file and the caller ask for together."""

    target: str = ""
    controlled: tuple[str, ...] = ()
    locked: tuple[str, ...] = ()
    unlock: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    env: Mapping[str, str] = field(default_factory=dict)
    args: str = ""
    cells: tuple[Cell, ...] = ()
    check: Mapping = field(default_factory=dict)


def load(folder: str, controlled: Iterable[str] = (), locked: Iterable[str] = (), unlock: Iterable[str] = (), cells: Iterable[str] = (), host: tuple[str, str] = ("", "")) -> Settings:
    """Settings of a folder.

    Policy lists of the file come before those given. Platforms: given ones, else those of the
    file's matrix, else a release file's (unless 'release: false'), else the default ones. A release
    file's build settings win over those of the configuration; its target counts if none is named.
    """
    path = find(folder)
    doc = read_document(path) if path else {}
    build = doc.get("build") or {}
    found = None
    if doc.get("release") is not False and find(folder, RELEASE_NAMES):
        found = release(folder)
    named = [parse_cell(c) for c in cells] or [parse_cell(c) for c in listed(doc.get("matrix"))] or (list(found.cells) if found else [parse_cell(c) for c in DEFAULT_PLATFORMS])
    own = found.host(*host) if found and not doc.get("matrix") else None
    env = build.get("env") or {}
    return Settings(
        target=str(doc.get("target") or (found.target if found else "")),
        controlled=tuple(merged(listed(doc.get("controlled")), controlled)),
        locked=tuple(merged(listed(doc.get("lock")), locked)),
        unlock=tuple(merged(listed(doc.get("unlock")), unlock)),
        tags=own.tags if own else tuple(listed(build.get("tags"))),
        env=own.env if own else env if isinstance(env, dict) else environment(listed(env)),
        args=own.args if own else str(build.get("args") or ""),
        cells=tuple(named),
        check=doc.get("check") or {},
    )
