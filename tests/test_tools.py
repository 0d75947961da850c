"""A small project from its artifacts: tools, command line, settings, snapshots."""

import json

import pytest

from heftgraph import cli, tools
from heftgraph.analysis import Analysis, matrix
from heftgraph.operators import texts
from heftgraph.operators.policy import Policy
from heftgraph.plans import executables as made
from heftgraph.sources import settings, snapshots

POLICY = Policy(("home.org/lib",))
#: package: (module, name, imports, bytes of code)
PROJECT = {
    "home.org/app/cmd": ("home.org/app", "main", ["home.org/lib", "fmt"], 0),
    "home.org/lib": ("home.org/lib", "lib", ["big.org/x", "mid.org/y", "fmt"], 160),
    "big.org/x": ("big.org/x", "x", ["big.org/x/deep", "both.org/z"], 320),
    "big.org/x/deep": ("big.org/x", "deep", [], 640),
    "mid.org/y": ("mid.org/y", "y", ["both.org/z"], 1600),
    "both.org/z": ("both.org/z", "z", ["fmt"], 3200),
    "fmt": ("", "fmt", [], 800),
}
VERSIONS = {"home.org/app": "1.26", "home.org/lib": "1.22", "big.org/x": "1.25.1", "mid.org/y": "1.24.0", "both.org/z": "1.20"}


def listing(project):
    out = ""
    for pkg, (module, name, imports, _) in project.items():
        row = {"ImportPath": pkg, "Name": name, "Imports": imports}
        if module:
            row["Module"] = {"Path": module, "Version": "v1.0.0", "Main": module == "home.org/app", "Indirect": module == "both.org/z", "GoVersion": VERSIONS[module]}
        out += json.dumps(row, indent=2) + "\n"
    return out


def binary(project):
    symbols, at = [], 0
    for pkg, (_, _, _, size) in project.items():
        for _ in range(size // 16):
            symbols.append((f"{pkg}.F{at}", 1, at))
            at += 16
    symbols += [(f"main.v{k}", 2, 8 * k) for k in range(200)]
    return made.elf([(".text", at, True, b""), (".data", 1600, True, b""), (".bss", 64, False, b""), (".gopclntab", 1000, True, b"")], symbols)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "app").write_bytes(binary(PROJECT))
    (root / "listing.json").write_text(listing(PROJECT))
    smaller = {k: v for k, v in PROJECT.items() if k != "mid.org/y"} | {"home.org/lib": ("home.org/lib", "lib", ["big.org/x", "fmt"], 320)}
    (root / "app-before").write_bytes(binary(smaller))
    (root / "before.json").write_text(listing(smaller))
    (root / "src/cmd").mkdir(parents=True)
    (root / "src/cmd/main.go").write_text('package main\n\nimport "home.org/lib"\nimport x "big.org/x"\n\nfunc main() { lib.Run(); x.Go() }\n')
    (root / "heftgraph.json").write_text(json.dumps({"controlled": ["home.org/lib"], "check": {"max-binary-size": "5 kB", "max-go-version": "1.25.1", "deny": ["mid.org/..."], "max-module-size": {"both.org/z": "3 kB"}}}))
    return root


@pytest.fixture(scope="module")
def project(spark, folder):
    return Analysis.of(spark, str(folder / "app"), str(folder / "listing.json"), POLICY, sources=str(folder / "src"))


def test_sizes(project):
    x = tools.anatomy(project)
    code = 6720
    share = lambda n: n + 1000 * n // code
    assert (x["code_size"], x["data_size"], x["pclntab_size"], x["std_size"], x["main_size"]) == (code, 1600, 1000, share(800) + 1600, 0)
    assert [(m["module"], m["size"], m["direct"]) for m in x["modules"]["rows"]] == [("both.org/z", share(3200), False), ("mid.org/y", share(1600), True), ("big.org/x", share(320) + share(640), True), ("home.org/lib", share(160), True)]
    assert {s["name"] for s in x["sections"]["rows"]} >= {".text", ".data", ".gopclntab"} and x["main_module"] == "home.org/app"
    assert "big.org/x" in texts.anatomy(x) and "| both.org/z |" in texts.anatomy(x, True)


def test_targets(project):
    x = tools.size_targets(project)
    share = lambda n: n + 1000 * n // 6720
    rows = {r["module"]: r for r in x["candidates"]["rows"]}
    assert set(rows) == {"big.org/x", "mid.org/y"}
    assert rows["big.org/x"]["freed_bytes"] == share(320) + share(640) and rows["mid.org/y"]["freed_bytes"] == share(1600)
    assert rows["mid.org/y"]["potential_bytes"] == share(1600) + share(3200)
    assert (rows["big.org/x"]["import_sites"], rows["big.org/x"]["effort"]) == (1, "quickWin")
    assert [s["module"] for s in x["plan"]["rows"]] == ["mid.org/y", "big.org/x"]
    assert x["plan"]["rows"][1]["cumulative"] == share(320) + share(640) + share(1600) + share(3200)
    assert "easiest mid.org/y" in texts.prune(x)


def test_floor_and_cuts(project):
    x = tools.go_floor(project)
    assert (x["version"], x["critical"], x["next_version"], x["owned_max"]) == ("1.25.1", "big.org/x", "1.24.0", "1.26")
    assert x["action"] == {"can_lower_now": True, "lower_to": "1.25.1", "blocked_by": "big.org/x", "then_reaches": "1.24.0"}
    cut = tools.locate_cuts(project, "big.org/x")
    assert (cut["target"], cut["floor_before"], cut["floor_after"], cut["moves_floor"]) == (True, "1.25.1", "1.24.0", True)
    assert [(e["pkg"], e["imported_by"]) for e in cut["entries"]["rows"]] == [("big.org/x", "home.org/app/cmd")]
    assert [(s["path"], s["line"]) for s in cut["sites"]["rows"]] == [("cmd/main.go", 4)]
    assert [(d["module"], d["freed"], d["needed_by"]) for d in cut["drags"]["rows"]] == [("both.org/z", False, "mid.org/y")]
    assert "without it 1.24.0" in texts.inspect(cut)
    assert tools.locate_cuts(project, "home.org/lib")["floor_after"] == ""
    with pytest.raises(ValueError):
        tools.locate_cuts(project, "absent.org")
    assert tools.measure(project)["version"] == "1.25.1"


def test_change_and_platforms(spark, folder, project):
    before = Analysis.of(spark, str(folder / "app-before"), str(folder / "before.json"), POLICY)
    x = tools.diff(project, before)
    status = {m["module"]: m["status"] for m in x["modules"]["rows"]}
    assert status["mid.org/y"] == "added" and status["home.org/lib"] == "changed"
    assert [(t["modules"], t["transitive"]) for t in x["totals"]["rows"] if t["status"] == "added"] == [(1, 0)]
    assert x["floor"]["direction"] == 0 and "added (1" in texts.diff(x)
    m = tools.platform_matrix({"linux/amd64": project, "darwin/arm64": before})
    first = m["modules"]["rows"][0]
    assert (first["module"], first["universal"], first["in_cells"]) == ("mid.org/y", False, "linux/amd64")
    assert all(r["universal"] for r in m["modules"]["rows"][1:]) and m["floor"]["version"] == "1.25.1"
    assert "linux/amd64" in texts.matrix(m) and "mid.org/y" in texts.matrix(m, True, True)
    with pytest.raises(ValueError):
        matrix({})


def test_command_line(spark, folder, capsys):
    common = ["--binary", str(folder / "app"), "--listing", str(folder / "listing.json"), "--folder", str(folder)]
    assert cli.main(["check", *common, "--format", "json"], spark) == 2
    x = json.loads(capsys.readouterr().out)
    assert x["fails"] == 3 and {v["rule"] for v in x["violations"]["rows"]} == {"max-binary-size", "deny", "max-module-size"}
    assert "failed" in texts.check(x).lower()
    assert cli.main(["go-version", *common], spark) == 0 and "floor 1.25.1" in capsys.readouterr().out
    assert cli.main(["inspect", *common, "absent"], spark) == 1 and "not in the build" in capsys.readouterr().err
    assert cli.main(["modules", "--listing", str(folder / "listing.json"), "--folder", str(folder)], spark) == 0
    assert [m["module"] for m in json.loads(capsys.readouterr().out)] == ["big.org/x", "both.org/z", "home.org/lib", "mid.org/y"]
    assert cli.main(["config", "--folder", str(folder), "--lock", "q"], spark) == 0
    x = json.loads(capsys.readouterr().out)
    assert x["lock"] == ["q"] and x["cells"] == list(settings.DEFAULT_PLATFORMS)
    assert cli.main(["anatomy", *common[:2], "--listing", str(folder / "none.json")], spark) == 1


def test_settings(tmp_path):
    assert settings.split_arguments("""-a  "b c" d'e f'g '' "-x=""y" """) == ["-a", "b c", "de fg", "", "-x=y"]
    assert settings.without_templates("-X v={{.Version}} {{ .A }}b") == "-X v=0 0b"
    assert settings.environment(["A=1", " B =x=y", "bad", "=z"]) == {"A": "1", "B": "x=y"}
    assert settings.build_arguments(["-trimpath", "-v -x"], ["-s\n-w", "-X a={{.B}}"]) == '-trimpath -v -x -ldflags="-s -w -X a=0"'
    assert [settings.build_target(*x) for x in (("", ""), ("sub", ""), ("", "./cmd"), (".", "./cmd"), ("./sub", "./cmd"), ("sub", "cmd"))] == ["", "sub", "./cmd", "./cmd", "./sub/cmd", "sub/cmd"]
    assert settings.merged([" a ", "b"], ["b", "", "c"]) == ["a", "b", "c"]
    a, b = settings.Cell("linux", "amd64", ("y", "x", "y"), {"A": "1", "B": "2"}), settings.Cell("linux", "amd64", ("x", "y"), {"B": "2", "A": "1"})
    assert a.label == "linux/amd64+x,y" and a.identity == b.identity
    assert settings.build_key("c", "t", a) == settings.build_key("c", "t", b) != settings.build_key("c", "t2", b)
    with pytest.raises(FileNotFoundError):
        settings.release(str(tmp_path))
    build = {"dir": "./sub", "main": "./cmd", "goos": ["linux", "windows"], "goarch": ["amd64", "arm64"], "ignore": [{"goos": "windows", "goarch": "arm64"}], "tags": "a b", "env": ["CGO_ENABLED=0"]}
    (tmp_path / ".goreleaser.yaml").write_text(json.dumps({"builds": [build, {"targets": ["linux_amd64_v1", "bad"], "tags": ["b", "a"], "env": ["CGO_ENABLED=0"]}, {"goos": ["plan9"]}]}))
    found = settings.release(str(tmp_path))
    assert [(c.system, c.arch) for c in found.cells] == [("linux", "amd64"), ("linux", "arm64"), ("windows", "amd64"), ("plan9", "amd64"), ("plan9", "arm64")]
    assert found.target == "./sub/cmd" and found.builds == 3 and found.host("plan9", "arm64").tags == () and found.host("no", "no").system == "linux"
    conf = settings.load(str(tmp_path), controlled=["x"])
    assert conf.env == {"CGO_ENABLED": "0"} and conf.target == "./sub/cmd" and len(conf.cells) == 5
    (tmp_path / "heftgraph.json").write_text(json.dumps({"matrix": ["linux/arm64+t"], "controlled": "y", "build": {"tags": ["q"], "env": {"A": "b"}}}))
    conf = settings.load(str(tmp_path), controlled=["x", "y"])
    assert conf.controlled == ("y", "x") and [c.label for c in conf.cells] == ["linux/arm64+t"] and conf.tags == ("q",)
    (tmp_path / "heftgraph.json").write_text("[1]")
    with pytest.raises(ValueError):
        settings.load(str(tmp_path))


def test_snapshots(spark, tmp_path):
    tables = {"a": spark.range(5), "b": spark.range(3).withColumnRenamed("id", "x")}
    assert snapshots.load(spark, str(tmp_path), "k") is None
    snapshots.store(tables, str(tmp_path), "k")
    snapshots.store({"a": spark.range(9)}, str(tmp_path), "k")  # a key that is there stays
    found = snapshots.load(spark, str(tmp_path), "k")
    assert {n: df.count() for n, df in found.items()} == {"a": 5, "b": 3}
    assert [p.name for p in tmp_path.iterdir()] == ["k"]
    assert [tuple(r) for r in snapshots.changed(found, {"a": spark.range(2, 6), "b": tables["b"]}).collect()] == [("a", 2, 1)]


def test_report_texts():
    assert [texts.human(n) for n in (0, 999, 1000, 15_340, 2_500_000, 10**12)] == ["0 B", "999 B", "1.0 kB", "15.3 kB", "2.5 MB", "1.0 TB"]
    assert texts.signed(-1500) == "-1.5 kB" and texts.got(0, 0) == "-" and texts.got(1, 4) == "25.0%"
    assert texts.plain("\x1b[31mred\x1b[0m  \nx ") == "red\nx" and texts.joined(list("abcde")) == "a, b, c +2 more"
