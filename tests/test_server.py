"""The tool server: requests and answers, analyses that stay warm, and files that change."""

import io
import json

import pytest
from test_tools import PROJECT, binary, folder, listing  # noqa: F401  (folder is a fixture)

from heftgraph.server import NO_ARGUMENTS, NO_METHOD, NO_REQUEST, NOT_JSON, Server


@pytest.fixture
def talk(spark):
    server = Server(spark)

    def ask(*lines):
        out = io.StringIO()
        server.serve(io.StringIO("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n"), out)
        return [json.loads(x) for x in out.getvalue().splitlines()]

    ask.server = server
    return ask


def call(name, **arguments):
    return {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": name, "arguments": arguments}}


def test_protocol(talk):
    got = talk({"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, "", {"jsonrpc": "2.0", "id": "a", "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "ping"})
    assert [g["id"] for g in got] == [1, "a", 3] and got[0]["result"]["serverInfo"]["name"] == "heftgraph"
    assert {t["name"] for t in got[1]["result"]["tools"]} == {"anatomy", "size_targets", "go_floor", "locate_cuts", "measure", "diff", "check", "matrix"}
    bad = talk("{", [1], {"id": 4, "method": "ping"}, {"jsonrpc": "2.0", "id": 5, "method": "nothing"}, call("nothing"), call("anatomy", binary="x"), call("anatomy", binary="x", listing="y", other=1), {"jsonrpc": "2.0", "method": "nothing"})
    assert [g["error"]["code"] for g in bad] == [NOT_JSON, NO_REQUEST, NO_REQUEST, NO_METHOD, NO_ARGUMENTS, NO_ARGUMENTS, NO_ARGUMENTS]
    assert "listing is missing" in bad[5]["error"]["message"] and "other is unknown" in bad[6]["error"]["message"]
    assert len(talk({"jsonrpc": "2.0", "id": 1, "method": "shutdown"}, {"jsonrpc": "2.0", "id": 2, "method": "ping"})) == 1


def test_answers_stay_warm_until_files_change(talk, folder, tmp_path):  # noqa: F811
    (tmp_path / "app").write_bytes(binary(PROJECT))
    (tmp_path / "listing.json").write_text(listing(PROJECT))
    (tmp_path / "src").mkdir()
    (tmp_path / "src/main.go").write_text('package main\n\nimport "home.org/lib"\n\nfunc main() { lib.Run() }\n')
    files = {"binary": str(tmp_path / "app"), "listing": str(tmp_path / "listing.json"), "sources": str(tmp_path / "src"), "controlled": ["home.org/lib"]}

    def ask(name, **more):
        (got,) = talk(call(name, **files, **more))
        assert not got["result"]["isError"], got
        assert json.loads(got["result"]["content"][0]["text"]) == got["result"]["structuredContent"]
        return got["result"]["structuredContent"]

    warm = talk.server.warm
    first = ask("measure")
    held = warm.get(files)
    assert ask("measure") == first and warm.get(files) is held
    # another policy shares the build
    other = warm.get(files | {"controlled": []})
    assert other is not held and other.graph.build is held.graph.build
    # the same contents, written anew
    (tmp_path / "listing.json").write_text(listing(PROJECT))
    assert warm.get(files) is held
    # an edited source
    sites = lambda: {r["module"]: r["import_sites"] for r in held_now().coupling.collect()}
    held_now = lambda: warm.get(files)
    before = sites()
    (tmp_path / "src/main.go").write_text('package main\n\nimport "home.org/lib"\nimport x "big.org/x"\n\nfunc main() { lib.Run(); x.Go(); x.Stop() }\n')
    assert held_now() is not held and sites() != before and sites()["big.org/x"] >= 1
    (gone,) = talk(call("anatomy", binary=str(tmp_path / "none"), listing=files["listing"]))
    assert gone["result"]["isError"] and "\n" not in gone["result"]["content"][0]["text"]


def test_cells_of_the_server(talk, folder):  # noqa: F811
    good = {"binary": str(folder / "app"), "listing": str(folder / "listing.json")}
    (got,) = talk(call("matrix", cells={"linux/amd64": good, "linux/arm64": good | {"binary": str(folder / "none")}}))
    answer = got["result"]["structuredContent"]
    assert [c["label"] for c in answer["cells"]["rows"]] == ["linux/amd64"] and [f["label"] for f in answer["failed"]["rows"]] == ["linux/arm64"]
