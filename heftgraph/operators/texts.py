"""Layouts of whole reports, as text or Markdown, from the answers of tools.py."""

from __future__ import annotations

import re

# Rows shown of sections, of single modules' lists and of platforms.
SECTIONS, LISTS = 8, 40


def human(n: int) -> str:
    if n < 1000:
        return f"{n} B"
    for power, unit in ((12, "TB"), (9, "GB"), (6, "MB"), (3, "kB")):
        if n >= 10**power:
            return f"{n / 10**power:.1f} {unit}"


def signed(n: int) -> str:
    return ("-" if n < 0 else "+") + human(abs(n))


def percent(part: int, whole: int) -> str:
    return f"{100 * part / whole if whole else 0:.1f}%"


def got(freed: int, potential: int) -> str:
    """How much of what could be freed a cut gets alone; '-' where nothing could."""
    return percent(freed, potential) if potential else "-"


def plain(text: str) -> str:
    """Text without terminal colours and without white space at the ends of lines."""
    return "\n".join(line.rstrip() for line in re.sub(r"\x1b\[[0-9;]*m", "", text).split("\n"))


def indent(text: str, by: str = "  ") -> str:
    return "\n".join(by + line if line else line for line in text.split("\n"))


def first_line(text: str) -> str:
    return text.strip().split("\n")[0]


def importer_note(importers: int) -> str:
    return "" if not importers else f"{importers} importer" + ("s" if importers > 1 else "")


def joined(names: list[str], most: int = 3) -> str:
    return ", ".join(names[:most]) + (f" +{len(names) - most} more" if len(names) > most else "")


class Page:
    """Headings, lines and tables, in one of two styles."""

    def __init__(self, markdown: bool):
        self.markdown, self.parts = markdown, []

    def heading(self, text: str) -> None:
        self.parts.append(f"## {text}" if self.markdown else text)

    def line(self, text: str) -> None:
        self.parts.append(text if self.markdown else indent(text))

    def table(self, names: list[str], rows: list[list], most: int = LISTS) -> None:
        shown = [[str(c) for c in r] for r in rows[:most]]
        if self.markdown:
            cell = lambda c: c.replace("|", "\\|")
            out = ["| " + " | ".join(map(cell, r)) + " |" for r in ([names] + shown)]
            out.insert(1, "|" + "-|" * len(names))
        else:
            every = [[n.upper() for n in names], *shown]
            width = [max(len(r[k]) for r in every) for k in range(len(names))]
            out = [indent("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip()) for r in every]
        if len(rows) > most:
            out.append(("" if self.markdown else "  ") + f"+{len(rows) - most} more")
        self.parts.append("\n".join(out))

    def text(self) -> str:
        return plain("\n\n".join(self.parts)) + "\n"


def anatomy(x: dict, markdown: bool = False, top: int = LISTS) -> str:
    p, whole = Page(markdown), x["accounted_size"]
    p.heading("size")
    p.line(f"{human(whole)} accounted of {human(x['binary_size'])} on disk" + (", stripped: code only" if x["stripped"] else ""))
    foreign = sum(m["size"] for m in x["modules"]["rows"] if m["module"] != x["main_module"])
    p.table(["content", "bytes", "share"], [[k, human(x[c]), percent(x[c], whole)] for k, c in (("code", "code_size"), ("data", "data_size"), ("line table", "pclntab_size"))])
    p.table(["owner", "bytes", "share"], [[k, human(n), percent(n, whole)] for k, n in (("third-party", foreign), ("main", x["main_size"]), ("std", x["std_size"]), ("generated", x["generated_size"]))])
    p.heading("sections")
    p.table(["section", "bytes"], [[s["name"], human(s["size"])] for s in x["sections"]["rows"]], SECTIONS)
    p.heading("modules")
    kind = lambda m: "locked" if m["locked"] else "direct" if m["direct"] else "indirect"
    p.table(["module", "bytes", "share", "kind", "version"], [[m["module"], human(m["size"]), percent(m["size"], whole), kind(m), m["version"] or "-"] for m in x["modules"]["rows"]], top)
    return p.text()


def prune(x: dict, markdown: bool = False, top: int = LISTS) -> str:
    p, rows = Page(markdown), x["candidates"]["rows"]
    p.heading("prune")
    if rows:
        big, easy = max(rows, key=lambda r: (r["prize_bytes"], r["module"])), max(rows, key=lambda r: (r["freed_bytes"], r["module"]))
        p.line(f"biggest {big['module']}: {human(big['prize_bytes'])} at stake; easiest {easy['module']}: {human(easy['freed_bytes'])} freed alone")
    note = lambda r: r["effort"] + (f" by {r['pinned_by']}" if r["pinned_by"] else "")
    p.table(["module", "prize", "freed", "potential", "got", "sites", "effort"], [[r["module"], human(r["prize_bytes"]), human(r["freed_bytes"]), human(r["potential_bytes"]), got(r["freed_bytes"], r["potential_bytes"]), r["import_sites"], note(r)] for r in rows], top)
    p.heading("plan")
    p.table(["step", "module", "saves", "own", "in all", "importers"], [[r["step"], r["module"], signed(r["marginal"]), percent(r["own_bytes"], r["marginal"]), human(r["cumulative"]), importer_note(r["importers"])] for r in x["plan"]["rows"]], top)
    return p.text()


def go_version(x: dict, markdown: bool = False) -> str:
    p, act = Page(markdown), x["action"]
    p.heading("go version")
    p.line(f"floor {x['version'] or '-'}, own modules declare {x['owned_max'] or '-'}")
    p.line(f"can be lowered to {act['lower_to'] or 'any version'} now" if act["can_lower_now"] else f"held by {joined([m for m in x['critical'].split(',') if m]) or 'nothing'}; without them {x['next_version'] or '-'}")
    return p.text()


def check(x: dict, markdown: bool = False) -> str:
    p = Page(markdown)
    p.heading("check " + ("passed" if x["passes"] else "failed") if x["configured"] else "check: no rules")
    if x["violations"]["rows"]:
        p.table(["rule", "module", "limit", "actual", "action"], [[v["rule"], v["module"] or "-", v["limit"], v["actual"], v["action"]] for v in x["violations"]["rows"]], len(x["violations"]["rows"]))
    return p.text()


def inspect(x: dict, markdown: bool = False) -> str:
    p = Page(markdown)
    p.heading(x["module"])
    p.line(f"class {x['class']}, {human(x['size'])}, frees {human(x['freed_bytes'])} of {human(x['potential_bytes'])}, version {x['version'] or '-'}")
    p.line(f"floor {x['floor_before'] or '-'}" + (f", without it {x['floor_after'] or '-'}" if x["target"] else ", no target"))
    p.table(["entry", "keeps", "imported by"], [[e["pkg"], human(e["retained"]), joined(e["imported_by"].split(","))] for e in x["entries"]["rows"]])
    if "sites" in x:
        p.table(["file", "line", "import"], [[s["path"], s["line"], s["import"]] for s in x["sites"]["rows"]])
    p.table(["drags", "bytes", "leaves", "needed by"], [[d["module"], human(d["bytes"]), "yes" if d["freed"] else "no", joined(d["needed_by"].split(","))] for d in x["drags"]["rows"]])
    return p.text()


def diff(x: dict, markdown: bool = False, top: int = LISTS) -> str:
    p, floor = Page(markdown), x["floor"]
    p.heading("change")
    p.line(f"bytes {signed(sum(m['delta'] for m in x['modules']['rows']))}")
    way = {1: "raised", -1: "lowered"}.get(floor["direction"], "unchanged")
    p.line(f"floor {floor['before'] or '-'} to {floor['after'] or '-'} ({way})" + (f", now held by {joined(floor['newly_critical'].split(','))}" if floor["newly_critical"] else ""))
    totals = {t["status"]: t for t in x["totals"]["rows"]}
    for status in ("added", "removed", "changed"):
        if status in totals:
            t = totals[status]
            p.heading(f"{status} ({t['modules']}, {signed(t['net'])}" + (f", {t['transitive']} transitive)" if status == "added" else ")"))
            p.table(["module", "bytes"], [[m["module"], signed(m["delta"])] for m in x["modules"]["rows"] if m["status"] == status], top)
    return p.text()


def matrix(x: dict, markdown: bool = False, wide: bool = False) -> str:
    p, rows = Page(markdown), x["modules"]["rows"]
    p.heading("platforms")
    p.line(f"floor {x['floor']['version'] or '-'} over all, held on {joined([c['label'] for c in x['cells']['rows'] if c['pins']]) or 'none'}")
    p.table(["platform", "modules", "bytes", "floor"], [[c["label"], c["modules"], human(c["bytes"]), c["version"] or "-"] for c in x["cells"]["rows"]], len(x["cells"]["rows"]))
    for f in x.get("failed", {"rows": []})["rows"]:
        p.line(f"{f['label']} failed: {first_line(f['error'])}")
    if wide:
        labels = [c["label"] for c in x["cells"]["rows"]]
        p.table(["module", *labels], [[m["module"], *(human(m["size_by_cell"][k]) if k in m["size_by_cell"] else "-" for k in labels)] for m in rows])
    else:
        p.table(["module", "version", "platforms", "most"], [[m["module"], m["version"] or "-", m["in_cells"], human(m["max_size"])] for m in rows if not m["universal"]])
    return p.text()
