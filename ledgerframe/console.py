"""The command language: one line, one call of a session."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from . import __doc__ as about
from .errors import TableError
from .operators import read
from .session import Session
from .sources.files import copy_to

_QUOTED = r'"(?:[^"\\]|\\.)*"'
_BRACES = rf'\{{((?:{_QUOTED}|[^"}}])*)\}}'
#: Commands and their patterns; names of groups are their arguments.
COMMANDS = {
    "get metadata": r"get @metadata from (?P<ds>\S+)",
    "get": rf"get @value from (?P<ds>\S+)(?: with {_BRACES})?",
    "join": rf"join @value from (?P<a>\S+)(?: with {_BRACES})? (?P<b>\S+)(?: with {_BRACES})? (?P<mode>ON|LEFTON|RIGHTON|OUTON) {_BRACES}",
    "add": rf"add {_BRACES} to (?P<ds>\S+)",
    "modify": rf"modify {_BRACES} in (?P<ds>\S+)(?: with {_BRACES})?",
    "remove": rf"remove from (?P<ds>\S+)(?: with {_BRACES})?",
    "list": r"list @(?P<what>datasets|commands)",
    "size": r"size(?: (?P<ds>\S+))?",
    "copy": r"copy (?P<ds>\S+) (?P<path>\S+)",
    "release": r"release (?P<ds>\S+)",
    "reload": r"reload (?P<ds>\S+)",
    "show": r"show @error",
    "set": r"set @(?:timing|time) (?P<state>on|off)",
    "connect": r"connect(?: .*)?",
    "disconnect": r"disconnect",
    "exit": r"exit",
    "help": r"help(?: (?P<what>.+))?",
    "version": r"version(?: @\w+)?",
}


#: Short forms of commands.
SHORT = {"h": "help", "v": "version", "conn": "connect", "disc": "disconnect", "e": "exit"}
#: What each command is for.
HELP = {
    "get metadata": "get @metadata from DATASET",
    "get": "get @value from DATASET [with {criteria}]",
    "join": "join @value from DATASET [with {criteria}] DATASET [with {criteria}] ON|LEFTON|RIGHTON|OUTON {columns}",
    "add": "add {column:value;...} to DATASET; a column without :value is null",
    "modify": "modify {column:value;...} in DATASET [with {criteria}]",
    "remove": "remove from DATASET [with {criteria}]",
    "list": "list @datasets|@commands",
    "size": "size [DATASET]",
    "copy": "copy DATASET PATH",
    "release": "release DATASET: gives it up until it is reloaded",
    "reload": "reload DATASET: reads its source anew",
    "show": "show @error",
    "set": "set @timing|@time on|off",
    "connect": "connect [HOST PORT PASSWORD]: this console is always with its session",
    "disconnect": "disconnect: ends the session's snapshot",
    "exit": "exit: closes the session",
    "help": "help [COMMAND]",
    "version": "version [@server|@console]",
}
_ASSIGNMENT = re.compile(rf'\s*([^:;"]+?)\s*(?::\s*({_QUOTED}|[^;"]*?)\s*)?(?:;|$)')


def _assignments(text: str) -> dict[str, str | None]:
    """Parses `col:val;col:val`; a column without a value is null, and a value in
    quotes can hold any character."""
    out: dict[str, str | None] = {}
    at = 0
    while text[at:].strip(" ;"):
        found = _ASSIGNMENT.match(text, at)
        if found is None:
            raise TableError(217, text[at : at + 40])
        name, value = found.groups()
        out[name] = re.sub(r"\\(.)", r"\1", value[1:-1], flags=re.S) if value and value.startswith('"') else value
        at = found.end()
    return out


class Console:
    """Runs commands; results are DataFrames or a line of text."""

    def __init__(self, session: Session) -> None:
        self.session, self.timing = session, False

    def run(self, line: str) -> DataFrame | str:
        began = time.monotonic()
        out = self._run(line.strip())
        if self.timing:
            print(f"{time.monotonic() - began:.3f} s")
        return out

    def show(self, line: str, out: Callable[[str], None] = print) -> int | None:
        """Runs a command and prints its result: rows in column order, null as text
        (blanks for the side that an outer join did not find), then their number."""
        result = self.run(line)
        if isinstance(result, str):
            out(result)
            return None
        joined = line.lstrip().lower().startswith("join")
        out("\t".join(result.columns))
        out("\t".join("-" * len(c) for c in result.columns))
        n = 0
        for row in result.toLocalIterator():  # a partition at a time
            sides = [row] if not joined else [[x for c, x in zip(result.columns, row, strict=True) if c.startswith(p)] for p in ("l_", "r_")]
            cells = [("" if joined and all(x is None for x in side) else "null") if x is None else str(x) for side in sides for x in side]
            out("\t".join(cells))
            n += 1
        out(f"{n} datas found.")
        return n

    def _run(self, line: str) -> DataFrame | str:
        first, space, rest = line.partition(" ")
        line = SHORT.get(first.lower(), first) + space + rest
        for command, pattern in COMMANDS.items():
            if found := re.fullmatch(pattern, line, re.I | re.S):
                return self._do(command, found)
        self.session.last_error = TableError(217, line)
        raise self.session.last_error

    def _do(self, command: str, m: re.Match) -> DataFrame | str:
        s, named = self.session, m.groupdict()
        texts = [g for g, i in zip(m.groups(), range(1, 20)) if i not in m.re.groupindex.values()]
        ds = named.get("ds")
        if command == "get":
            return s.search(ds, texts[0])
        if command == "get metadata":
            return read.metadata(s.catalog.get(ds))
        if command == "join":
            return s.search_join(named["a"], named["b"], texts[2], named["mode"], left_criteria=texts[0], right_criteria=texts[1])
        if command == "add":
            return s.insert_row(ds, self._parsed(texts[0])).log
        if command == "modify":
            return s.modify(ds, self._parsed(texts[0]), texts[1]).log
        if command == "remove":
            return s.remove(ds, texts[0]).log
        if command == "list":
            return s.catalog.listing() if named["what"].lower() == "datasets" else "\n".join(COMMANDS)
        if command == "size":
            return read.size_parts(s.catalog.get(ds)) if ds else read.database_size(s.catalog.all())
        if command == "copy":
            copy_to(s.catalog.get(ds), named["path"])
            return "copied"
        if command in ("release", "reload"):
            getattr(s.catalog, command)(ds)
            return {"release": "released", "reload": "reloaded"}[command]
        if command == "show":
            return str(s.last_error or "no error")
        if command == "set":
            self.timing = named["state"].lower() == "on"
            return f"timing {named['state'].lower()}"
        if command in ("connect", "disconnect"):
            s.end_snapshot()
            return f"{command}ed"
        if command == "exit":
            s.close()
            return "closed"
        if command == "help":
            what = (named["what"] or "").strip().lower()
            return "\n".join(text for name, text in HELP.items() if name.startswith(SHORT.get(what, what))) or f"no command {what}"
        return about or ""

    def _parsed(self, text: str) -> dict[str, str | None]:
        try:
            return _assignments(text)
        except TableError as e:
            self.session.last_error = e
            raise
