"""Lines of a session: queries, and commands that begin with a backslash."""

from __future__ import annotations

import pydoc
import time
from pathlib import Path

from vecloom.plans.engine import Engine
from vecloom.plans.render import render
from vecloom.plans.sql import Select, parse
from vecloom.types import VecloomError

HELP = """\\d, \\dt           list collections
\\d NAME           describe a collection
\\create NAME      create a collection
\\use NAME         make it the current one (the name * in queries)
\\drop NAME        delete it
\\format HOW       table, json, csv or vertical
\\x                vertical rows on or off
\\timing           show how long queries take
\\pager            page long results on or off
\\o FILE           write results to a file; without a name, back to the screen
\\i FILE           run the lines of a file
\\clear            forget the current collection
\\help             this text
\\quit             leave"""


class Shell:
    def __init__(self, engine: Engine, write=print):
        self.engine, self._write = engine, write
        self.current: str | None = None
        self.how, self.timing, self.pager, self.open = "table", False, False, True
        self._file: Path | None = None

    def out(self, text: str) -> None:
        if self._file is None and self.pager:
            pydoc.pager(text)
        elif self._file is None:
            self._write(text)
        else:
            with self._file.open("a") as file:
                file.write(text + "\n")

    def line(self, text: str) -> None:
        text = text.strip()
        if not text:
            return
        try:
            if text.startswith("\\"):
                self._command(*text[1:].rstrip(";").split(None, 1))
            else:
                self._query(text)
        except (VecloomError, OSError) as error:
            self._write(f"error: {error}")

    def _query(self, text: str) -> None:
        began, query = time.perf_counter(), parse(text)
        how = "vertical" if isinstance(query, Select) and query.vertical else self.how
        self.out(render(self.engine.sql(text, self.current), how))
        if self.timing:
            self._write(f"{time.perf_counter() - began:.3f} s")

    def _command(self, name: str = "", rest: str = "") -> None:
        rest = rest.strip()
        if name in ("d", "dt") and not rest:
            self.out(render(self.engine.catalog.frame().select("name", "dimension", "space", "id"), self.how))
        elif name == "d":
            config = self.engine.collection(rest).config
            self.out("\n".join(f"{k}: {v}" for k, v in (("name", config.name), ("id", config.id), ("dimension", config.dimension), ("space", config.space.value), ("metadata", config.metadata))))
        elif name == "create":
            self.engine.create_collection(rest)
        elif name == "use":
            self.current = self.engine.collection(rest).config.name
        elif name == "drop":
            self.engine.delete_collection(rest)
            self.current = None if self.current == rest else self.current
        elif name == "format":
            if rest not in ("table", "json", "csv", "vertical"):
                raise VecloomError(f"unknown format {rest!r}")
            self.how = rest
        elif name == "x":
            self.how = "table" if self.how == "vertical" else "vertical"
        elif name == "timing":
            self.timing = not self.timing
        elif name == "pager":
            self.pager = not self.pager
        elif name == "o":
            self._file = Path(rest) if rest else None
        elif name == "i":
            for text in Path(rest).read_text().splitlines():
                self.line(text)
        elif name == "clear":
            self.current = None
        elif name in ("help", "?"):
            self.out(HELP)
        elif name in ("quit", "q"):
            self.open = False
        else:
            raise VecloomError(f"unknown command \\{name}")
