"""Checks of stored tables that read only what has changed since the last time."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tradewell.plans.files import SharedFolder
from tradewell.plans.parts import PartTable


class PartCheck:
    """The findings of a check, kept by part of the table they are about.

    ``check`` takes rows and returns findings that have the table's part column and depend on the rows of their
    part alone (repeated keys within a day, orphans of a day). A part is read again if the files that the
    table's manifest names for it differ from those it was last checked with, or if ``signature`` differs, which
    stands for all else that the findings depend on, such as the versions of parent tables.
    """

    def __init__(
        self, table: PartTable, path: str, findings: StructType, check: Callable[[DataFrame], DataFrame], signature: str = "",
    ):
        if table.column not in findings.fieldNames():
            raise ValueError(f"findings lack the part column {table.column}")
        self.table, self.check, self.signature = table, check, signature
        self.found = PartTable(table.spark, f"{path.rstrip('/')}/hallazgos", findings, column=table.column)
        self._seen = SharedFolder(table.spark, f"{path.rstrip('/')}/vistos")

    def _checked(self) -> dict[str, list[str]]:
        """The parts and files that the findings of now were made from; nothing if that was never noted."""
        name = f"{self.found.manifest().number:010d}.json"
        if name not in self._seen.names():
            return {}
        noted = json.loads(self._seen.read(name))
        return noted["parts"] if noted["signature"] == self.signature else {}

    def run(self) -> list[str]:
        """Brings the findings up to date; the parts that were read."""
        now, before = self.table.manifest(), self._checked()
        changed = sorted(part for part, runs in now.parts.items() if before.get(part) != runs)
        known = self.found.manifest()
        gone = [part for part in known.parts if part not in now.parts]
        if changed or gone or not known.number:
            # What was checked is noted after the findings: a run that stops in between checks everything again.
            after = self.found.replace(self.check(self.table.read(now, changed)), [*changed, *gone], known)
            self._seen.create(f"{after.number:010d}.json", json.dumps({"signature": self.signature, "parts": now.parts}))
        return changed

    def report(self) -> DataFrame:
        return self.found.read()
