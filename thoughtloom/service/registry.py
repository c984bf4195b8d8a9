"""The knowledge bases under one folder: a table of them, of which every change is a new file.

State n is the file ``registry/n``: all bases and the selected one. A change reads the highest state, and writes
the next; nothing is replaced or moved, so a stop at any time leaves a whole state, and renaming or deleting
costs nothing on a store without renames. The folder of a base carries the number of the change that made it,
so an id can be used again after its base was deleted. Of two changes at once one fails, as its file is there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..operators.lifecycle import kb_stats
from ..sources.storage import Storage
from .knowledge import KnowledgeBase


@dataclass(frozen=True)
class Base:
    """A knowledge base as the registry knows it; ``deleted`` is when it went, or empty."""

    id: str
    name: str
    folder: str
    description: str = ""
    author: str = ""
    created_at: str = ""
    updated_at: str = ""
    deleted: str = ""


@dataclass(frozen=True)
class State:
    number: int
    bases: tuple[Base, ...]
    selected: str | None

    def find(self, kb_id: str | None) -> Base | None:
        return next((b for b in self.bases if b.id == kb_id and not b.deleted), None)


class Refused(Exception):
    """Why a change cannot be made."""


def _answer(**told) -> dict:
    """Callers look for ``success``, and for ``error`` where it is false."""
    return {"success": "error" not in told, **told}


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Storage(spark, root)

    def state(self) -> State:
        last = max((int(n) for n in self.files.names("registry")), default=0)
        if not last:
            return State(0, (), None)
        told = json.loads(self.files.read_text(f"registry/{last:09d}"))
        return State(last, tuple(Base(**b) for b in told["bases"]), told["selected"])

    def _change(self, make: Callable[[State], tuple[list[Base], str | None, dict]]) -> dict:
        """Writes what ``make`` gives for the present state as the next one; what it refuses is answered as an error."""
        now = self.state()
        try:
            bases, selected, told = make(now)
        except Refused as why:
            return _answer(error=str(why))
        content = json.dumps({"bases": [asdict(b) for b in bases], "selected": selected}, indent=1)
        self.files.write_text(f"registry/{now.number + 1:09d}", content, replace=False)
        return _answer(**told)

    def _id(self, state: State, name: str, besides: str | None = None) -> str:
        kb_id = self.spark.range(1).select(slugify(F.lit(name))).head()[0]
        if not kb_id:
            raise Refused("the name has neither letters nor digits")
        if kb_id != besides and state.find(kb_id):
            raise Refused(f"there is a knowledge base {kb_id} already")
        return kb_id

    @staticmethod
    def _known(state: State, kb_id: str) -> Base:
        found = state.find(kb_id)
        if found is None:
            raise Refused(f"there is no knowledge base {kb_id}")
        return found

    def create(self, name: str, description: str = "", author: str = "", now: datetime | None = None) -> dict:
        time = (now or datetime.now()).isoformat()

        def make(state: State):
            kb_id = self._id(state, name)
            base = Base(kb_id, name, f"bases/{state.number + 1:09d}", description, author, time, time)
            return [*state.bases, base], state.selected, {"id": kb_id, "path": f"{self.root}/{base.folder}"}

        return self._change(make)

    def select(self, kb_id: str) -> dict:
        """Selects a base for all that read this registry, in this process and in later ones."""
        def make(state: State):
            base = self._known(state, kb_id)
            return list(state.bases), kb_id, {"id": kb_id, "name": base.name, "concept_count": self._at(base).live().count()}

        return self._change(make)

    def _rewritten(self, kb_id: str, change: Callable[[State, Base], Base], told: Callable[[Base], dict]) -> dict:
        def make(state: State):
            old = self._known(state, kb_id)
            new = change(state, old)
            still = None if new.deleted else new.id
            return [new if b is old else b for b in state.bases], still if state.selected == kb_id else state.selected, told(new)

        return self._change(make)

    def delete(self, kb_id: str, now: datetime | None = None) -> dict:
        """Takes a base out of the list; its folder stays and is told, for whoever empties it."""
        time = (now or datetime.now()).isoformat()
        return self._rewritten(kb_id, lambda _, b: replace(b, deleted=time), lambda b: {"id": kb_id, "kept": b.folder})

    def rename(self, old_id: str, new_name: str, now: datetime | None = None) -> dict:
        time = (now or datetime.now()).isoformat()
        change = lambda state, b: replace(b, id=self._id(state, new_name, b.id), name=new_name, updated_at=time)
        return self._rewritten(old_id, change, lambda b: {"old_id": old_id, "new_id": b.id})

    def _at(self, base: Base) -> KnowledgeBase:
        return KnowledgeBase(self.spark, f"{self.root}/{base.folder}")

    def open(self, kb_id: str) -> KnowledgeBase:
        found = self.state().find(kb_id)
        if found is None:
            raise KeyError(kb_id)
        return self._at(found)

    def _brief(self, base: Base) -> dict:
        return {k: v for k, v in asdict(base).items() if k not in ("folder", "deleted")}

    def list(self) -> list[dict]:
        state = self.state()
        return [{**self._brief(b), "concept_count": self._at(b).live().count(), "is_active": b.id == state.selected} for b in state.bases if not b.deleted]

    def current(self) -> dict | None:
        """The selected base with its totals; None without a selection."""
        state = self.state()
        base = state.find(state.selected)
        if base is None:
            return None
        kb = self._at(base)
        return {"id": base.id, "name": base.name, "description": base.description, **kb_stats(kb.concepts()).head().asDict(), "graph_edges": kb.edges().count()}

    def concepts(self, only: list[str] | None = None) -> DataFrame | None:
        """The concepts of all (or the named) knowledge bases with ``kb_id`` and ``kb_name``; None if there is none."""
        out = None
        for base in self.state().bases:
            if not base.deleted and (only is None or base.id in only):
                rows = self._at(base).live().withColumn("kb_id", F.lit(base.id)).withColumn("kb_name", F.lit(base.name))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out
