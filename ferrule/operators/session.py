"""A search that is run by requests, for a user interface or a service that polls it.

A request is a dict with a ``type``; its answer is a sequence of events, dicts with a ``type`` too. A run is a generator:
the caller takes events for as long as it likes, and a pause, from wherever, ends it after the iteration that is going on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import functions as F

from ferrule.operators.search import SearchEngine

#: Seconds between two snapshots, and between two fronts.
SNAPSHOT_SECONDS, FRONT_SECONDS = 0.2, 0.25


class SearchSession:
    """Answers requests: init, start, pause, step, evaluate and reset. ``make`` builds an engine from init's options."""

    def __init__(self, make: Callable[..., SearchEngine], clock: Callable[[], float] = time.monotonic):
        self.make, self.clock = make, clock
        self.engine: SearchEngine | None = None
        self.running = False

    def answer(self, request: dict) -> Iterator[dict]:
        kind = request.get("type")
        try:
            if kind == "init":
                self.running, self.engine = False, self.make(**request.get("options", {}))
                counts = self.engine.split().agg(F.count_if(~F.col("is_val")).alias("train"), F.count_if("is_val").alias("val")).first()
                yield {"type": "ready", "split": counts.asDict()}
            elif kind == "reset":
                self.running, self.engine = False, None
                yield {"type": "reset_done"}
            elif kind == "pause":
                self.running = False
                yield {"type": "paused"}
            elif kind not in ("start", "step", "evaluate"):
                raise ValueError(f"there is no request {kind!r}")
            elif self.engine is None:
                raise ValueError("the search has not been initialised")
            elif kind == "evaluate":
                result = self.engine.evaluate_member(int(request["member"]), request.get("which", "train")).first()
                yield {"type": "eval_result", "request": request.get("request"), "result": result.asDict()}
            elif kind == "step":
                self.engine.step(max(0, int(request.get("iterations", 1))))
                yield from self.state(self.engine.snapshot())
            elif not self.running:
                yield from self.run()
        except Exception as e:  # noqa: BLE001
            self.running = False
            yield {"type": "error", "error": str(e)}

    @staticmethod
    def state(shot: dict) -> Iterator[dict]:
        yield {"type": "snapshot", "snapshot": {k: v for k, v in shot.items() if k != "front"}}
        yield {"type": "front_update", "front": shot["front"]}

    def run(self) -> Iterator[dict]:
        """Iterations until the search is finished or paused; snapshots and fronts no faster than their intervals."""
        engine, self.running = self.engine, True
        shown = fronts = float("-inf")
        while self.running and not engine.is_finished:
            engine.step()
            now = self.clock()
            due = now - shown >= SNAPSHOT_SECONDS, now - fronts >= FRONT_SECONDS
            if any(due):
                snapshot, front = self.state(engine.snapshot())
                if due[0]:
                    shown = now
                    yield snapshot
                if due[1]:
                    fronts = now
                    yield front
        if not self.running:
            yield {"type": "paused"}
            return
        yield from self.state(engine.snapshot())
        self.running = False
        yield {"type": "done"}


def selected(front: list[dict], best: dict | None, member: int | None) -> dict | None:
    """The member of the front that was chosen; the best one where none was, or where it is the one that was chosen."""
    if member is None:
        return best
    there = [m for m in front if m["id"] == member]
    return there[0] if there else best if best is not None and best["id"] == member else None
