"""Calls with a time limit, in child processes that can be killed."""

from __future__ import annotations

import multiprocessing
import time
from collections.abc import Callable
from multiprocessing.connection import Connection, wait

_FORK = multiprocessing.get_context("fork")


def _serve(f: Callable, at: Connection) -> None:
    while True:
        try:
            args = at.recv()
        except EOFError:  # the worker is gone
            return
        try:
            at.send((True, float(f(*args))))
        except Exception:  # noqa: BLE001  a scorer may fail in any way
            at.send((False, 0.0))


class Children:
    """At most so many processes that call ``f``; they go with the context."""

    def __init__(self, f: Callable, processes: int) -> None:
        self.f, self.processes = f, processes
        self.idle: list[tuple[Connection, multiprocessing.Process]] = []
        self.busy: dict[Connection, tuple[multiprocessing.Process, int, float]] = {}

    def __enter__(self) -> Children:
        return self

    def __exit__(self, *_) -> None:
        for at, child in [*self.idle, *((at, x[0]) for at, x in self.busy.items())]:
            self._kill(at, child)
        self.idle, self.busy = [], {}

    def _kill(self, at: Connection, child) -> None:
        at.close()
        child.kill()
        child.join()

    def _child(self):
        if self.idle:
            return self.idle.pop()
        here, there = _FORK.Pipe()
        child = _FORK.Process(target=_serve, args=(self.f, there), daemon=True)
        child.start()
        there.close()
        return here, child

    def scores(self, rows: list[tuple], seconds: float, on_error: float) -> list[float]:
        out, given = [on_error] * len(rows), 0
        while given < len(rows) or self.busy:
            while given < len(rows) and len(self.busy) < self.processes:
                at, child = self._child()
                try:
                    at.send(rows[given])
                except OSError:  # it ended after its last row
                    self._kill(at, child)
                    continue
                self.busy[at] = (child, given, time.monotonic() + seconds)
                given += 1
            first = min(x[2] for x in self.busy.values())
            for at in wait(list(self.busy), max(0.0, first - time.monotonic())):
                child, place, _ = self.busy.pop(at)
                try:
                    good, score = at.recv()
                except (EOFError, OSError):  # the scorer ended its process
                    self._kill(at, child)
                    continue
                out[place] = score if good else on_error
                self.idle.append((at, child))
            now = time.monotonic()
            for at in [at for at, x in self.busy.items() if x[2] <= now and not at.poll()]:
                self._kill(at, self.busy.pop(at)[0])
        return out
