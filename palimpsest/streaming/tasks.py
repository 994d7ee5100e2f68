"""Tasks that run from time to time, and a worker that runs them."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable

from ..operators.store import Agent

log = logging.getLogger(__name__)


def forgetting(agent: Agent, capacity: int, half_life: float, clock: Callable[[], float] = time.time) -> Callable[[], object]:
    return lambda: agent.forget_to(capacity, half_life, int(clock()))


def collection(agent: Agent, clock: Callable[[], float] = time.time) -> Callable[[], object]:
    return lambda: agent.collect_expired(int(clock()))


def consolidation(agent: Agent, complete: Callable[[str], str], clock: Callable[[], float] = time.time) -> Callable[[], object]:
    return lambda: agent.consolidate(complete, int(clock()))


class Worker:
    """Runs each task after every so many seconds. A task that fails is logged and runs again; tasks never run at once, as a store has one writer."""

    def __init__(self):
        self._tasks: list[tuple[str, float, Callable[[], object]]] = []
        self._stop, self._one, self._threads = threading.Event(), threading.Lock(), []

    def register(self, name: str, every: float, task: Callable[[], object]) -> Worker:
        if every <= 0:
            raise ValueError("every must be positive")
        self._tasks.append((name, every, task))
        return self

    def start(self) -> Worker:
        self._threads = [threading.Thread(target=self._loop, args=t, daemon=True) for t in self._tasks]
        for t in self._threads:
            t.start()
        return self

    def _loop(self, name: str, every: float, task: Callable[[], object]) -> None:
        while not self._stop.wait(every):
            try:
                with self._one:
                    task()
            except Exception as e:
                log.warning("task %s failed: %s", name, e)

    def stop(self) -> None:
        self._stop.set()
        for t in self._threads:
            t.join()
