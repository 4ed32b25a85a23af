"""Live state: a bucket of (run, task) is one key of the state store."""

from __future__ import annotations

from pyspark.sql import Row

from runloom.streaming import live


class Value:
    """A value state that counts what is asked of it."""

    def __init__(self):
        self.kept, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.calls += 1
        self.kept = value

    def getValueState(self, name, schema):  # noqa: N802
        return self


def test_tasks_of_a_bucket_share_one_state():
    p, value, fact = live._processor(), Value(), Row(*live.TRANSITION.names)
    p.init(value)
    run = lambda *rows: [tuple(r) for r in p.handleInputRows((0,), iter([fact(*r) for r in rows]), None)]
    got = run(("r", "b", 1, "running"), ("r", "a", 0, "blocked"), ("r", "b", 0, "pending"), ("r", "b", 0, "failed"), (None, "a", 3, "succeeded"))
    assert sorted(got, key=str) == sorted([("r", "b", 0, "pending", None), ("r", "b", 1, "running", None), ("r", "a", 0, "blocked", None), (None, "a", 3, "succeeded", None)], key=str)
    assert value.calls == 2
    assert run(("r", "b", 1, "failed"), ("r", "a", 1, "running")) == [("r", "a", 1, "running", "blocked>running")]
    assert value.calls == 4
    assert run(("r", "b", 2, "pending")) == [("r", "b", 2, "pending", None)]  # running from the first batch
    assert run(("r", "a", 1, "running")) == [] and value.calls == 7
