"""What Python workers keep between tasks."""

from __future__ import annotations

import sys

import pyarrow as pa

from siftwork.llm import worker


class _Task:
    def __init__(self, stage: int):
        self.stage = stage

    def stageId(self) -> int:  # noqa: N802
        return self.stage


def _in_stage(monkeypatch, stage: int) -> None:
    monkeypatch.setattr(worker.TaskContext, "get", classmethod(lambda cls: _Task(stage)))


def test_values_are_kept_for_the_tasks_of_one_stage(monkeypatch):
    monkeypatch.setitem(sys.__dict__, "_siftwork_llm_memo", {})
    _in_stage(monkeypatch, 1)
    first = worker.memo("cache", dict)
    assert worker.memo("cache", dict) is first
    _in_stage(monkeypatch, 2)
    assert worker.memo("cache", dict) is not first


def test_a_stage_that_keeps_nothing_lets_go_of_what_others_kept(monkeypatch):
    monkeypatch.setitem(sys.__dict__, "_siftwork_llm_memo", {})
    _in_stage(monkeypatch, 1)
    worker.memo("cache", dict)["a"] = 1
    _in_stage(monkeypatch, 2)
    list(worker.slices(pa.record_batch({"text": pa.array(["a"])}), "text"))
    _in_stage(monkeypatch, 1)
    assert worker.memo("cache", dict) == {}
