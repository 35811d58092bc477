import pytest

from tablemill.operators.failover import FailoverClient, Model, backoff
from tablemill.operators.infer import ApiError
from tablemill.plans import progress


class Named:
    def __init__(self, name, fails=0):
        self.name, self.fails, self.calls = name, fails, 0

    def call(self, messages, model, temperature):
        self.calls += 1
        if self.calls <= self.fails:
            raise RuntimeError(self.name)
        return f"{self.name} {model} {temperature}"


def client(*models, now):
    return FailoverClient(models, clock=lambda: now[0])


def test_asked_for_or_by_weight():
    now = [0.0]
    c = client(Model("1", Named("a"), 50, name="small", model="s"), Model("2", Named("b"), 50, name="big", model="s"), Model("3", Named("c"), 0), now=now)
    assert c.call([], "small", None) == "a s 0.7" and c.call([], "s", 0.1) == "b s 0.1"
    assert {c.call([], "auto", None)[0] for _ in range(16)} == {"a", "b"}
    assert c.call([], "3", None)[0] in "ab"  # without a weight it is never used
    with pytest.raises(ApiError, match="no model is available"):
        [c.call([], "auto", None) for _ in range(5)]  # all tokens are gone
    now[0] = 1.0
    assert [c.call([], "big", None)[0] for _ in range(5)] == ["b"] * 5


def test_failing_models_are_left_alone_for_a_while():
    now = [0.0]
    a, b = Named("a", fails=2), Named("b")
    c = client(Model("1", a, 50), Model("2", b, 50), now=now)
    assert c.call([], "1", None)[0] == "b" and a.calls == 1
    assert c.call([], "1", None)[0] == "b" and a.calls == 1
    now[0] = 2.0
    assert c.call([], "1", None)[0] == "b" and a.calls == 2
    now[0] = 5.9
    assert c.call([], "1", None)[0] == "b" and a.calls == 2
    now[0] = 6.0
    assert c.call([], "1", None)[0] == "a"
    assert [(s["ok"], s["errors"], s["fails"]) for s in c.stats()] == [(1, 2, 0), (4, 0, 0)]


def test_three_attempts_at_most():
    all_ = [Named(str(k), fails=9) for k in range(5)]
    with pytest.raises(ApiError, match="could answer"):
        client(*[Model(n.name, n, 50) for n in all_], now=[0.0]).call([], "", None)
    assert sum(n.calls for n in all_) == 3
    assert [backoff(n) for n in (0, 1, 3, 4, 20)] == [0, 2, 6, 8, 60]
    with pytest.raises(ValueError):
        FailoverClient([])


def test_progress_file(tmp_path):
    path = str(tmp_path / "p.json")
    assert progress.read(path) is None
    progress.report(path, 100, 50, 2, "1/4", now=10.0)
    said = progress.read(path, now=20.0)
    assert (said["percent"], said["active"], said["stale"]) == (50.0, 50, False) and progress.read(path, now=99.0)["stale"]
    progress.report(path, 0, 0)
    assert progress.read(path)["percent"] == 100.0 and [x.name for x in tmp_path.iterdir()] == ["p.json"]
    progress.clear(path)
    progress.clear(path)
    assert progress.read(path) is None
