import pandas as pd

from cuelake.streaming.stitch import stepper


class State:
    """A medium's state as Spark keeps it between batches."""

    def __init__(self):
        self.value, self.hasTimedOut, self.wait = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.wait = value, None

    def remove(self):
        self.value, self.wait = None, None

    def setTimeoutDuration(self, ms):
        self.wait = ms


def run(state, rows=None, idle=1000):
    state.hasTimedOut = rows is None
    batch = [] if rows is None else [pd.DataFrame(rows, columns=["chunk_no", "start_ms", "end_ms", "is_last"])]
    (out,) = list(stepper(30_000, 100, 500, idle)(("m",), iter(batch), state))
    return [tuple(r) for r in out.itertuples(index=False)]


def test_numbers_go_on_after_a_pause():
    s = State()
    assert run(s, [(0, 0, 500, False), (0, 29_000, 29_950, False)]) == [("m", 0, 0, 500, 1)] and s.wait == 1000
    assert run(s) == [("m", 1, 29_000, 29_950, 1)] and s.wait is None
    assert run(s) == []
    # it would have continued the span that the pause has ended
    assert run(s, [(1, 30_000, 31_000, False)]) == [] and s.wait == 1000
    assert run(s, [(2, 65_000, 66_000, True)]) == [("m", 2, 30_000, 31_000, 1), ("m", 3, 65_000, 66_000, 1)]
    assert not s.exists


def test_a_pause_before_any_speech_and_an_end_after_a_pause():
    s = State()
    assert run(s) == [] and not s.exists
    run(s, [(0, 5, 10, False)])
    assert run(s) == [("m", 0, 5, 10, 1)]
    assert run(s, [(3, 90_000, 90_001, True)]) == [("m", 1, 90_000, 90_001, 1)] and not s.exists


def test_unordered_rows_of_a_batch_are_put_in_order():
    s = State()
    assert run(s, [(1, 30_010, 31_000, False), (0, 29_000, 30_000, False), (3, 95_000, 96_000, False)]) == [("m", 0, 29_000, 31_000, 2)]
