"""The streaming limiter keeps many pairs in one group of state."""

import random

import pandas as pd

from colectivo.streaming import notifications


class State:
    """What ``_limit`` asks of a group's state."""

    def __init__(self):
        self.get, self.watermark, self.hasTimedOut = None, 0, False

    exists = property(lambda self: self.get is not None)

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark
        self.timeout = at


def test_pairs_of_a_bucket_do_not_mix():
    rng, hour = random.Random(2), 3_600_000_000
    events = sorted((rng.randint(0, 240) * hour, k, f"{rng.randint(0, 12)}/{rng.randint(0, 1)}") for k in range(600))
    state, got = State(), {}
    for i in range(0, 600, 100):
        part = events[i : i + 100]
        frame = pd.DataFrame([(p, True, k, t) for t, k, p in part], columns=["pair", "has_id", "event_id", "sent_us"]).sample(frac=1, random_state=i)
        state.watermark = max(0, part[0][0] // 1000 - 1)
        for out in notifications._limit((0,), iter([frame[:50], frame[50:]]), state):
            got |= dict(zip(out["event_id"], out["decision"]))
    want, sends = {}, {}
    for t, k, p in events:
        want[k], *sends[p] = notifications.decide(t, *sends.get(p, ([], [])))
    assert got == want and set(want.values()) == {"individual", "coalesced", "skipped"}
    # Past a day after the last send nothing is remembered.
    state.watermark, state.hasTimedOut = state.timeout, True
    assert list(notifications._limit((0,), iter([]), state)) == [] and not state.exists
