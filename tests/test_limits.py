import pytest

from orthostat.limits import QuotaExceeded, RateLimiter, retry_delay, with_retry


class Clock:
    def __init__(self):
        self.now, self.slept = 1_000_000.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def test_minute_window():
    c = Clock()
    limiter = RateLimiter(2, 100, clock=c, sleep=c.sleep)
    limiter.acquire()
    c.now += 10
    limiter.acquire()
    assert limiter.wait_time() == 50
    limiter.acquire()
    assert c.slept == [50] and limiter.statistics() == {"minute": 2, "day": 3, "minute_left": 0, "day_left": 97}


def test_day_quota():
    c = Clock()
    limiter = RateLimiter(10, 2, clock=c, sleep=c.sleep)
    limiter.acquire()
    limiter.acquire()
    with pytest.raises(QuotaExceeded):
        limiter.acquire()
    c.now += 86_400 - 100
    limiter.acquire()
    assert c.slept == [100]


def test_state(tmp_path):
    c, path = Clock(), str(tmp_path / "state.json")
    RateLimiter(10, 5, path, c).acquire()
    again = RateLimiter(10, 5, path, c)
    assert again.statistics()["day"] == 1 and again.reset().endswith(".bak") and again.statistics()["day"] == 0
    (tmp_path / "state.json").write_text("broken")
    assert RateLimiter(10, 5, path, c).statistics()["day"] == 0


def test_retry():
    slept, calls = [], []

    @with_retry(retries=2, base=2.0, sleep=slept.append)
    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("'retryDelay': '1500ms'" if len(calls) == 1 else "no hint")
        return "done"

    assert call() == "done" and slept[0] == 1.5 and 4 <= slept[1] <= 6

    @with_retry(retries=1, sleep=slept.append)
    def fails():
        raise ValueError("x")

    with pytest.raises(ValueError):
        fails()
    assert retry_delay("Please retry in 3.5s.") == 3.5 and retry_delay("x") is None
