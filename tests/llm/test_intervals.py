import random
import time

from twinframe.llm.intervals import Cover
from twinframe.llm.secrets import find_spans


def test_cover_equals_looking_at_all():
    rng = random.Random(1)
    for _ in range(200):
        cover, added = Cover(), []
        for _ in range(60):
            start = rng.randrange(40)
            end = start + rng.randrange(12)
            assert cover.holds(start, end) == any(s <= start and end <= e for s, e in added)
            if rng.random() < 0.6:
                cover.add(start, end)
                added.append((start, end))


def test_many_escaped_secrets_take_linear_time():
    secret = lambda k: "".join(f"%{b:02x}" for b in f"password={k:08d}".encode())
    seconds = []
    for n in (3000, 12000):
        text = " ".join(secret(k) for k in range(n))
        began = time.perf_counter()
        plain, found = find_spans(text)
        seconds.append(time.perf_counter() - began)
        assert not plain and len(found) == n
    assert seconds[1] < 8 * seconds[0]
