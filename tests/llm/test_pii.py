import random
import re

import numpy as np

from threadloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_against_the_plain_patterns():
    r = random.Random(5)
    for alphabet in ("a@.-b ", "0123.. ", "01 -2345", "+1 ()-.2 ", "a1@.+- 23é"):
        for _ in range(3000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(t) == brute(t), t
    t = "4539 1488 0343 6467, +1 (456) 555-2186, 10.0.0.255 10.0.0.256 a.b+c@d-e.f.g. 4539148803436468"
    assert pii.base_spans(t) == brute(t) and {k for k, _, _ in brute(t)} == set(pii.BASE_KINDS)


def test_long_runs_are_read_once():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a.b@" * 50_000, "+1" + "(" * 100_000, "+" * 100_000):
        pii.base_spans(t)
        pii.candidates(t)


def test_trees_learn_and_thresholds_hold():
    g = np.random.default_rng(1)
    x = g.normal(size=(3000, 6))
    y = ((x[:, 1] > 0) & (x[:, 3] < 0.5)).astype(float)
    b = pii.Booster().fit(x[:2000], y[:2000])
    assert ((b.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def sample():
    r = random.Random(7)
    rows = []
    for i in range(900):
        secret = "".join(r.choice("0123456789abcdef") for _ in range(40))
        tail = r.choice([f'token = "{secret}" end', f"page {r.randrange(10**8)} of it", f"call +1 (456) 555-{r.randrange(1000, 9999)}", "version 1.2.3.4444 of 20240101", f"mail ab{i}@host.example.com"])
        rows.append((i, f"some words here é {tail} and more"))
    return rows


def test_detection_end_to_end(spark):
    rows = sample() + [(2000, None), (2001, ""), (2002, "clean words only"), (2003, "x " * 100_000 + "me@host.org"), (2003, "again 1.2.3.4"), (None, "a@b.cd")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string")
    model = pii.fit(df)
    assert "secret" in model.thresholds
    got = pii.detected(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute(r.text or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in pii.BASE_KINDS)
        assert all(s in r.spans.split(",") for s in pii.joined(base).split(",") if s)
        if r.text and "token =" in r.text:
            assert "secret:" in r.spans
        if r.doc_id in (2000, 2001, 2002):
            assert r.spans == ""
    assert pii.detected(df.limit(0), model).count() == 0
    assert pii.fit(df.limit(0)).thresholds == {}


def test_redaction(spark):
    df = spark.createDataFrame([("mail me@host.org now", "email:5:16"), (None, ""), ("x", "")], "text string, spans string")
    assert [r[0] for r in df.select(pii.redacted(df["text"], df["spans"])).collect()] == ["mail [email] now", None, "x"]


def test_long_texts_full_of_candidates_take_linear_time():
    import time

    one = "token=abc123def456ghi789 call 555-123-4567 at 10.0.0.1, bob at mail dot example dot com; "
    model = pii.Model(pii.Booster(), {})
    took = []
    for n in (500, 8000):
        began = time.process_time()
        (base, every), = model.spans([one * n])
        took.append(time.process_time() - began)
        assert len(base) >= n and len(every) > len(base)
    assert took[1] < 16 * 3 * max(took[0], 0.05)


def test_what_lies_within_a_base_span():
    spans = [("email", 5, 20), ("ip", 8, 12), ("card", 30, 40)]
    covered = pii.Covered(spans)
    for a in range(45):
        for z in range(a + 1, 46):
            assert covered(a, z) == any(b <= a and z <= y for _, b, y in spans)
