"""Every added kind has a rule, whatever the sample holds."""

from threadloom.llm import pii

LONG = "a1" * 150
RARE = {
    1: ("reach me at bob (at) host (dot) org please", "email_spelled"),
    2: ("node 2001:0db8:0000:0000:0000:ff00:0042:8329 is up", "ipv6"),
    3: ("my SSN 078-05-1120 leaked", "id_number"),
    4: ("call 415-555-2671 now", "id_number"),
    5: (f'token = "{LONG}" end', "secret"),
    6: (f"dump {'0f' * 128} end", "secret"),
}


def test_rare_kinds_are_found(spark):
    rows = [(n, t) for n, (t, _) in RARE.items()] + [(100 + n, f"page {n * 7919 % 10**8:08d} of version 1.2.3") for n in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.detected(df, pii.fit(df)).collect()}
    for n, (_, kind) in RARE.items():
        if n != 6:
            assert f"{kind}:" in got[n], n
    assert f"secret:9:{9 + len(LONG)}" in got[5]
    assert not any(got[n] for n in got if n >= 100)
    assert ("secret", 5, 261) in pii.candidates(RARE[6][0])


def test_rules_decide_without_a_model():
    found = pii.Model(pii.Booster(), {}).spans([t for t, _ in RARE.values()])
    assert [kind in {k for k, _, _ in every} for (_, every), (n, (_, kind)) in zip(found, RARE.items(), strict=True) if n != 6] == [True] * 5


def test_rare_texts_are_in_the_sample(spark):
    rows = [(n, f"page {n:08d} of it") for n in range(2000)] + [(5000 + n, f"write to user{n} (at) host (dot) org") for n in range(60)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"), sample_texts=100)
    x = pii.features(rows[-1][1], *[c for c in pii.candidates(rows[-1][1]) if c[0] == "email_spelled"][0])
    assert model.booster.predict(pii.np.array([x]))[0] > 0.5
