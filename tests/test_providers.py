"""Provider calls: failures are outlasted, nothing is asked twice, waits grow."""

import os
from random import Random

import pytest

from tessera.operators import graph as G
from tessera.operators import providers as P
from tessera.sources.store import Store


def recording(folder, fails):
    """A provider that leaves a file for each call and fails as ``fails(call number of this batch, texts)`` says."""

    def provider(texts):
        name = "|".join(sorted(texts))
        calls = sum(f.startswith(name + "#") for f in os.listdir(folder))
        open(os.path.join(folder, f"{name}#{calls}"), "w").close()
        fails(calls, texts)
        return [t.upper() for t in texts]

    return provider


def asked(folder):
    out = {}
    for f in os.listdir(folder):
        for t in f.split("#")[0].split("|"):
            out[t] = out.get(t, 0) + 1
    return out


def table(spark, n=40):
    return spark.createDataFrame([(k, f"t{k}") for k in range(n)] + [(3, "t3"), (99, None)], "key long, text string")


def test_two_runs_give_a_whole_table_and_ask_nothing_twice(spark, tmp_path):
    calls, store = str(tmp_path / "calls"), Store(spark, str(tmp_path / "s"))
    os.mkdir(calls)

    def one_in_five(_, texts):
        if any(int(t[1:]) % 5 == 0 for t in texts):
            raise P.Refused("not now")

    first = {r.key: (r.response, r.error) for r in P.call_through(table(spark), recording(calls, one_in_five), store, batch=1, first_wait=0.01, wave=15).collect()}
    assert all(first[k] == ((None, "Refused: not now") if k % 5 == 0 else (f"T{k}", None)) for k in range(40)) and first[99] == (None, None)
    second = {r.key: (r.response, r.error) for r in P.call_through(table(spark), recording(calls, lambda *_: None), store, batch=4).collect()}
    assert all(second[k] == (f"T{k}", None) for k in range(40)) and len(second) == 41
    assert asked(calls) == {f"t{k}": 2 if k % 5 == 0 else 1 for k in range(40)}
    P.call_through(table(spark), recording(calls, lambda *_: None), store).collect()
    assert sum(asked(calls).values()) == 48


def test_retries_end_when_a_call_succeeds_or_attempts_do(spark, tmp_path):
    calls, store = str(tmp_path / "calls"), Store(spark, str(tmp_path / "s"))
    os.mkdir(calls)

    def flaky(call, texts):
        if call < int(texts[0][1:]):
            raise TimeoutError("slow")

    got = {r.key: r.response for r in P.call_through(table(spark, 5), recording(calls, flaky), store, batch=1, attempts=3, first_wait=0.01).collect()}
    assert got == {0: "T0", 1: "T1", 2: "T2", 3: None, 4: None, 99: None}
    assert asked(calls) == {"t0": 1, "t1": 2, "t2": 3, "t3": 3, "t4": 3}


def test_wrong_numbers_of_answers_and_empty_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    got = P.call_through(table(spark, 2), lambda texts: ["one too many"] * (len(texts) + 1), store, first_wait=0.01).collect()
    assert all(r.response is None for r in got) and sum(r.error is not None for r in got) == 3  # keys 0, 1 and 3
    assert P.call_through(table(spark, 2).limit(0), len, Store(spark, str(tmp_path / "e"))).count() == 0


def test_waits_grow_with_jitter():
    w = list(P.waits(5, 1.0, Random(1)))
    assert len(w) == 4 and all(2**k <= x <= 1.5 * 2**k for k, x in enumerate(w)) and list(P.waits(1, 1.0, Random(1))) == []


@pytest.mark.parametrize("limit", [1, 7, 30, 10_000])
def test_a_limited_walk_touches_no_more_than_its_budget(spark, monkeypatch, limit):
    rng = Random(2)
    edges = sorted({(f"n{rng.randrange(60)}", "R", f"n{rng.randrange(60)}") for _ in range(400)})
    degree = {f"n{k}": sum(f"n{k}" in (a, b) for a, _, b in edges) for k in range(60)}
    df, seeds = spark.createDataFrame(edges, "source string, rel string, target string"), spark.createDataFrame([("n1",), ("n2",), ("none",)], "id string")
    touched, real = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df, name: touched.append(real(df, name)) or touched[-1])
    nodes, found = G.neighbors(df, seeds, hops=2, direction="both", limit=limit)
    walked = sum(t.count() for t in touched)
    assert found.count() == min(limit, walked) and walked <= limit + max(degree.values()) + 60
    assert {r.id for r in nodes.collect()} >= {"n1", "n2"}


def test_waves_do_not_each_append_to_the_store(spark, tmp_path, monkeypatch):
    store, appended, real = Store(spark, str(tmp_path / "s")), [], Store.append
    monkeypatch.setattr(Store, "append", lambda self, name, *a, **k: appended.append(name) or real(self, name, *a, **k))
    got = P.call_through(table(spark), lambda texts: [t.upper() for t in texts], store, batch=1, wave=4)
    assert {r.key: r.response for r in got.collect()} == {**{k: f"T{k}" for k in range(40)}, 99: None}
    assert len(appended) <= 2


def test_a_lost_run_asks_at_most_about_a_wave_again(spark, tmp_path):
    calls, store = str(tmp_path / "calls"), Store(spark, str(tmp_path / "s"))
    os.mkdir(calls)

    def lost(_, texts):
        if "t37" in texts:
            os._exit(1)

    with pytest.raises(Exception):
        P.call_through(table(spark), recording(calls, lost), store, batch=1, wave=4)
    second = {r.key: r.response for r in P.call_through(table(spark), recording(calls, lambda *_: None), store, batch=1, wave=4).collect()}
    assert all(second[k] == f"T{k}" for k in range(40))
    again = asked(calls)
    assert set(again) == {f"t{k}" for k in range(40)} and sum(n - 1 for n in again.values()) <= 8
