import itertools
import os
import random
import threading
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparloom.llm import neardup as N
from sparloom.llm import q_neardup
from sparloom.session import cut


def brute(rows, t=0.7):
    sets = {i: {x[k : k + 8] for k in range(len(x) - 7)} for i, x in rows}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        u = len(sets[a] | sets[b])
        if u and len(sets[a] & sets[b]) >= t * u - 1e-9:
            out.add((a, b))
    return out


def recs(spark, rows):
    return cut(N.records(spark.createDataFrame(rows, "k string, text string, doc int, rep string"), "k", "text"))


def test_equals_brute_force_on_edits(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "rho"]
    rows = []
    for i in range(60):
        base = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.choice([3, 12, 40, 90])))
        rows.append((f"b{i:03}", base))
        for j in range(2):
            w = base.split(" ")
            for _ in range(rng.randrange(1, 1 + max(1, len(w) // 4))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((f"e{i:03}{j}", " ".join(w)))
    rows += [("dup1", rows[0][1]), ("dup2", rows[0][1]), ("s1", "tiny"), ("s2", "tiny"), ("e1", ""), ("e2", "")]
    got = {(r.id1, r.id2) for r in N.alike_pairs(recs(spark, [(k, v, 1, "x") for k, v in rows] + [("n", None, None, None), (None, "alpha beta gamma", 1, "")])).collect()}
    assert got == brute(rows)


def pairs_of(rows, links):
    """All alike pairs from memberships and the links between classes."""
    of = {}
    for r in rows:
        of.setdefault(r.class_id, []).append(r.id)
    out = {(a, b) for ids in of.values() for a, b in itertools.combinations(sorted(ids), 2)}
    return out | {(min(a, b), max(a, b)) for x, y in links for a in of[x] for b in of[y]}


def test_memberships_give_all_pairs_of_large_classes(spark):
    rows = [(f"k{i:03}", "the same text in every record", 0, "") for i in range(70)] + [(f"z{i:03}", "the same text in every records", 0, "") for i in range(3)] + [("other", "quite another line of words", 0, ""), ("tiny", "a", 0, ""), ("tiny2", "a", 0, "")]
    r = recs(spark, rows)
    got = N.memberships(r).collect()
    assert sorted(x.id for x in got) == sorted(k for k, *_ in rows)
    links = [(x.rep1, x.rep2) for x in N.similar_classes(cut(N.classes(r)).where("char_length(text) >= 8")).collect()]
    want = brute([(k, t) for k, t, *_ in rows])
    assert pairs_of([x for x in got if not x.id.startswith("tiny")], links) == want
    assert len({p for p in want if p[0][0] == p[1][0] == "k"}) == 2415
    degree = {k: sum(k in p for p in want) for k, *_ in rows}
    assert {x.id: x.links for x in got} == degree
    assert {x.id: x.group_id for x in got}["z002"] == "k000" and {x.id: x.group_id for x in got}["other"] == "other"
    star = {(x.id1, x.id2) for x in N.alike_pairs(r).collect()}
    assert star <= want and {("k000", f"k{i:03}") for i in range(1, 70)} <= star and ("z000", "z001") in star


@pytest.mark.parametrize("seed", range(3))
def test_sizes_across_modes_equal_brute_force(spark, seed):
    """Short, middle and long records with inserted, dropped and moved parts around the threshold."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(60)]
    rows = []
    for i in range(70):
        w = [rng.choice(words) for _ in range(rng.choice([2, 3, 5, 20, 26, 30, 40, 130, 180, 250]))]
        rows.append((f"b{i}", " ".join(w), 0, ""))
        for j in range(3):
            v = list(w)
            k = rng.randrange(len(v))
            cutting = max(1, int(len(v) * rng.choice([0.05, 0.15, 0.25, 0.3])))
            if j == 0:
                v = v[:k] + v[k + cutting :]
            elif j == 1:
                v = v[k:] + v[:k]
            else:
                v[k : k + cutting // 2] = [rng.choice(words) for _ in range(cutting // 2)]
            rows.append((f"e{i}_{j}", " ".join(v), 0, ""))
    got = {(r.id1, r.id2) for r in N.alike_pairs(recs(spark, rows)).collect()}
    assert got == brute([(k, t) for k, t, *_ in rows])


def test_empty(spark):
    assert N.alike_pairs(recs(spark, [])).count() == 0


def test_normal_text(spark):
    df = spark.createDataFrame([("Ä_b--C", None, "9 .")], "a string, b string, c string")
    assert df.select(N.normal_text(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "ä b c 9"


def test_chain_of_full_length_is_the_budget():
    rng = np.random.default_rng(0)
    d = rng.integers(0, 9, size=(500, 16)).astype(np.int64)
    b = rng.integers(20, 120, size=500)
    assert (N.chain_ok(d, b) == (d.sum(axis=1) <= b)).all()


def test_groups(spark):
    p = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("d", "c"), ("e", "d")], "id1 string, id2 string")
    assert {tuple(r) for r in N.groups(p).select("id", "group_id").collect()} == {(i, "a") for i in "abcde"} | {("x", "x"), ("y", "x")}


@pytest.mark.parametrize("name", sorted(q_neardup.QUERIES))
def test_queries_run(spark, small, name):
    assert q_neardup.QUERIES[name](spark, small).count() >= 0


def on_disk(*folders):
    total = 0
    for top in folders:
        for at, _, files in os.walk(top):
            for f in files:
                try:
                    total += os.stat(os.path.join(at, f)).st_blocks * 512
                except OSError:
                    pass
    return total


@pytest.mark.parametrize("way", [N.alike_pairs, N.memberships])
def test_disk_stays_within_four_times_the_input(spark, tmp_path, monkeypatch, way):
    """Shuffles, checkpoints and texts kept beside them, at their peak, against the table's Parquet."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(4000)]
    rows = []
    for i in range(4000):
        w = [rng.choice(words) for _ in range(70)]
        rows += [(f"a{i:05}", " ".join(w)), (f"b{i:05}", " ".join(w[:30] + w[31:]))]
    path = str(tmp_path / "in.parquet")
    spark.createDataFrame(rows, "k string, text string").repartition(2).write.parquet(path)
    monkeypatch.setattr(N, "ROUND_BYTES", 1, raising=False)
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()] + [spark.conf.get("spark.checkpoint.dir")]
    spark._jvm.System.gc()
    time.sleep(1)
    floor, peak, done = on_disk(*folders), [0], threading.Event()

    def watch():
        while not done.wait(0.05):
            peak[0] = max(peak[0], on_disk(*folders) - floor)

    seen = threading.Thread(target=watch)
    seen.start()
    try:
        way(N.records(spark.read.parquet(path), "k", "text")).write.format("noop").mode("overwrite").save()
    finally:
        done.set()
        seen.join()
    assert 0 < peak[0] <= 4 * on_disk(path)


def test_packed_numbers_come_back():
    a = np.array([5, 3, 2**40, -7, 2**40 + 1], dtype=np.int64)
    assert (N.unstepped(N.steps(a)) == a).all() and (N.unplaned(N.planes(a.astype(np.uint32)), np.uint32) == a.astype(np.uint32)).all()


def test_rounds_give_the_pairs_of_one(spark, monkeypatch):
    rng = random.Random(8)
    words = [rng.choice("abcdef") * 2 + str(k) for k in range(50)]
    rows = []
    for i in range(80):
        w = [rng.choice(words) for _ in range(rng.choice([6, 15, 40, 120]))]
        rows += [(f"a{i}", " ".join(w)), (f"b{i}", " ".join(w[3:] + w[:3])), (f"c{i}", " ".join(w[: int(len(w) * 0.8)]))]
    r = recs(spark, [(k, v, 0, "") for k, v in rows])
    for most in (1, 5, 8):
        monkeypatch.setattr(N, "plan", lambda *_, m=most: (m, 8))
        assert {(p.id1, p.id2) for p in N.alike_pairs(r).collect()} == brute(rows)
    assert not list(Path(spark.conf.get("spark.checkpoint.dir")).rglob("near-*"))
