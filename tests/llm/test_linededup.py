"""Deletions from grown cuckoo filters, and states that outgrow their layout."""

from collections import Counter

import numpy as np

from evbench.llm import linededup


def test_twins_of_two_tables_survive_each_other():
    f = linededup.CuckooFilter(keys=16)
    a, b = 0x1234 << 48 | 0b00101, 0x1234 << 48 | 0b10101
    f.add(a)
    f.tables.append(np.zeros_like(f.tables[0]))
    f.tables[1][b & 15, 0] = 0x1234  # b lies in the second table
    assert f.has(np.asarray([a, b])).all()
    assert f.remove(b) and f.has(np.asarray([a]))[0]
    assert f.remove(a) and not f.has(np.asarray([a]))[0]


def test_no_kept_key_is_lost_by_deletions():
    rng = np.random.default_rng(11)
    keys = rng.integers(-(2**63), 2**63 - 1, 200_000)
    keys[1000:2000] = keys[:1000] ^ (rng.integers(1, 64, 1000) << 12)  # the same fingerprint and low bits
    f = linededup.CuckooFilter(keys=40_000)
    for k in keys.tolist():
        f.add(k)
    assert len(f.tables) > 3 and f.has(keys).all()
    gone = rng.permutation(len(keys))[: len(keys) // 2]
    assert all(f.remove(k) for k in keys[gone].tolist())
    left = np.delete(keys, gone)
    f = linededup.CuckooFilter(blob=f.blob())
    assert f.has(left).all() and f.has(keys[gone]).mean() < 0.01
    again = keys[gone][:1000]
    for k in again.tolist():
        f.add(k)
    assert f.has(left).all() and f.has(again).all()


def verdicts(state, docs):
    return Counter(map(tuple, linededup.dedup(docs, state=state).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))


def test_a_state_that_outgrows_its_layout(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 20)
    monkeypatch.setattr(linededup, "FEWEST", 1)
    rows = [(i, "\n".join(f"a line that is number {(i * k) % 211}" for k in range(1, 9))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    state = linededup.build(docs.where("doc_id < 4"))
    first = state.shards
    for lo, hi in ((4, 10), (10, 60), (60, 120)):
        state = linededup.insert(state, docs.where(f"doc_id between {lo} and {hi - 1}"))
    assert state.shards > first
    assert verdicts(state, docs) == verdicts(linededup.build(docs), docs)
    left = docs.where("doc_id % 3 <> 0")
    state = linededup.delete(state, docs.where("doc_id % 3 = 0").select("doc_id"))
    assert verdicts(state, left) == verdicts(linededup.build(left), left)
    state = linededup.insert(state, docs.where("doc_id % 3 = 0"))
    assert verdicts(state, docs) == verdicts(linededup.build(docs), docs)
