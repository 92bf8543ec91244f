import random
import zlib
from collections import Counter

from thresher.llm import sharding as S
from thresher.llm.shared import shared_dir


def test_laws(spark, documents):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(2000)) for i in range(4000)] + [(1, "é"), (1, "é"), (None, None), (None, "t"), (9, ""), (10, "y" * 30_000)]
    path = f"{shared_dir(spark)}/test-map"
    got = S.shard(documents(rows), path).collect()
    assert len(got) == len(rows)
    of = Counter((d, t) for d, t in rows)
    text = {}
    for d, t in of:
        text[d, (len(t.encode()) if t is not None else 0) + 8] = t
    load, places = Counter(), {}
    for r in got:
        t = text[r.doc_id, r["size"]] if (r.doc_id, r["size"]) in text else None
        assert r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert set(load) == set(range(24))
    assert max(load.values()) - min(load.values()) <= 0.005 * sum(load.values()) / 24
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    maps = S.SlotMap(spark, path)
    one, two = ({r.slot: r.shard for r in maps.read(v).collect()} for v in (1, 2))
    assert one == S.first_map(24) and len(two) == S.SLOTS
    held = {r.virtual_slot: r["shard"] for r in got}
    assert all(two[s] == x for s, x in held.items())
    again = {(r.doc_id, r["size"], r["shard"], r["slot"]) for r in S.shard(documents(rows), f"{path}-2").collect()}
    assert again == {(r.doc_id, r["size"], r["shard"], r["slot"]) for r in got}


def test_equal_rows_spread(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "COPIES", 64)  # several blocks of one row
    rows = [(i, "x" * (i % 90)) for i in range(2000)] + [(7, "y" * 100)] * 1000 + [(None, None)] * 300
    path = f"{shared_dir(spark)}/test-map-5"
    got = S.shard(documents(rows), path).collect()
    assert len(got) == len(rows)
    want = Counter((d, (len(t) if t is not None else 0) + 8) for d, t in rows)
    assert Counter((r.doc_id, r["size"]) for r in got) == want
    load, places, slots = Counter(), {}, Counter()
    for r in got:
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
        slots[r.doc_id, r["size"], r.virtual_slot] += 1
    share = sum(load.values()) / 24
    assert len(load) == 24 and max(load.values()) - min(load.values()) <= 0.01 * share
    assert slots.most_common(1)[0][1] == 1
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_stored_map_is_edited(spark, documents):
    path = f"{shared_dir(spark)}/test-map-6"
    rows = [(i, "x" * (i % 90)) for i in range(1000)]
    one = {r.doc_id: r["shard"] for r in S.shard(documents(rows), path).collect()}
    more = {r.doc_id: r["shard"] for r in S.shard(documents(rows + [(2000, "z" * 500)]), path).collect()}
    maps = S.SlotMap(spark, path)
    assert maps.last() == 3
    two, three = ({r.slot: r.shard for r in maps.read(v).collect()} for v in (2, 3))
    assert len(list(S.moved(two, three))) < 60 and sum(one[d] != more[d] for d in one) < 60


def test_new_shard_takes_only_into_itself():
    rng = random.Random(1)
    size = {s: rng.randrange(1, 1000) for s in range(S.SLOTS)}
    held = S.rebalanced(S.first_map(24), size, 24)
    more = S.grown(held, size, 24)
    assert {more[s] for s in S.moved(held, more)} == {24}
    load = S.shard_loads(more, size, 25)
    assert abs(load[24] - sum(load) / 25) <= 0.02 * sum(load) / 25


def test_rebalancing_moves_little():
    size = dict.fromkeys(range(S.SLOTS), 100)
    held = S.rebalanced(S.first_map(24), size, 24)
    size[0] = 5000
    after = S.rebalanced(held, size, 24)
    load = S.shard_loads(after, size, 24)
    assert len(list(S.moved(held, after))) < 120 and max(load) - min(load) <= 200


def test_empty_table(spark, documents):
    assert S.shard(documents([]), f"{shared_dir(spark)}/test-map-3").collect() == []


def test_many_pieces_of_a_slot(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 0.01)
    got = S.shard(documents([(i, "abc") for i in range(500)]), f"{shared_dir(spark)}/test-map-4").collect()
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
