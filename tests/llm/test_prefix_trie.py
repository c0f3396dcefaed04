"""The conversation trie against one that lists every node, and its ranges against one another."""

import hashlib
import random
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidestat.llm import prefix_trie, queries

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(full):
    """Rows of NAMES from {conv: [(turn, bytes), ...]}."""
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(t for t, _ in turns[:d]), []).append(c)
    size = {tuple(t for t, _ in turns[:d]): turns[d - 1][1] if d else 0 for turns in full.values() for d in range(len(turns) + 1)}
    kids, sub = {}, {}
    for k, members in nodes.items():
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            n, s = sub.get(k[:d], (0, 0))
            sub[k[:d]] = n + (k not in kids), s + (len(members) - 1) * size[k]
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids.get(k, 0), *sub[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def turns_of(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn, digest(role or "", text or ""), len((text or "").encode())))
    return {c: [(t[2], t[3]) for t in sorted(v, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, v in by.items()}


def rebuild(by):
    out = {}
    for c, own in by.items():
        g, h = c - (abs(c) % 5) * (1 if c > 0 else -1), zlib.crc32(str(c).encode()) % 9
        out[c] = own if g == c else by.get(g, [])[:h] + own[h:]
    return out


def got(df):
    return sorted(((*r,) for r in df.select(*NAMES).collect()), key=str)


def rows_of(rng, n, copies):
    words = ["a", "b", "é日", "", "a b", None]
    rows = []
    for c in range(-7, n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([0, 1, 2, 3, 8, 12])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(words)))
    rows += [(1000 + c, t, "user", "same" if t < 9 else f"own {c}") for c in range(copies) for t in range(10)]
    rows += [(c, 0, "user", "hot") for c in range(3000, 3000 + copies)]
    rows += [(None, 1, "user", "nobody"), (5, 2, "user", "x"), (5, 2, "user", "x"), (7, 1, "x" * 5000, "y" * 50_000)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, Depth int, KEY string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = rows_of(random.Random(1), 120, 40)
    base, kept = F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    assert got(prefix_trie.prefix_trie(frame(spark, rows), base, kept)) == brute(rebuild(turns_of(rows)))
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == brute(turns_of(rows))
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_holders_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)
    rows = rows_of(random.Random(2), 60, 20)
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == brute(turns_of(rows))


def test_turnless_conversations(spark):
    rows = [(11, 0, "user", "a"), (12, 0, "user", "a"), (12, 1, "user", "b")]  # bases are absent
    full = rebuild(turns_of(rows))
    base, kept = F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    assert [] in full.values()
    assert got(prefix_trie.prefix_trie(frame(spark, rows), base, kept)) == brute(full)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), max_size=14), st.lists(st.integers(0, 14), max_size=4))
def test_ranges_add_up(convs, cuts):
    """However the sorted paths are cut into ranges, the nodes are the same."""
    full = {c: [(t, 3 + ord(t)) for t in turns] for c, turns in enumerate(convs)}
    paths = {}
    for c, turns in full.items():
        key = b"".join(t.encode() * prefix_trie.STEP for t, _ in turns)
        paths.setdefault(key, (b"".join(n.to_bytes(8, "little") for _, n in turns), []))[1].append(c)
    order, edges = sorted(paths), sorted({0, len(paths), *(x for x in cuts if x < len(paths))})
    inside, spine = [], {}
    for lo, hi in zip(edges, edges[1:]):
        tree = prefix_trie.Patricia()
        for k in order[lo:hi]:
            sizes, members = paths[k]
            tree.add(k, sizes, len(members), min(members), hashlib.sha256(",".join(map(str, sorted(members))).encode()).hexdigest())
        tree.finish()
        for key, above, size, conv, depth, parent, n, kids, leaves, saved, ends in tree.rows:
            if key is None:
                inside.append((conv, depth, parent, n, kids, leaves, saved, ends, above))
            else:
                old = spine.get(key, (above, size, conv, depth, None, 0, 0, 0, 0, None))
                spine[key] = (above, size, min(conv, old[2]), depth, None, n + old[5], kids + old[6], leaves + old[7], saved + old[8], ends or old[9])
    import pyarrow as pa

    names = [n for n, _ in prefix_trie._KINDS]
    rows = [(k, *v) for k, v in spine.items()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(prefix_trie._KINDS)], names=names)
    whole = {r["key"]: r for b in prefix_trie._backbone(iter([batch] if rows else [])) for r in b.to_pylist()}
    out = [tuple(r[n] for n in NAMES) for r in whole.values()]
    out += [(*r[:2], whole[r[8]]["conv_id"] if r[8] is not None else r[2], *r[3:8]) for r in inside]
    assert sorted(out, key=str) == brute(full)


def test_query(spark, small):
    out = queries.op12_conversation_trie(spark, small)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    want = con.execute(queries.ORACLE["op12_conversation_trie"])
    assert sorted(c[0] for c in want.description) == sorted(NAMES) == sorted(out.columns)
    order = [[c[0] for c in want.description].index(n) for n in NAMES]
    assert got(out) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(out) == brute(rebuild(turns_of(rows)))
