"""The prefix trie against a plain-Python one, and its SQL, on odd rows."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest

pytest.importorskip("daywheel.llm")
from daywheel.llm import catalog, trie

SCHEMA = "conv_id long, turn long, role string, text string, node int, pos int, size int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = collections.defaultdict(list)
    for c, n, role, text, *_ in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def sample(seed, convs=80):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-40, 400), convs):
        for n in range(rnd.choice([1, 2, 3, 6, 12])):
            rows.append((c, rnd.choice([n, n, None, 1]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a", "a", "b", "é", None, "", "ba", "x" * 300]), 1, 2, 3))
    return rows + rows[:7] + [(None, 0, "user", "lost", 1, 2, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, monkeypatch, seed):
    monkeypatch.setattr(trie, "RUN_BYTES", 8)
    rows = sample(seed)
    got = found(trie.build(trie.rebuild(trie.turns(spark.createDataFrame(rows, SCHEMA)))))
    assert got == brute(rows)


def test_sql_on_odd_rows():
    rows = sample(3)
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    result = con.sql(catalog.OP11_SQL)
    at = [result.columns.index(c) for c in COLUMNS]
    assert sorted(tuple(-1 if r[i] is None else r[i] for i in at) for r in result.fetchall()) == brute(rows)


def test_many_of_one_kind(spark, monkeypatch):
    """A third of all conversations alike, a first turn of nearly all, one long conversation, one without turns left."""
    monkeypatch.setattr(trie, "RUN_BYTES", 64)
    rows = [(c, n, "user", t, 0, 0, 0) for c in range(0, 3000, 5) for n, t in enumerate(["hi", "same" if c % 3 == 0 else f"own {c}", "end"])]
    rows += [(7, n, "user", f"turn {n}", 0, 0, 0) for n in range(900)]
    empty = next(c for c in range(10**6, 10**6 + 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows.append((empty, 0, "user", "dropped", 0, 0, 0))
    assert found(trie.build(trie.rebuild(trie.turns(spark.createDataFrame(rows, SCHEMA))))) == brute(rows)


def test_no_conversations(spark):
    assert trie.build(trie.rebuild(trie.turns(spark.createDataFrame([], SCHEMA)))).count() == 0
    assert trie.build(trie.rebuild(trie.turns(spark.createDataFrame([(None, 1, "a", "b", 1, 2, 3)], SCHEMA)))).count() == 0


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    result = con.sql(catalog.OP11_SQL)
    at = [result.columns.index(c) for c in COLUMNS]
    assert found(catalog.op11_conversation_trie(spark, folder)) == sorted(tuple(-1 if r[i] is None else r[i] for i in at) for r in result.fetchall())
