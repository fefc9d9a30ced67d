"""The operators on conversations and the join by token groups, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cladeworks.llm import prefix_trie, repair, token_groups
from cladeworks.llm.catalogue import ORACLE_SQL, QUERIES
from tests.conftest import rows as comparable

SCHEMA = "conv_id long, turn long, role string, text string"
CLASHES = ("d", "place", "part", "times", "hit", "key", "shard", "h", "lender", "words", "turn_key", "first_turn", "fault", "edit")


def convs(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    for c in CLASHES:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


def odd_rows():
    """Nulls in every column, empty, blank and long texts, shared beginnings, copies, ties and repeated rows."""
    rng, data = random.Random(3), []
    opening = [("system", "Be brief."), ("user", "How are you?"), ("assistant", "Fine.")]
    for c in [*range(0, 64), 1000, 10**12, -7, -40]:
        turns = opening[: rng.randint(0, 3)] + [(rng.choice(("user", "assistant", "tool", "", None)), rng.choice(("a b.", "c", "", None, " \t", "d!", "e  f\ng?"))) for _ in range(rng.randint(0, 4))]
        data += [(c, i, *t) for i, t in enumerate(turns)]
    data += [(70, None, "user", "no turn"), (70, 5, "user", "no turn"), (71, 1, "user", "tie b"), (71, 1, "user", "tie a"), (72, 1, "user", "twice."), (72, 1, "user", "twice."), (None, 1, "user", "no id."), (None, None, None, None)]
    data += [(80, i, "ua"[i % 2] + "x", f"turn {i}.") for i in range(300)] + [(81, 0, "user", "long " * 200_000 + ".")]
    rng.shuffle(data)
    return data


def ordered(data, null):
    md5 = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    out = defaultdict(list)
    fill = lambda v: null if v is None else v
    for c, t, r, x in sorted(((c, t, fill(r), fill(x)) for c, t, r, x in data), key=lambda v: (v[1] is not None, v[1] or 0, v[2], md5(v[2], v[3]))):
        out[c].append((t, r, x))
    return out


def brute_trie(data):
    own = ordered([r for r in data if r[0] is not None], "")
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        paths[c] = tuple(x[1:] for x in own.get(base, [])[:h]) + tuple(x[1:] for x in turns[h:])
    members = defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in m if len(paths[c]) == len(p)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie(spark):
    data = odd_rows()
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(convs(spark, data)))
    assert sorted((tuple(r) for r in got.select(*NODE).collect()), key=str) == sorted(brute_trie(data), key=str)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(convs(spark, []))).count() == 0


def test_trie_shards(monkeypatch):
    """Shards of three conversations hold the nodes that bitmaps of all do."""
    import pyarrow as pa

    rng = random.Random(5)
    data = [(c, bytes([rng.randint(0, 2)]) * 16, 1) for c in range(50) for _ in range(rng.randint(1, 5))]
    batch = pa.record_batch([pa.array(v) for v in zip(*data, strict=True)], names=["conv_id", "turn_key", "words"])
    total = []
    for size in (3, 1000):
        monkeypatch.setattr(prefix_trie, "SHARD", size)
        nodes = defaultdict(lambda: [0, []])
        for b in prefix_trie._tries([batch.slice(0, 7), batch.slice(7)]):
            for r in b.to_pylist():
                nodes[r["key"]][0] += r["n"]
                nodes[r["key"]][1] += (r["ends"] or "").split(",") if r["ends"] else []
        total.append({k: (n, sorted(map(int, e))) for k, (n, e) in nodes.items()})
    assert total[0] == total[1] and len(total[0]) > 20


def cheapest(rows):
    """Cost and edits by trying all of them: the least (cost, text) for each place and state, texts compared whole."""
    import heapq

    follows, done, heap = repair.FOLLOWS, {}, [(0, "", 0, 0)]
    while heap:
        cost, text, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done[i, q] = (cost, text)
        for r in "ua":
            if r in follows[q]:
                heapq.heappush(heap, (cost + 5, text + "I", i, follows[q][r]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 2, text + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                cost += 5 * (fault == "truncated")
                if initial in follows[q]:
                    heapq.heappush(heap, (cost, text + "K", i + 1, follows[q][initial]))
                for r in "ua":
                    if r in follows[q]:
                        heapq.heappush(heap, (cost + 1, text + "R", i + 1, follows[q][r]))
    return min(done[len(rows), q] for q in (0, 3) if (len(rows), q) in done)


def every(rows):
    """The same by listing all edits with up to two insertions at a place."""
    found = []

    def go(i, q, cost, text, inserted):
        if i == len(rows) and q in (0, 3):
            found.append((cost, text))
        for r in "ua" if inserted < 2 else "":
            if r in repair.FOLLOWS[q]:
                go(i, repair.FOLLOWS[q][r], cost + 5, text + "I", inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, q, cost + 2, text + "D", 0)
            if fault not in ("blank", "duplicate"):
                cost += 5 * (fault == "truncated")
                if initial in repair.FOLLOWS[q]:
                    go(i + 1, repair.FOLLOWS[q][initial], cost, text + "K", 0)
                for r in "ua":
                    if r in repair.FOLLOWS[q]:
                        go(i + 1, repair.FOLLOWS[q][r], cost + 1, text + "R", 0)

    go(0, 0, 0, "", 0)
    return min(found)


def searched(rows):
    search = repair.Repair()
    return "".join(e for i, r in enumerate(rows) for e, _ in search.add(i, *r)) + "".join(e for e, _ in search.end())


def test_search():
    kinds = list(itertools.product(("s", "u", "a", ""), ("", "blank", "truncated")))
    for rows in itertools.chain.from_iterable(itertools.product(kinds, repeat=n) for n in range(3)):
        assert searched(rows) == cheapest(rows)[1] == every(rows)[1]
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice("suaua") if rng.random() < 0.9 else "", rng.choice(("", "", "blank", "duplicate", "truncated"))) for _ in range(rng.randint(3, 14))]
        assert searched(rows) == cheapest(rows)[1]


def test_search_forgets():
    """What survivors agree on is given out: of 50,000 rows a few are held. Rows on which they never agree are held, and right."""
    rng, search, given = random.Random(2), repair.Repair(), 0
    for i in range(50_000):
        given += len(search.add(i, "ua"[i % 2] if rng.random() < 0.9 else "a", rng.choice(("", "", "", "truncated"))))
        assert i + 1 - given < 100
    tied = [("", "")] * 41
    assert searched(tied) == cheapest(tied)[1]


def brute_report(data):
    out = []
    for c, turns in ordered(data, " ").items():
        rows = []
        for t, r, x in turns:
            z = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            x = "" if z == 1 else re.sub("[.!?]", "", x) if z == 2 else x
            rows += [(t, "user" if z == 4 else r, x)] * (0 if z == 0 else 2 if z == 3 else 1)
        rows.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.md5(f"{len(v[1])}:{v[1]}{v[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, r, x in rows:
            bare = re.sub(r"[\x20\x09-\x0D]", "", x)
            faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((r, x))
        known = [t for t, _, _ in rows if t is not None]
        cost, audit = cheapest([(r[:1] if r[:1] in ("s", "u", "a") else "", f) for (_, r, _), f in zip(rows, faults, strict=True)])
        lines, q, i = [], 0, 0
        for e in audit:
            if e != "I":
                _, r, x = rows[i]
                i += 1
            if e == "D":
                continue
            initial = r[0] if e == "K" else next(k for k in repair.FOLLOWS[q] if k != "s")
            q = repair.FOLLOWS[q][initial]
            lines.append(f"{r if e == 'K' else repair.NAMES[initial]}:{'' if e == 'I' else x}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((c, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def test_repair(spark, tmp_path):
    data = odd_rows()
    convs(spark, data).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op12_structure_repair(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_report(data), key=str)
    whole = repair.repair(convs(spark, [r for r in data if r[0] == 80]).drop("times"))
    assert [r.text for r in whole.collect() if r.role][:2] == ["turn 0.", "turn 1."]


def test_repair_of_nothing(spark):
    assert repair.reports(repair.repair(convs(spark, []).drop("times"))).count() == 0


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_structure_repair", "op13_token_groups"])
def test_sql(spark, small, duck, name):
    assert comparable(QUERIES[name](spark, small).toPandas()) == comparable(duck(ORACLE_SQL[name], small))


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute_groups(data):
    """doc_id, n_shingles, component of each row, every two rows compared."""
    sets = [shingles(t) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(data)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(data)), key=str)


def family(rng, vocabulary, size, copies, edits):
    base = [rng.choice(vocabulary) for _ in range(size)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = rng.choice(vocabulary)
        yield " ".join(w)


@pytest.mark.parametrize("group, rows", [(128, 4096), (3, 5)])
def test_groups(spark, monkeypatch, group, rows):
    """Families of near copies at, above and below the limit, with small and with usual groups, against all pairs."""
    monkeypatch.setattr(token_groups, "GROUP", group)
    monkeypatch.setattr(token_groups, "KEY_ROWS", rows)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [t for size, copies, edits in ((200, 60, 3), (120, 30, 4), (60, 30, 2), (300, 20, 9), (100, 60, 4), (12, 10, 1), (5, 6, 1), (4, 4, 1)) for t in family(rng, vocabulary, size, copies, edits)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [f"{passage} {' '.join(rng.choice(vocabulary) for _ in range(rng.randint(2, 60)))}" for _ in range(60)]
    data = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, texts[10].upper())]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for c in ("n", "sid", "token", "seen", "g", "root", "key", "component_id", "prefix"):
        df = df.selectExpr("*", f"'x' AS {c}")
    got = token_groups.similar(df)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_groups(data)


def test_groups_odd(spark, odd, empty):
    got = token_groups.similar(odd, "source").collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_groups([(r.doc_id, r.text) for r in odd.collect()])
    assert token_groups.similar(empty).count() == 0


def test_least_common():
    for a, b in itertools.product(range(1, 60), repeat=2):
        assert token_groups.least_common(a, b) == next(o for o in range(a + b + 1) if 100 * o >= 85 * (a + b - o))


def test_frequent_tokens(monkeypatch):
    """Tokens of one in a thousand sets are found whatever comes between."""
    import numpy as np

    monkeypatch.setattr(token_groups, "GATHERED", 5000)
    monkeypatch.setattr(token_groups, "KEPT", 200_000)
    rng, found = np.random.default_rng(1), token_groups._Frequent()
    for i in range(8000):
        own = rng.integers(1000, 2**63, 50, dtype=np.uint64)
        found.add(np.unique(np.concatenate([own, np.array([k for k in range(8) if i % (100 * (k + 1)) == 0], np.uint64)])))
    tokens, counts = found.often()
    assert set(range(8)) <= set(tokens.tolist()) and len(tokens) < 200 and counts[0] >= 76


def test_groups_of_a_family(spark, monkeypatch):
    """Similar texts that are mostly not linked stand in few groups, so that a token they share meets few groups with its sets."""
    rng, placed = random.Random(3), []
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    data = []
    for i in range(600):
        w = list(base)
        for at in rng.sample(range(150), rng.randint(1, 3)):
            w[at] = rng.choice(vocabulary)
        data.append((i, " ".join(w)))
    own = token_groups._placed

    def kept(*given):
        placed.append(own(*given))
        return placed[-1]

    monkeypatch.setattr(token_groups, "_placed", kept)
    got = token_groups.similar(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_groups(data)
    rows = placed[0].selectExpr("g", "explode(prefix) AS token").groupBy("token").agg(F.count_distinct("g").alias("groups"))
    assert rows.agg(F.max("groups")).first()[0] <= 3 * 600 // token_groups.GROUP  # 57 when sets took the least of their keys, and small components their roots
