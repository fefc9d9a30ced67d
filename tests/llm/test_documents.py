"""Operators on single documents against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeworks.llm import common, fingerprints, language_id, line_dedup, packing, personal_data, token_files, tokens
from tests.conftest import rows

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            check = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            ok = {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and check % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


HARD = [
    "a@b.c_d@e.f x@y z@w.q.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.0255.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 010-9999 ++1 2 3 +1((((", "日本 a.b@c-d.e 𝔘 10.0.0.1 é +49 30 1234567",
    "%@%.% a@-.- ..@a.b", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "9" * 3000, "1-" * 2000 + "1", "a." * 2000 + "@b.c", "+1" * 1000, "a@" * 1000 + "b.c", "", "4242424242424242", "x4242424242424242@y.z 1.1.1.1@a.b",
]


def test_personal_data_base(spark, make):
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice("a1.@+- ()9\n_é") for _ in range(rng.randrange(200))) for _ in range(150)]
    got = {r.doc_id: r.spans for r in personal_data.find_personal_data(make(texts)).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.rank - 1, s.end, s.kind) for s in got[i] if s.kind != "id"] == base_spans(t), t[:80]


def test_personal_data_contexts_find_what_patterns_do_not(make):
    seeds = [f"please write to user{i}@mail.example.com today" for i in range(20)]
    texts = [*seeds, "please write to agent-0047-x today", "version 20240101-beta is out"]
    got = {r.doc_id: [(s.kind, s.found) for s in r.spans] for r in personal_data.find_personal_data(make(texts)).collect()}
    assert got[20] == [("id", "agent-0047-x")] and got[21] == [] and all(got[i][0][0] == "email" and len(got[i]) == 1 for i in range(20))


def bootstrap_by_brute_force(rows):
    """Pattern and instance scores from their definition, over plain dictionaries."""
    pd = personal_data
    edges, seeds = collections.Counter(), set()
    for r in rows:
        for sign, side in (("< ", r.left), ("> ", r.right)):
            if side:
                edges[sign + side, r.found.lower()] += 1
                if r.base:
                    seeds.add(r.found.lower())
    scores = dict.fromkeys(seeds, 1.0)
    for _ in range(pd.ROUNDS):
        taken = {}
        for pattern in {p for p, _ in edges}:
            own = {i: n for (p, i), n in edges.items() if p == pattern}
            share = sum(n * scores.get(i, 0.0) for i, n in own.items()) / (sum(own.values()) + 1)
            if share >= pd.LEAST_SHARE and sum(scores.get(i, 0.0) >= pd.LEAST_SCORE for i in own) >= pd.LEAST_KNOWN:
                taken[pattern] = share
        scores = dict.fromkeys(seeds, 1.0)
        for i in {i for _, i in edges} - seeds:
            miss = 1.0
            for (p, x) in edges:
                if x == i and p in taken:
                    miss *= 1 - taken[p]
            if miss < 1:
                scores[i] = 1 - miss
    return {i: s for i, s in scores.items() if s >= pd.LEAST_SCORE and i not in seeds}


def test_discovery_by_brute_force(make, spark):
    """Which unseen identifiers the contexts lead to, with their scores."""
    rng = random.Random(16)
    before, after = ["write to", "call", "ref", "card no", "from host"], ["today", "now", "please", ""]
    value = [lambda: f"u{rng.randrange(40)}@mail.example.com", lambda: f"10.0.0.{rng.randrange(30)}", lambda: f"agent-{rng.randrange(50):04d}-x", lambda: f"v{rng.randrange(20)}0240101beta", lambda: "plain"]
    texts = [" ".join(f"{rng.choice(before)} {rng.choice(value[: 2 if rng.random() < 0.7 else 5])()} {rng.choice(after)}" for _ in range(rng.randrange(1, 8))) for _ in range(250)]
    rows = personal_data.occurrences(make(texts))
    want = bootstrap_by_brute_force([r for r in rows.collect() if r.kind is not None])
    got = {r.instance: r.score for r in personal_data.bootstrap(rows).collect()}
    assert got == pytest.approx(want) and got


def test_personal_data_odd(odd, empty):
    got = personal_data.find_personal_data(odd).collect()
    assert len(got) == odd.count() and all(r.spans == [] for r in got)
    assert personal_data.find_personal_data(empty).count() == 0


def test_fingerprints(spark, odd, empty, make):
    texts = ["alpha beta gamma delta " * 5, "alpha beta gamma delta " * 5, "x", "", "one two three four five six seven eight nine ten"]
    got = {r.doc_id: r for r in fingerprints.with_next(make(texts)).collect()}
    for i, t in enumerate(texts):
        other = texts[(i - 1) % len(texts)]
        new = fingerprints.edited(t, other)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[i].fp == fingerprints.fingerprint(t) and got[i].edited_fp == fingerprints.fingerprint(new)
        assert got[i].near_next == fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(other))
    assert got[0].fp == got[1].fp and got[1].near_next == 1.0
    assert fingerprints.with_next(odd).count() == odd.count() and fingerprints.with_next(empty).count() == 0
    assert fingerprints.with_next(make(["only one"])).first().near_next == 1.0


def test_next_of_repeated_ids(spark):
    """Ids that fill several buckets are dealt to as many; the chain of next documents has each row once."""
    texts = [f"{i:03d}abcdefgh" for i in range(60)]
    data = [(5 if i % 3 else None if i % 2 else i, t) for i, t in enumerate(texts)]
    got = fingerprints.with_next(spark.createDataFrame(data, "doc_id long, text string")).collect()
    pairs = {hashlib.sha256(fingerprints.edited(t, o).encode()).hexdigest(): (t, o) for t in texts for o in texts}
    after = dict(pairs[r.edited_sha256] for r in got)
    ids = {t: -1 if i is None else i for i, t in data}
    order, t = [], texts[0]
    for _ in texts:
        order.append(t)
        t = after[t]
    assert len(got) == 60 and set(order) == set(texts) and sum(ids[a] < ids[b] for a, b in zip(order, order[1:] + order[:1], strict=True)) == 1


@pytest.mark.parametrize(("most", "same"), [(4096, 1), (8, 1), (4096, 2)])
def test_near_counts(spark, monkeypatch, most, same):
    monkeypatch.setattr(fingerprints, "in_groups", lambda rows, item: common.in_groups(rows, item, most))
    rng = random.Random(1)
    base = [rng.getrandbits(256) for _ in range(12)]
    all_fp = base + [b ^ sum(1 << k for k in rng.sample(range(256), rng.randrange(1, 26))) for b in base for _ in range(8)]
    near = lambda x: sum(y != x and (x ^ y).bit_count() <= fingerprints.RADIUS for y in set(all_fp))
    want = {x.to_bytes(32): near(x) for x in all_fp if near(x)}
    df = spark.createDataFrame([(bytearray(x.to_bytes(32)),) for x in all_fp] + [(None,)], "fp binary")
    assert {bytes(r.fp): r.n_near for r in fingerprints.near_counts(df, same).collect()} == want
    assert fingerprints.near_counts(df.limit(0), same).count() == 0


def test_near_copies_of_documents(spark):
    """Texts that share eight in ten of their runs of five words are found: recall of the radius, and n_near against brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    texts = sorted({r.text for r in rows if r.text and len(r.text.split()) >= 20})
    rng = random.Random(2)
    vocabulary = [w for t in texts[:50] for w in t.split()]
    runs = lambda t: set(zip(*[t.lower().split()[i:] for i in range(5)], strict=False))
    for t in texts[:300]:
        w = t.split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    true = [(t, c) for t, c in zip(texts[:300], texts[-300:], strict=True) if len(runs(t) & runs(c)) >= 0.8 * len(runs(t) | runs(c)) and t != c]
    fp = {t: int.from_bytes(fingerprints.fingerprint(t)) for t in texts}
    assert len(true) > 100 and sum((fp[a] ^ fp[b]).bit_count() <= fingerprints.RADIUS for a, b in true) >= 0.9 * len(true)
    words = np.array([list(x.to_bytes(32)) for x in sorted(set(fp.values()))], np.uint8).view("<u8")
    near = np.array([(np.bitwise_count(words ^ x).sum(1) <= fingerprints.RADIUS).sum() - 1 for x in words])
    df = spark.createDataFrame([(bytearray(x.tobytes()),) for x in words], "fp binary")
    assert {bytes(r.fp): r.n_near for r in fingerprints.near_counts(df).collect()} == {x.tobytes(): n for x, n in zip(words, near.tolist(), strict=True) if n}


def test_token_files(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokens.default_path()
    library = Tokenizer.from_file(path)
    token_files.write(odd, f"file://{tmp_path}/t", path)
    got = token_files.read(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    texts = sorted(((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    before = 0
    for r, (doc, text) in zip(got, texts, strict=True):
        want = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, before, len(want), want)
        before += len(want)
    assert "ids" not in token_files.read(spark, f"file://{tmp_path}/t", with_ids=False).columns
    token_files.write(empty, f"file://{tmp_path}/e", path)
    assert token_files.read(spark, f"file://{tmp_path}/e").count() == 0


def test_tokens_equal_the_library(small):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    texts = pq.read_table(f"{small}/documents.parquet")["text"].to_pylist()
    rng = random.Random(0)
    texts += ["".join(rng.choice("aZ'sté0 \n\t.!ßÀ÷×½ñ日é  \x1c\x00İσΣς") for _ in range(40)) for _ in range(300)]
    for t in texts:
        assert tokens.encode(t.encode(), tokens.default_path()) == np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes(), repr(t[:60])


def test_language_id(spark, small, odd, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    profiles = language_id.learn(docs.where(~language_id.held_out()))
    got = language_id.identify(docs, profiles, "lang").where(language_id.held_out())
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.95 * n > 0
    found = {r.doc_id: r for r in language_id.identify(odd, profiles).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3, 7)) and found[4].lang_pred != "und"
    none = language_id.learn(empty)
    assert none.count() == 0 and language_id.identify(empty, profiles).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert held_out_rule(docs)


def language_by_brute_force(text, profiles):
    """Out-of-place distances from their definition, over plain counters."""
    count = plain_ngrams(text)
    ranked = sorted(count, key=lambda g: (-count[g], [ord(c) for c in g.rjust(3, "\0")]))[: language_id.PROFILE]
    if not ranked or not profiles:
        return "und", 0.0
    away = sorted((sum(abs(p[g] - i) if g in p else language_id.PROFILE for i, g in enumerate(ranked)), lang) for lang, p in profiles.items())
    second = away[1][0] if len(away) > 1 else language_id.PROFILE * len(ranked)
    return away[0][1], (second - away[0][0]) / second if second else 0.0


@pytest.mark.parametrize("most", [10**8, 0])
def test_language_by_distance(spark, small, odd, make, monkeypatch, most):
    """Profiles, predictions and scores against brute force, with profiles that go to every task and with joins."""
    monkeypatch.setattr(language_id, "MOST_BYTES", most)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    learned = collections.defaultdict(dict)
    found = language_id.learn(docs)
    for r in found.collect():
        learned[r.lang]["".join(chr(r.gram >> s & 0x1FFFFF) for s in (42, 21, 0) if r.gram >> s)] = r.r
    counts = collections.defaultdict(collections.Counter)
    for r in docs.collect():
        if r.lang is not None:
            counts[r.lang].update(plain_ngrams(r.text or ""))
    for lang, c in counts.items():
        assert list(learned[lang]) and sorted(learned[lang], key=learned[lang].get) == sorted(c, key=lambda g: (-c[g], [ord(x) for x in g.rjust(3, "\0")]))[: language_id.PROFILE]
    for one in (found, found.where("lang = 'en'"), found.limit(0)):
        names = {r.lang for r in one.select("lang").distinct().collect()}
        for table in (docs.limit(60), odd, make(["", "a", "zzz qqq", "日本"])):
            for r in language_id.identify(table, one, keep_text=True).collect():
                assert (r.lang_pred, pytest.approx(r.score)) == language_by_brute_force(r.text, {k: v for k, v in learned.items() if k in names})


def held_out_rule(docs):
    return all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in docs.select("doc_id", language_id.held_out().alias("h")).collect())


def plain_ngrams(t):
    t = " " + re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0].isalpha() else " ", t.lower(), flags=re.S) + " "
    t = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t))
    out = collections.Counter(c for c in t if c != " ")
    out.update(t[i : i + 2] for i in range(len(t) - 1))
    out.update(t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " ")
    return out


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 100, 1 << 20])
def test_ngrams_by_pieces(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    name = lambda k: "".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s)
    for text in ("Der schnelle Fuchs, der 3 braune!  " * 20, "", "  ", "a", " a ", "ab", "ΑΣ ΑΣΑ, 日本語 -- x", "..a..b", "x" * 30):
        keys, n = language_id.ngrams(text)
        assert {name(k): c for k, c in zip(keys.tolist(), n.tolist(), strict=True)} == plain_ngrams(text) and (np.diff(keys) > 0).all()


def lines_by_brute_force(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = collections.Counter(k for t in texts for k in {key(x) for x in t.split("\n")} - {""})
    out = []
    for t in texts:
        ls = t.split("\n")
        kept = [x for x in ls if seen[key(x)] < least]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("probes", "most"), [(1 << 20, 500_000), (50, 0)])
def test_line_dedup(spark, odd, empty, make, monkeypatch, probes, most):
    monkeypatch.setattr(line_dedup, "PROBES", probes)
    monkeypatch.setattr(line_dedup, "MOST_TEXTS", most)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    monkeypatch.setattr(line_dedup, "ANSWERS", 7)
    rng = random.Random(5)
    texts = ["\n".join(rng.choice([" Foo%d \t", "FOO%d", "\x0bbar%d", "é%d", "É%d", "", " "]).replace("%d", str(rng.randrange(12))) for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_common_lines(make(texts), min_docs=5).collect()}
    assert [got[i] for i in range(len(texts))] == lines_by_brute_force(texts, 5)
    assert sum(x[1] for x in got.values()) > 0
    found = line_dedup.drop_common_lines(odd, min_docs=3).collect()
    assert len(found) == odd.count() and {r.doc_id: r.n_dropped for r in found}[6] == 1 and {r.doc_id: r.n_lines for r in found}[1] == 1
    assert line_dedup.drop_common_lines(empty).count() == 0


def test_line_dedup_sql(spark, small, duck):
    assert rows(line_dedup.op6_line_dedup(spark, small).toPandas()) == rows(duck(line_dedup.OP6_SQL, small))


def test_pack_takes_each_token_once():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.choice([1, 5, 255, 256, 257, 700, 1024, 2047, 2048, 2049, 9000, rng.randrange(1, 3000)]) for _ in range(rng.randrange(0, 60))]
        done, left = packing.pack(lengths)
        assert all(sum(x[2] for x in s) in packing.TIERS for s in done) and sum(x[2] for x in left) < min(packing.TIERS)
        last = packing.tail(left)
        assert all(sum(x[2] for x in s).bit_count() == 1 for s in last)
        taken = sorted((k, start, n) for s in done + last for k, start, n in s)
        at = dict.fromkeys(range(len(lengths)), 0)
        for k, start, n in taken:
            assert start == at[k] and n > 0
            at[k] += n
        assert list(at.values()) == lengths


def test_packing(spark, odd, empty, monkeypatch):
    path = tokens.default_path()
    got = packing.pack_documents(odd, path).toPandas()
    ids = {r.doc_id: tokens.encode((r.text or "").encode(), path) for r in odd.select("doc_id", "text").collect()}
    for doc, total in got.groupby("doc_id", dropna=False).length.sum().items():
        assert total == len(ids[None if doc != doc else int(doc)]) // 4 * (2 if doc == 5 else 1)
    for r in got.itertuples():
        own = ids[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.ids_crc32 == zlib.crc32(own[4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(own) // 4
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() == s.tier.iloc[0] and s.tier.nunique() == s.step.nunique() == 1
    assert packing.pack_documents(empty, path).count() == 0


def test_balance():
    sizes = [2048] * 300 + [256] * 100
    at = packing.balance(sizes)
    cost = collections.Counter()
    for s, k in zip(sizes, at, strict=True):
        cost[k] += s * s
    assert len(cost) == 5 and max(cost.values()) - min(cost.values()) <= 2048**2
