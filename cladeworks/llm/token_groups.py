"""Join of documents by the Jaccard index of their word shingles, by a matrix of tokens and groups of similar documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm.common import few, raw, small, table, texts
from cladeworks.llm.components import components
from cladeworks.session import settle

#: Words of a shingle; least intersection of linked documents, in hundredths of their union.
WORDS, LEAST = 4, 85
#: Tokens that at least one in SHARE documents have, and FLOOR of them, come last in all orders of tokens.
SHARE, FLOOR = 2048, 64
#: Bytes of the texts whose words are taken together.
AT_ONCE = 1 << 20
#: Tokens that a task gathers before it counts them, and whose counts it keeps; words whose hashes it keeps.
GATHERED, KEPT, KNOWN = 1_000_000, 4_000_000, 300_000
#: Smallest hashes of a set, each by a mixing of its own, by which similar sets are brought together at first.
MINIMA = 4
#: About the most sets of a group; rows of one key, or queries of one group, that go to one task.
GROUP, KEY_ROWS = 128, 4096
#: Bits of a piece of a bitmap, and of a bitmap at most (64 MB).
PIECE, MOST_BITS = 1 << 19, 1 << 29
#: Most rows of tokens, sets or documents (8 to 24 bytes each) that are broadcast; most tokens that come last.
MOST, MOST_FREQUENT = 1_000_000, 4_000_000


def least_common(a, b):
    """The smallest intersection of linked sets of ``a`` and ``b`` tokens: o with 100 o >= LEAST (a + b - o)."""
    return -(-LEAST * (a + b) // (100 + LEAST))


def least_own(n):
    """The smallest intersection with any linked set, of whatever size."""
    return -(-LEAST * n // 100)


class _Words(dict):
    """Hashes of words; a bounded number is kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mix(x):
    """The 64-bit finaliser of splitmix, so that all bits depend on all."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_sets(batch: list[bytes], known: _Words):
    """The distinct 64-bit hashes of each text's shingles, ascending: 4 words, A-Z as lower case; fewer words are one shingle; no word gives none."""
    import itertools

    import numpy as np

    size, first = 0, 0
    for last, text in enumerate(batch):
        size += len(text)
        if size < AT_ONCE and last + 1 < len(batch):
            continue
        words = [t.lower().split() for t in batch[first : last + 1]]
        size, first = 0, last + 1
        lengths = [len(w) for w in words]
        h = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(words)), np.uint64, sum(lengths))
        del words
        x = np.full(max(0, len(h) - WORDS + 1), WORDS, np.uint64)  # the shingle that begins at each word
        for k in range(WORDS):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(x)])
        at = 0
        for n in lengths:
            if n >= WORDS:
                own = np.sort(x[at : at + n - WORDS + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            else:
                one = np.full(min(n, 1), n, np.uint64)
                for k in range(n):
                    one = _mix(one * np.uint64(0x9E3779B97F4A7C15) + h[at + k : at + k + 1])
                yield one
            at += n


def set_id(tokens) -> int:
    """64 bits that stand for a set."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >> 63 else h


class _Frequent:
    """Counts of the tokens of the sets given. Of more than KEPT tokens the half that is found least is forgotten.

    A token loses less than one for each KEPT / 2 tokens seen, so none that one in SHARE sets has is missed while sets
    have at most some 450 tokens on average; a missed one does not come last, which costs time, not links.
    """

    def __init__(self):
        import numpy as np

        self.parts, self.size, self.sets = [], 0, 0
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def add(self, tokens) -> None:
        self.sets += 1
        self.parts.append(tokens)
        self.size += len(tokens)
        if self.size >= GATHERED:
            self._fold()

    def _fold(self) -> None:
        import numpy as np

        if not self.parts:
            return
        tokens, counts = np.unique(np.concatenate(self.parts), return_counts=True)
        self.parts, self.size = [], 0
        at = np.searchsorted(self.tokens, tokens)
        there = at < len(self.tokens)
        there[there] = self.tokens[at[there]] == tokens[there]
        self.counts[at[there]] += counts[there].astype(np.int32)
        every, both = np.concatenate([self.tokens, tokens[~there]]), np.concatenate([self.counts, counts[~there].astype(np.int32)])
        if len(every) > KEPT:
            few = np.partition(both, len(both) - KEPT // 2)[len(both) - KEPT // 2]
            every, both = every[both > few], both[both > few]
        order = np.argsort(every, kind="stable")
        self.tokens, self.counts = every[order], both[order]

    def often(self):
        """Tokens, and counts, of at least one in 2 SHARE of the sets, and of two."""
        self._fold()
        here = self.counts >= max(2, self.sets // (2 * SHARE))
        return self.tokens[here], self.counts[here]


def _marks(names: list[str]):
    """A row of each document: its other columns, the size of its set and the set; then rows of the task's frequent tokens."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, frequent, kinds = _Words(), _Frequent(), None
        for b in few(batches):
            sets = list(token_sets(raw(b.column("text")), known))
            for s in sets:
                frequent.add(s)
            kinds = {c: b.schema.field(c).type for c in names}
            ids = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            none = pa.nulls(len(sets), pa.int64())
            yield pa.record_batch({c: b.column(c) for c in names} | {"n": pa.array([len(s) for s in sets], pa.int64()), "sid": ids, "token": none, "seen": none})
        if kinds is not None:
            tokens, counts = frequent.often()
            for i in range(0, len(tokens), 10_000):
                k = len(tokens[i : i + 10_000])
                none = pa.nulls(k, pa.int64())
                yield pa.record_batch({c: pa.nulls(k, t) for c, t in kinds.items()} | {"n": none, "sid": none, "token": pa.array(tokens[i : i + k].view(np.int64)), "seen": pa.array(counts[i : i + k].astype(np.int64))})

    return run


def _once(batches, known):
    """(set id, tokens) of each set of a task that is not empty, once."""
    seen: set[int] = set()
    for b in few(batches):
        for tokens in token_sets(raw(b.column("text")), known):
            if len(tokens) and (sid := set_id(tokens)) not in seen:
                seen.add(sid)
                yield sid, tokens


def _prefixes(heavy):
    """sid, n, minima, prefix: of each set the least hashes, and the first tokens in the common order; any linked set has one of these among its own."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, rows, size = heavy.value, [], 0
        salts = [np.uint64(0xD1342543DE82EF95 * (2 * k + 1) & (2**64 - 1)) for k in range(MINIMA)]

        def out():
            nonlocal size
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            rows.clear()
            size = 0
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["sid", "n", "minima", "prefix"])

        for sid, tokens in _once(batches, _Words()):
            at = np.searchsorted(last, tokens)
            late = (last[np.minimum(at, len(last) - 1)] == tokens) if len(last) else np.zeros(len(tokens), bool)
            first = np.concatenate([tokens[~late], tokens[late]])[: len(tokens) - int(least_own(len(tokens))) + 1]
            rows.append((sid, len(tokens), np.array([_mix(tokens ^ s).min() for s in salts]).view(np.int64), first.view(np.int64)))
            size += len(first)
            if size >= 100_000:
                yield out()
        yield out()

    return run


def _sets(batches):
    """sid, tokens (64 bits each) of each set of a task, once."""
    import pyarrow as pa

    rows, size = [], 0
    for sid, tokens in _once(batches, _Words()):
        rows.append((sid, tokens.tobytes()))
        size += len(tokens)
        if size >= 500_000:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["sid", "tokens"])
            rows, size = [], 0
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["sid", "tokens"])


def _neighbours(batches):
    """Pairs of sets to compare first, of rows sorted by key, part and size: each with the one before it and with the first of about its size."""
    import pyarrow as pa

    key = first = before = None
    for b in batches:
        u, v = [], []
        for k, part, n, sid in zip(*(b.column(c).to_pylist() for c in ("key", "part", "n", "sid")), strict=True):
            if (k, part) != key:
                key, first, before = (k, part), (n, sid), None
            elif sid not in (first[1], before):
                if 100 * first[0] < LEAST * n:
                    first = (n, sid)
                for other in {first[1], before} - {None, sid}:
                    u.append(other)
                    v.append(sid)
            before = sid
        yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _compared(batches):
    """Links u, v of rows sorted by u, the set of u itself (v null) before those of its partners."""
    import numpy as np
    import pyarrow as pa

    now, own = None, None
    for b in batches:
        us, vs = [], []
        for u, v, data in zip(*(b.column(c).to_pylist() for c in ("u", "v", "tokens")), strict=True):
            tokens = np.frombuffer(data, np.uint64)
            if v is None:
                now, own = u, tokens
            elif u == now and len(np.intersect1d(own, tokens, assume_unique=True)) >= least_common(len(own), len(tokens)):
                us.append(u)
                vs.append(v)
        yield pa.record_batch({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


class Group:
    """The sets of a group, the union of their tokens, and which of them are linked with each other, directly or by way of others."""

    def __init__(self):
        self.ids, self.sets, self.union, self.heads = [], [], None, None

    def add(self, sid: int, tokens) -> None:
        self.ids.append(sid)
        self.sets.append(tokens)

    def _join(self) -> None:
        """The first member of each one's links, by a search in which only members that are not reached yet are compared."""
        import numpy as np

        self.heads, left = {}, list(range(len(self.ids)))
        while left:
            head, wave, left = left[0], left[:1], left[1:]
            while wave:
                i = wave.pop()
                self.heads[i] = head
                near = [j for j in left if self._near(self.sets[i], self.sets[j], np)]
                left = [j for j in left if j not in set(near)]
                wave += near

    @staticmethod
    def _near(one, other, np) -> bool:
        k = least_common(len(one), len(other))
        return k <= min(len(one), len(other)) and len(np.intersect1d(one, other, assume_unique=True)) >= k

    def linked(self, sid: int, tokens) -> list[int]:
        """Members that a set links to, one of those that are linked with each other. The group is opened only if its union holds as many of the set's tokens as any link needs."""
        import numpy as np

        if self.union is None:
            self.union = np.unique(np.concatenate(self.sets))
        common = np.intersect1d(self.union, tokens, assume_unique=True)
        if len(common) < least_own(len(tokens)):
            return []
        if self.heads is None:
            self._join()
        if sid in self.ids:
            head = self.heads[self.ids.index(sid)]
            return [self.ids[head]] if self.ids[head] != sid else []
        found: dict[int, int] = {}
        for i, s in enumerate(self.sets):
            if self.heads[i] not in found and len(common) >= least_common(len(s), len(tokens)) and self._near(s, tokens, np):
                found[self.heads[i]] = self.ids[i]
        return list(found.values())


def _opened(batches):
    """Links u, v of queries and members, of rows sorted by group and part, members (query null) before queries."""
    import numpy as np
    import pyarrow as pa

    now, group = None, None
    for b in batches:
        us, vs = [], []
        for g, part, query, sid, data in zip(*(b.column(c).to_pylist() for c in ("g", "part", "query", "sid", "tokens")), strict=True):
            if (g, part) != now:
                now, group = (g, part), Group()
            tokens = np.frombuffer(data, np.uint64)
            if query is None:
                if sid not in group.ids:
                    group.add(sid, tokens)
            elif group.ids:
                for v in group.linked(query, tokens):
                    us.append(query)
                    vs.append(v)
        yield pa.record_batch({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _parts(rows: DataFrame, key: str) -> DataFrame:
    """key, parts of keys with over KEY_ROWS rows, with the first set of such a key."""
    most = KEY_ROWS
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.min(F.struct("n", "sid")).alias("anchor")).where(F.col("rows") > most).select(key, F.ceil(F.col("rows") / most).cast("int").alias("parts"), "anchor")


def _wanted(docs: DataFrame, rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """sid, tokens of the sets whose ids (sid) are given. Of the texts only one row for each is worked on, unless these are more than MOST."""
    ids = small(ids.distinct(), MOST, name)
    holders = settle(rows.join(ids, "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("holder")).select("holder").distinct(), "holders")
    few_rows = holders.limit(MOST + 1).count() <= MOST
    if few_rows:
        docs = docs.join(F.broadcast(holders), docs["doc_id"].eqNullSafe(holders["holder"]), "left_semi")
    made = docs.select("text").mapInArrow(_sets, "sid long, tokens binary").join(ids, "sid", "left_semi")
    return settle(made if few_rows else made.dropDuplicates(["sid"]), "token-sets")  # that a set comes twice does no harm


def _first_links(docs: DataFrame, rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u, v: some links; and sid, key, crowd: of each set that shares a least hash with another one that which most sets have, and how many. Links are found among sets that share two of their least hashes, each compared with few others.

    They make one component of nearly all copies that are edited little, however many these are.
    """
    keyed = settle(sets.select("sid", "n", F.posexplode("minima").alias("k", "m")).select(F.xxhash64("k", "m").alias("key"), "sid", "n").distinct(), "all-keyed")
    several = small(keyed.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1"), MOST, "several")
    keyed = settle(keyed.join(several, "key"), "keyed")
    hot = settle(_parts(keyed, "key"), "hot-keys")
    dealt = keyed.join(F.broadcast(hot.select("key", "parts")), "key", "left").select("key", F.pmod(F.xxhash64("sid"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "n", "sid")
    anchors = hot.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "anchor.n", "anchor.sid")
    dealt = dealt.unionByName(anchors).repartition("key", "part").sortWithinPartitions("key", "part", "n", "sid")
    pairs = settle(dealt.select("key", "part", "n", "sid").mapInArrow(_neighbours, "u long, v long").groupBy("u", "v").count().where("count > 1").drop("count"), "first-pairs")
    tokens = _wanted(docs, rows, pairs.select(F.col("u").alias("sid")).union(pairs.select("v")), "compared")
    partners = small(pairs, MOST, "partners").join(tokens.withColumnRenamed("sid", "v"), "v").select("u", "v", "tokens")
    own = tokens.join(small(pairs.select(F.col("u").alias("sid")).distinct(), MOST, "firsts"), "sid", "left_semi").select(F.col("sid").alias("u"), F.lit(None).cast("long").alias("v"), "tokens")
    links = settle(own.unionByName(partners).repartition("u").sortWithinPartitions("u", F.asc_nulls_first("v")).mapInArrow(_compared, "u long, v long"), "first-links")
    return links, settle(keyed.groupBy("sid").agg(F.max(F.struct("crowd", "key")).alias("most")).select("sid", "most.crowd", "most.key"), "near")


def _may_link() -> Column:
    """Whether a set of n tokens that shares so many first tokens with a group, of sets of ``least`` to ``most`` tokens, may link to one.

    Of two sets, that whose first tokens end sooner in the common order has no more tokens in common with the other than
    the shared first ones and its own later ones, of which there are one fewer than ``least_own``. Over the sizes that a
    partner may have this is least strict at the smallest, or, of those not below n, at the largest.
    """
    n, own = F.col("n"), lambda x: F.ceil(x * LEAST / 100)
    common = lambda x: F.ceil((F.col("n") + x) * LEAST / (100 + LEAST))
    low, high = F.greatest("least", own(n)), F.least("most", F.floor(n * 100 / LEAST))
    below = (low <= n) & (F.col("shared") > common(low) - own(n))
    above = (high >= n) & (F.col("shared") >= common(high) - own(high))  # one less, as rounding may favour the size before
    return below | above


def _bits(bucket):
    import numpy as np
    import pyarrow as pa

    marks = np.zeros(PIECE, bool)
    marks[bucket["bit"].to_numpy()] = True
    return pa.table({"piece": bucket["piece"][:1], "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})


def _marked(tokens: DataFrame):
    """The broadcast of a bitmap of ``tokens``: 2**k bits, some 16 for each of them, but at most MOST_BITS, in pieces made by tasks."""
    pieces = 1 << max(0, (min(MOST_BITS, 16 * max(1, tokens.count())) - 1).bit_length() - (PIECE.bit_length() - 1))
    at = tokens.select(F.pmod("token", F.lit(pieces * PIECE)).alias("at"))
    made = at.select(F.floor(F.col("at") / PIECE).cast("int").alias("piece"), F.pmod("at", F.lit(PIECE)).alias("bit")).groupBy("piece").applyInArrow(_bits, "piece int, bits binary")
    found = {r.piece: bytes(r.bits) for r in made.collect()}  # of a bounded size
    empty = bytes(PIECE // 8)
    return tokens.sparkSession.sparkContext.broadcast(b"".join(found.get(i, empty) for i in range(pieces)))


def _some(bitmap):
    """Rows (token and the other columns) of the tokens of each set that the bitmap has."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            column = b.column("prefix")
            tokens = column.flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(column.offsets.to_numpy()))
            at = tokens & (8 * len(bits) - 1)
            there = np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            others = b.select([c for c in b.schema.names if c != "prefix"]).take(pa.array(row[there]))
            yield pa.record_batch([*others.columns, pa.array(tokens[there])], names=[*others.schema.names, "token"])

    return run


def _placed(sets: DataFrame, near: DataFrame, links: DataFrame) -> DataFrame:
    """sid, n, root, of, g, prefix: the sets with their components so far, and their groups.

    Large components are cut into groups of sets of about a size. Other sets go together, small components as a whole,
    by the least hash that most sets share with them (``near``: sid, crowd, key): a family of texts that are similar but
    not linked makes few groups. A set without any is a group of its own. ``of`` is 1 for sets in no component that
    share no hash, 2 for others outside of large components, else the component's size.
    """
    roots = settle(components(links), "roots")
    large = small(roots.groupBy("root").agg(F.count("*").alias("of")).where(F.col("of") > GROUP), MOST, "large")
    roots = small(roots.join(large, "root", "left").select(F.col("node").alias("sid"), "root", "of"), MOST, "members")
    units = near.join(roots, "sid", "left").where("of is null").groupBy(F.coalesce("root", "sid").alias("unit")).agg(F.max(F.struct("crowd", "key")).alias("most"), F.count("*").alias("sets"))
    units = settle(units.select("unit", "most.key", "sets"), "units")
    crowded = small(units.groupBy("key").agg(F.sum("sets").alias("crowd")).where(F.col("crowd") > GROUP), MOST, "crowded")
    units = small(units.join(crowded, "key", "left").select("unit", "key", "crowd"), MOST, "units")
    rows = sets.join(roots, "sid", "left").withColumn("unit", F.coalesce("root", "sid")).join(units, "unit", "left")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / LEAST)))
    deal = lambda of, size: F.pmod(F.xxhash64(of), F.ceil(F.coalesce(size, F.lit(1).cast("long")) / GROUP))
    g = F.when(F.col("of").isNotNull(), F.xxhash64(F.lit(1), "root", band, deal("sid", F.col("of")))).when(F.col("key").isNotNull(), F.xxhash64(F.lit(2), "key", band, deal("unit", F.col("crowd"))))
    of = F.coalesce("of", F.when(F.col("key").isNotNull(), F.lit(2).cast("long")), F.lit(1).cast("long"))
    return settle(rows.select("sid", "n", F.col("unit").alias("root"), of.alias("of"), F.coalesce(g, "sid").alias("g"), "prefix"), "placed")


def _rest(docs: DataFrame, marks: DataFrame, sets: DataFrame, near: DataFrame, links: DataFrame) -> DataFrame:
    """u, v: the links between components of ``links``; of those inside of groups and between two groups of components some may be repeated.

    The matrix says which groups of similar sets hold which of the tokens that come first in their sets. A set is a query
    to its own group, and to those of larger components (or of a greater number), that share enough of these with it.
    Only tokens of several components matter; a bitmap keeps most others out.
    """
    placed = _placed(sets, near, links)
    shared = placed.select("root", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("token")
    bitmap = _marked(settle(shared, "shared-tokens"))
    entries = settle(placed.mapInArrow(_some(bitmap), "sid long, n long, root long, of long, g long, token long"), "matrix")
    bitmap.unpersist()
    rows = entries.repartition("token")  # sums by token and the join have no other exchange
    matrix = rows.groupBy("token", "g", "of").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("one_root"), F.max("root").alias("last_root"))
    other = matrix.select("token", F.col("g").alias("its_g"), F.col("of").alias("its_of"), "least", "most", "one_root", "last_root")
    ahead = (F.col("its_of") > F.col("of")) | ((F.col("its_of") == F.col("of")) & (F.col("its_g") >= F.col("g")))
    fits = (F.col("most") * 100 >= F.col("n") * LEAST) & (F.col("n") * 100 >= F.col("least") * LEAST)
    new = (F.col("one_root") != F.col("root")) | (F.col("last_root") != F.col("root"))
    asked = rows.distinct().join(other, "token").where(new & ahead & fits)
    asked = asked.groupBy(F.col("its_g").alias("g"), "sid").agg(F.max("n").alias("n"), F.count("*").alias("shared"), F.min("least").alias("least"), F.max("most").alias("most"))
    asked = settle(asked.where(_may_link()).select("g", "sid", "n"), "asked")
    members = settle(entries.select("g", "sid").distinct().join(asked.select("g").distinct(), "g", "left_semi"), "group-members")
    tokens = _wanted(docs, marks, asked.select("sid").union(members.select("sid")), "opened")
    hot = settle(_parts(asked, "g"), "hot-groups").select("g", "parts")
    queries = asked.join(F.broadcast(hot), "g", "left").select("g", F.pmod(F.xxhash64("sid"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.col("sid").alias("query"), "sid")
    copies = members.join(F.broadcast(hot), "g", "left").select("g", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(None).cast("long").alias("query"), "sid")
    dealt = small(queries.unionByName(copies), MOST, "opened-rows").join(tokens, "sid").repartition("g", "part").sortWithinPartitions("g", "part", F.asc_nulls_first("query"))
    return settle(dealt.select("g", "part", "query", "sid", "tokens").mapInArrow(_opened, "u long, v long"), "links")


def similar(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id, the columns in ``more``, n_shingles and component_id, the smallest doc_id that links lead to, for each row of ``docs``.

    Two rows link if the intersection of their sets is at least 85 hundredths of the union. Copies are one set from the
    start, so nothing grows with the number of copies; a set without tokens (text null, empty, blank) links with nothing.
    Sets are of 64-bit hashes and are known by 64 bits. Null doc_ids get the component of their set (null if no row of
    it has an id); repeated rows get a result each; an empty table gives none; other columns are left behind. Texts are
    read four times, twice for those alone that are compared; tasks hold the sets of one group.
    """
    plain = texts(docs, *more)
    names = [c for c in plain.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {k}" for c, k in plain.dtypes if c != "text"), "n long, sid long, token long, seen long"])
    marks = settle(plain.mapInArrow(_marks(names), schema), "marks")
    rows = marks.where("token is null")
    often = marks.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    least = max(FLOOR, rows.count() // (2 * SHARE))
    heavy = often.where(F.col("seen") >= least)
    return _named(rows, _links(plain, rows, _broadcast(heavy)), names)


def _broadcast(heavy: DataFrame):
    """The frequent tokens, sorted: those that one in 2 SHARE documents have, so at most 2 SHARE times the mean size of a set.

    Of more than MOST_FREQUENT the most frequent are taken: which tokens come last changes costs, not results.
    """
    import numpy as np

    table = heavy.orderBy(F.desc("seen"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return heavy.sparkSession.sparkContext.broadcast(np.sort(table.column(0).to_numpy().view(np.uint64)) if table.num_rows else np.zeros(0, np.uint64))


def _links(plain: DataFrame, rows: DataFrame, heavy) -> DataFrame:
    sets = settle(plain.select("text").mapInArrow(_prefixes(heavy), "sid long, n long, minima array<long>, prefix array<long>"), "prefixes")
    heavy.unpersist()
    first, near = _first_links(plain, rows, sets)
    return settle(first.unionByName(_rest(plain, rows, sets, near, first)), "all-links")


def _named(rows: DataFrame, links: DataFrame, names: list[str]) -> DataFrame:
    """The rows with the smallest doc_id of their component; only sets with several rows or with links are looked up."""
    distinct = settle(rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "distinct")
    roots = components(links)
    of = settle(distinct.join(roots, distinct.sid == roots.node, "left").where("root is not null or rows > 1").select("sid", "first", F.coalesce("root", "sid").alias("root")), "roots")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = small(of.join(least, "root").select("sid", "component_id", F.lit(True).alias("known")), MOST, "named")
    found = rows.join(named, "sid", "left").withColumn("component_id", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select(*names, F.col("n").alias("n_shingles"), "component_id")


def op13_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles and component of every document; cases as in ``similar``."""
    return similar(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
own AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM doc),
token AS MATERIALIZED (SELECT r, unnest(s) AS t FROM own),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM token a JOIN token b ON a.t = b.t AND a.r < b.r GROUP BY 1, 2),
half AS (SELECT x, y FROM shared JOIN own a ON a.r = x JOIN own b ON b.r = y WHERE 100 * c >= 85 * (len(a.s) + len(b.s) - c)),
link AS MATERIALIZED (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT r, r AS other FROM own UNION SELECT reach.r, y FROM reach JOIN link ON x = other)
SELECT o.doc_id, CAST(len(o.s) AS BIGINT) AS n_shingles, min(p.doc_id) AS component_id FROM own o JOIN reach ON reach.r = o.r JOIN own p ON p.r = other GROUP BY o.r, o.doc_id, o.s"""
