"""Text quality by an interpolated modified Kneser-Ney model of characters, trained on trusted texts of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm.common import each, few, small, table, texts
from cladeworks.session import settle

#: Characters of the longest n-gram, bits of a character's class, and classes (the uniform base of the model).
ORDER, WIDTH = 5, 12
CLASSES = 1 << WIDTH
#: Classes of the padding before a text and of its end.
BEGIN, END = 0, 1
#: A document stays if its perplexity is at most SLACK times this quantile of the trusted documents of its language
#: that are held out from training, one in HELD_OUT; with fewer than LEAST_TRUSTED of them, those of all languages count.
QUANTILE, SLACK, HELD_OUT, LEAST_TRUSTED = 0.99, 1.15, 5, 20
#: What a document is: not trusted, trained on, or held out.
OTHER, TRAIN, HELD = 0, 1, 2
#: Code points that are counted at a time; n-grams of a shard; bytes of shards that are broadcast at a time.
PIECE, SHARD_ROWS, BLOCK_BYTES = 1 << 20, 1 << 17, 48 << 20
#: N-grams that are scored at a time; four times as many if the model has several blocks.
SCORED = 1 << 20
#: Most rows of trusted ids (8 bytes each), and of languages, that are broadcast; beyond, they are joined.
MOST_IDS, MOST_LANGUAGES = 4_000_000, 5_000


def grams(text: str):
    """The n-grams that end at each character and at the end, 12 bits a character, in arrays of bounded length.

    A run of white space is one blank. Code points from 2048 on share 2,047 classes.
    """
    import numpy as np

    text = " ".join(text.split())
    before = np.full(ORDER - 1, BEGIN, np.int64)
    for i in range(0, len(text) + 1, PIECE):
        c = np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        c = np.where(c < 2048, c, 2048 + c % 2047)
        c = np.concatenate([before, c, [END] if i + PIECE > len(text) else []]).astype(np.int64)
        before = c[len(c) - ORDER + 1 :]
        key = np.zeros(len(c) - ORDER + 1, np.int64)
        for k in range(ORDER):
            key = key << WIDTH | c[k : len(c) - ORDER + 1 + k]
        yield key


def _merge(keys, counts):
    import numpy as np

    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def _count(batches):
    """Rows (lang, gram, n): how often each n-gram occurs in trusted texts that the task reads, 0 if in others only."""
    import numpy as np
    import pyarrow as pa

    held: dict[tuple, list] = {}

    def fold():
        for k, parts in held.items():
            if len(parts) > 1:
                held[k] = [_merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        return sum(len(parts[0][0]) for parts in held.values())

    def out():
        fold()
        for (lang, trusted), ((keys, n),) in held.items():
            yield pa.record_batch({"lang": pa.array([lang] * len(keys), pa.string()), "gram": pa.array(keys), "n": pa.array(n * (trusted == TRAIN))})

    for b in few(batches):
        fresh: dict[tuple, list] = {}
        for text, *k in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "trusted")), strict=True):
            fresh.setdefault(tuple(k), []).extend(grams(text))
            if sum(map(len, fresh[tuple(k)][-1:])) == PIECE:  # a long text
                fresh[tuple(k)] = [np.concatenate(fresh[tuple(k)])]
        for k, parts in fresh.items():
            held.setdefault(k, []).append(np.unique(np.concatenate(parts), return_counts=True))
        if fold() > 3_000_000:
            yield from out()
            held.clear()
    yield from out()


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: from how many n-grams have a count of 1, 2, 3 and 4."""
    n = counts.where("a > 0").groupBy("lang").agg(*(F.sum((F.col("a") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.coalesce(F.when(F.col(f"n{i}") > 0, F.greatest(F.lit(0.1), F.least(F.lit(float(i)), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))), F.lit(0.5 * i)) for i in (1, 2, 3)]
    return n.select("lang", *(x.alias(f"d{i}") for i, x in enumerate(d, 1)))


def probabilities(counts: DataFrame) -> DataFrame:
    """lang, gram, p for each row (lang, gram, n) of n-grams that are asked for; n is the count in trusted texts.

    Below the longest n-grams, counts are numbers of different characters before. An n-gram's probability is that of
    its discounted count among those with its context, and for the rest that of the n-gram without its first
    character; with an unseen context, only the latter; last comes the uniform distribution.
    """
    tables = {ORDER: counts.select("lang", "gram", F.col("n").alias("a"))}
    for k in range(ORDER - 1, 0, -1):
        mask = (1 << WIDTH * k) - 1
        lower = tables[k + 1].groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum((F.col("a") > 0).cast("long")).alias("a"))
        tables[k] = settle(lower, f"order-{k}")
    below = None
    for k in range(1, ORDER + 1):
        rows = tables[k].withColumn("context", F.shiftright("gram", WIDTH))
        at = lambda i: (F.col("a") == i).cast("long") if i < 3 else (F.col("a") >= 3).cast("long")
        contexts = rows.where("a > 0").groupBy("lang", "context").agg(F.sum("a").alias("total"), *(F.sum(at(i)).alias(f"c{i}") for i in (1, 2, 3)))
        rows = rows.join(contexts, ["lang", "context"], "left").join(small(_discounts(tables[k]), MOST_LANGUAGES), "lang", "left")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1 / CLASSES))
        else:
            rows = rows.withColumn("rest", F.col("gram").bitwiseAND((1 << WIDTH * (k - 1)) - 1)).join(below, ["lang", "rest"])
        cut = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.greatest(F.col("a") - F.when(F.col("a") > 0, cut).otherwise(0.0), F.lit(0.0))
        free = F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")
        p = F.when(F.col("total") > 0, (own + free * F.col("lower")) / F.col("total")).otherwise(F.col("lower"))
        found = settle(rows.select("lang", "gram", p.alias("p")), f"p-{k}")
        below = found.select("lang", F.col("gram").alias("rest"), F.col("p").alias("lower"))
    return found


def _slots(keys, bits: int):
    """Where each key's search begins in a table of 2**bits places: the top bits of a product depend on all of the key."""
    import numpy as np

    with np.errstate(over="ignore"):
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _shard(rows):
    """A shard's values by key, as arrays for linear probing that are at most half full."""
    import numpy as np
    import pyarrow as pa

    keys, p = np.ascontiguousarray(rows["gram"].to_numpy()), np.log(rows["p"].to_numpy()).astype("<f4")
    bits = max(4, (2 * len(keys) - 1).bit_length())
    own, values, mask = np.full(1 << bits, -1, "<i8"), np.zeros(1 << bits, "<f4"), (1 << bits) - 1
    at, left = _slots(keys, bits), np.arange(len(keys))
    while len(left):
        slot, first = np.unique(at[left], return_index=True)
        free = own[slot] == -1
        here = left[first[free]]
        own[slot[free]], values[slot[free]] = keys[here], p[here]
        left = left[own[at[left]] != keys[left]]
        at[left] = (at[left] + 1) & mask
    return pa.table({"lang": rows["lang"][:1], "shard": rows["shard"][:1], "data": pa.array([own.tobytes() + values.tobytes()], pa.binary())})


def _get(data: bytes, keys):
    """Each key's value; 0 for keys that are not in the shard."""
    import numpy as np

    n = len(data) // 12
    own, values = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<f4", n, 8 * n)
    at, out, left = _slots(keys, n.bit_length() - 1), np.zeros(len(keys), np.float32), np.arange(len(keys))
    while len(left):
        seen = own[at]
        hit = seen == keys[left]
        out[left[hit]] = values[at[hit]]
        on = ~hit & (seen != -1)
        left, at = left[on], (at[on] + 1) & (n - 1)
    return out


def _score(blocks: list, shards: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def add(of: dict[str, list], sums) -> None:
            """The log probabilities of the n-grams gathered, to the sums of their rows; the shards' n-grams lie together."""
            asked = {}
            for lang, parts in of.items():
                keys, row = np.concatenate([k for _, k in parts]), np.repeat([i for i, _ in parts], [len(k) for _, k in parts])
                shard = (keys % shards).astype(np.uint32)
                order = np.argsort(shard, kind="stable")
                asked[lang] = keys[order], row[order], np.searchsorted(shard[order], np.arange(shards + 1))
            for block in each(blocks):
                for (lang, k), data in block.items():
                    if lang in asked:
                        keys, row, cuts = asked[lang]
                        x, y = cuts[k], cuts[k + 1]
                        sums += np.bincount(row[x:y], _get(data, keys[x:y]), len(sums))

        most = SCORED if len(blocks) == 1 else 4 * SCORED
        for b in few(batches):
            of: dict[str, list] = {}  # rows and n-grams of each language
            sums, sizes, held = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64), 0
            for i, (text, lang) in enumerate(zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)):
                for key in grams(text):
                    sizes[i] += len(key)
                    held += len(key)
                    of.setdefault(lang, []).append((i, key))
                    if held >= most:
                        add(of, sums)
                        of, held = {}, 0
            add(of, sums)
            rest = {c: b.column(c) for c in b.schema.names if c != "text"}
            yield pa.record_batch(rest | {"log_p": pa.array(sums), "n_grams": pa.array(sizes)})

    return run


def score(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, trusted, perplexity (a character's, the text's end included) of each row of ``docs``.

    trusted: the doc_ids whose texts train the models, but for those held out; repeated and null ones don't matter. A null lang is ``und``,
    a null text is empty (its end is scored). Without trusted texts of a language, its probabilities are uniform. Texts
    are scored whole, however long; repeated rows get a result each; an empty table gives none; other columns are left
    behind. Every n-gram of every text gets its probability by joins of counts. The resulting table is cut into shards
    and broadcast in blocks of bounded size, of which a task holds one at a time while it scores a batch. So texts are
    read twice and never written, however large the model, and neither the driver nor a task holds more than a block.
    """
    spark = docs.sparkSession
    ids = small(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0, HELD).otherwise(TRAIN)), MOST_IDS)
    rows = texts(docs, F.coalesce("lang", F.lit("und")).alias("lang"))
    rows = rows.join(ids, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(OTHER)))
    counted = rows.select("text", "lang", "trusted").mapInArrow(_count, "lang string, gram long, n long")
    counts = settle(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    model = probabilities(counts)
    shards = max(1, -(-model.count() // SHARD_ROWS)) | 1  # odd, so that a remainder depends on all of an n-gram
    cut = model.withColumn("shard", F.pmod("gram", F.lit(shards)).cast("int"))
    cut = settle(cut.groupBy("lang", "shard").applyInArrow(_shard, "lang string, shard int, data binary"), "model")
    blocks, block, held = [], {}, 0
    for r in cut.toLocalIterator():
        if held + len(r.data) > BLOCK_BYTES and block:
            blocks.append(spark.sparkContext.broadcast(block))
            block, held = {}, 0
        block[r.lang, r.shard] = bytes(r.data)
        held += len(r.data)
    blocks.append(spark.sparkContext.broadcast(block))
    scored = rows.mapInArrow(_score(blocks, shards), "doc_id long, lang string, trusted int, log_p double, n_grams long")
    scored = settle(scored, "scores")
    return scored.select("doc_id", "lang", "trusted", F.exp(-F.col("log_p") / F.col("n_grams")).alias("perplexity"))


def judge(scored: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, threshold and keep of each row of ``scored``: whether its perplexity is low enough.

    The threshold is SLACK times the QUANTILE of the held-out trusted texts of the language, or with fewer than
    LEAST_TRUSTED of them that of all languages' together; without any, all stay. Repeated rows count each and get a
    result each; an empty table gives none.
    """
    q = SLACK * F.percentile_approx("perplexity", QUANTILE, 10_000)
    known = scored.where(F.col("trusted") == HELD)
    every = known.agg(q).first()[0]
    own = known.groupBy("lang").agg(F.when(F.count("*") >= LEAST_TRUSTED, q).alias("own"))
    limit = F.coalesce("own", F.lit(every), F.lit(float("inf")))
    out = scored.join(small(own, MOST_LANGUAGES), "lang", "left").withColumn("threshold", limit)
    return out.select("doc_id", "lang", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("keep"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it stays; trusted are those labelled as good and not toxic. Cases as in ``score`` and ``judge``."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return judge(score(table(spark, sf_dir, "documents"), trusted))
