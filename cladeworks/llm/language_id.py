"""Language by rank-order profiles: out-of-place distance between a text's frequent n-grams and each language's."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeworks.llm.common import digests, few, raw, table, texts
from cladeworks.session import settle

#: n-grams of 1 to 3 code points; entries of a profile, of a text as of a language.
ORDERS, PROFILE = 3, 300
#: Most bytes of a table of languages by n-grams that is broadcast, 2 for each cell; larger ones are joined.
MOST_BYTES = 1 << 27
#: Code points that are counted at a time.
PIECE = 1 << 20


@functools.cache
def _letters():
    import numpy as np

    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _merge(keys, counts):
    import numpy as np

    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def ngrams(text: str):
    """Distinct n-grams as integers of 21 bits a code point, ascending, and how often each occurs.

    Letters count in lower case; every run of other characters is one blank, which an n-gram may hold at its ends.
    A long text is counted piece by piece: an n-gram belongs to the piece in which it ends.
    """
    import numpy as np

    text = text.lower()
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.full(1, 32, np.int64)  # the last of what has been read, blanks in a row being one
    for i in range(0, len(text), PIECE):
        c = np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        c = np.where(_letters()[c], c, 32)
        if i + PIECE >= len(text):
            c = np.append(c, 32)
        c = c[(c != 32) | (np.concatenate([before[-1:], c[:-1]]) != 32)]
        if not len(c):
            continue
        s, k = np.concatenate([before, c]), len(before)
        one, two, three = c[c != 32], s[k - 1 : -1] << 21 | c, s[:-2] << 42 | s[1:-1] << 21 | s[2:]
        keys, n = np.unique(np.concatenate([one, two, three[s[1:-1] != 32]]), return_counts=True)
        found, counts = (keys, n) if not len(found) else _merge(np.concatenate([found, keys]), np.concatenate([counts, n]))
        before = s[-2:]
    return found, counts


def _count(batches):
    import numpy as np
    import pyarrow as pa

    held: dict[str, list] = {}

    def out():
        for lang, parts in held.items():
            keys, n = _merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.record_batch({"lang": pa.array([lang] * len(keys), pa.string()), "gram": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})

    size = 0
    for b in few(batches):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).append(part := ngrams(text))
            size += len(part[0])
        if size > 4_000_000:
            held = {lang: [_merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))] for lang, parts in held.items()}
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > 2_000_000:
                yield from out()
                held, size = {}, 0
    yield from out()


def learn(docs: DataFrame) -> DataFrame:
    """lang, gram, r: each language's PROFILE most frequent n-grams, r from 0 (ties: the smaller integer).

    Learned from all whole texts with a non-null lang; repeated rows count each; an empty table gives no profile.
    """
    known = texts(docs.where(F.col("lang").isNotNull()), "lang").select("lang", "text")
    counts = known.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = [F.desc("n"), F.asc("gram")]
    part = F.row_number().over(Window.partitionBy("lang", F.pmod("gram", F.lit(16))).orderBy(*best))
    short = counts.withColumn("r", part).where(F.col("r") <= PROFILE)  # a language's rows are cut down in 16 parts first
    ranked = short.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*best)) - 1).where(F.col("r") < PROFILE)
    return settle(ranked.select("lang", "gram", "r"), "profiles")


class _Profiles:
    """Profiles as a table of ranks: a row for each language, by name, a column for each n-gram."""

    def __init__(self, rows: list):
        import numpy as np

        self.names = sorted({r.lang for r in rows})
        self.grams = np.unique(np.array([r.gram for r in rows], np.int64))
        self.ranks = np.full((len(self.names), len(self.grams)), -1, np.int16)
        at = {x: i for i, x in enumerate(self.names)}
        for r in rows:
            self.ranks[at[r.lang], np.searchsorted(self.grams, r.gram)] = r.r


def _ranked(text: str):
    """A text's PROFILE most frequent n-grams, in the order of their ranks."""
    import numpy as np

    keys, n = ngrams(text)
    return keys[np.argsort(-n, kind="stable")[:PROFILE]]


def _predict(profiles, keep_text: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, grams, ranks = profiles.value.names, profiles.value.grams, profiles.value.ranks

        def guess(text: str):
            keys = _ranked(text)
            if not len(keys) or not names:
                return "und", 0.0
            at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
            theirs = np.where(grams[at] == keys, ranks[:, at], -1)
            away = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(keys)))).sum(1)
            order = np.argsort(away, kind="stable")
            first, second = int(away[order[0]]), int(away[order[1]]) if len(order) > 1 else PROFILE * len(keys)
            return names[order[0]], (second - first) / second if second else 0.0

        for b in few(batches):
            found = [guess(t) for t in b.column("text").to_pylist()]
            rest = {c: b.column(c) for c in b.schema.names if keep_text or c != "text"}
            yield pa.record_batch(rest | {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())})

    return run


def _texts_grams(batches):
    """A row for each of a text's ranked n-grams, the text known by its 128-bit hash."""
    import numpy as np
    import pyarrow as pa

    for b in few(batches):
        found = [_ranked(t) for t in b.column("text").to_pylist()]
        a, z = digests(raw(b.column("text")))
        n = np.array([len(x) for x in found], np.int64)
        at = np.concatenate([np.arange(k) for k in n]) if len(n) else np.zeros(0, np.int64)
        keys = np.concatenate(found) if len(found) else np.zeros(0, np.int64)
        rep = lambda v: pa.array(np.repeat(v, n))
        yield pa.record_batch({"ta": rep(a.view(np.int64)), "tb": rep(z.view(np.int64)), "size": rep(n), "gram": pa.array(keys), "at": pa.array(at.astype(np.int64))})


def _text_keys(batches):
    import numpy as np
    import pyarrow as pa

    for b in few(batches):
        a, z = digests(raw(b.column("text")))
        yield pa.record_batch({c: b.column(c) for c in b.schema.names} | {"ta": pa.array(a.view(np.int64)), "tb": pa.array(z.view(np.int64))})


def _by_joins(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """ta, tb, lang_pred, score by text: n-grams of texts and profiles are joined and their displacements summed."""
    grams = rows.select("text").mapInArrow(_texts_grams, "ta long, tb long, size long, gram long, at long").dropDuplicates(["ta", "tb", "gram"])
    near = grams.join(profiles, "gram").groupBy("ta", "tb", "size", "lang").agg(F.sum(PROFILE - F.abs(F.col("at") - F.col("r"))).alias("won"))
    names = profiles.select("lang").distinct()
    first_names = [r.lang for r in names.orderBy("lang").limit(2).toLocalIterator()]  # those that a text without a common n-gram is at the same distance from
    shared = near.groupBy("ta", "tb", "size").agg(F.array_sort(F.collect_list(F.struct((PROFILE * F.col("size") - F.col("won")).alias("away"), "lang"))).alias("all"))
    some = grams.select("ta", "tb", "size").distinct().join(shared, ["ta", "tb", "size"], "left")
    rest = F.array(*(F.struct((PROFILE * F.col("size")).alias("away"), F.lit(x).alias("lang")) for x in first_names), F.struct((PROFILE * F.col("size")).alias("away"), F.lit("\U0010ffff").alias("lang")))
    best = F.slice(F.array_sort(F.concat(F.coalesce(F.slice("all", 1, 2), F.array().cast("array<struct<away:bigint,lang:string>>")), rest)), 1, 3)
    one = F.get(best, F.lit(0))
    two = F.get(F.filter(best, lambda x: x["lang"] != one["lang"]), F.lit(0))
    score = F.when(two["away"] > 0, (two["away"] - one["away"]) / two["away"]).otherwise(0.0)
    return some.select("ta", "tb", one["lang"].alias("lang_pred"), score.alias("score"))


def identify(docs: DataFrame, profiles: DataFrame, *more: str, keep_text: bool = False) -> DataFrame:
    """doc_id, the columns named in ``more`` (and text, if it is to be kept), lang_pred and score for each row, from its whole text alone.

    profiles: lang, gram, r, as learned. A null text, one without a letter, and any text if no language was learned
    get ``und`` and 0. The score is the lead of the nearest language over the second in distance, as a share of the
    second's (0 for a tie, which goes to the name that sorts first). Texts of any length are counted whole; repeated
    rows get a result each; an empty table gives none; columns that are not named are left behind. Profiles whose
    table has up to MOST_BYTES go to every task; larger ones are joined with the texts' n-grams, with the same result.
    """
    rows = texts(docs, *more)
    kinds = dict(rows.dtypes)
    size = profiles.agg(F.count_distinct("lang").alias("langs"), F.count_distinct("gram").alias("grams")).first()
    if 2 * size.langs * size.grams <= MOST_BYTES:
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns if keep_text or c != "text")
        held = docs.sparkSession.sparkContext.broadcast(_Profiles(list(profiles.toLocalIterator())))
        return rows.mapInArrow(_predict(held, keep_text), f"{schema}, lang_pred string, score double")
    kept = [c for c in rows.columns if keep_text or c != "text"]
    keyed = rows.mapInArrow(_text_keys, ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns) + ", ta long, tb long").select(*kept, "ta", "tb")
    found = keyed.join(_by_joins(rows, profiles), ["ta", "tb"], "left")
    return found.select(*kept, F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def held_out() -> Column:
    """Whether crc32 of the doc_id as text (null: empty) leaves 0 on division by 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from profiles of those that are not held out; cases as in ``identify``."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
